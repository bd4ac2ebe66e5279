"""Main text, the quality classifier, the pipeline and the registry."""

import html
import importlib
import re
import time

import numpy as np
import pytest

from cindertrace.llm import pages, weak_labels


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


GREETING = "<div>Welcome to our lovely site of news today friends</div>"
RIGHTS = "<p>All rights reserved by the owners of this place since forever</p>"
ROWS = [
    (1, "http://a.com/1", page(GREETING + "<div>First unique story about cats and dogs here</div><div class='comments'><p>nice one</p></div>" + RIGHTS)),
    (2, "http://a.com/2", page(GREETING + "<div>Second unique tale on ships and seas there</div>" + RIGHTS)),
    (3, "http://a.com/3", page(GREETING + "<div>Second unique tale on ships and seas there</div>" + RIGHTS)),
    (4, "http://b.com/3", page(GREETING)),
    (5, None, None),
    (6, "", ""),
    (7, "x y", "<main><h1>T&eacute;st&nbsp;a</h1><aside>no</aside><script>if(a<b){'</p>'}</script>x<br>y<p>z&lt;</main>tail"),
    (8, "http://a.com/8", page("<nav>menu</nav><article><header><h1>Head</h1></header><p>One <b>two<p>three &amp;amp; four<form><p>mail</form><footer>foot</footer></article><div class='sidebar'>side</div><article class='comment'>me too</article>")),
    (None, "http://a.com/9", "<article>a<!-- b --> c</article>"),
]
WANT = {1: "First unique story about cats and dogs here", 2: "Second unique tale on ships and seas there", 3: "Second unique tale on ships and seas there", 4: "Welcome to our lovely site of news today friends", 5: "", 6: "", 7: "Tést a\nx y\nz<", 8: "Head\nOne two\nthree &amp; four", None: "a c"}


def test_main_text(spark):
    out = pages.main_text(spark.createDataFrame(ROWS + ROWS[:1], "page_id long, url string, html string")).collect()
    assert len(out) == len(ROWS) + 1
    assert {r["page_id"]: r["text"] for r in out} == WANT
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_table(spark, small):
    own = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in pages.op7_html_main_text(spark, small).collect():
        article = own[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_names_inside_an_article(spark):
    """Only what the main text is without goes; a part that is merely called a result or a legal one stays."""
    html = "<article><p>One.</p><div class='search-results'><p>Two.</p></div><div class='legal copyright related social skip'>Three.</div><div class='ad'>no</div><ul class='menu'><li>no</li></ul><p class='notice'>no</p><div id='comments'>no</div></article>"
    assert pages.main_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()["text"] == "One.\nTwo.\nThree."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='page has-sidebar'><article><p>In.</p></article></div>", "In."),
        ("<main><div class='content with-sidebar'><p>In.</p></div></main>", "In."),
        ("<div class='nav-open'><main><p>In.</p></main></div>", "In."),
        ("<article><div class='article-header'><h1>Title</h1></div><p class='ad-1920'>Year.</p><div class='in-text-ad'>no</div></article>", "Title\nYear."),
        ("<div class='sidebar'><main><p>In.</p></main></div>", "In."),
        ("<div class='sidebar'><article>Teaser</article></div><main>The text itself is here.</main>", "The text itself is here."),
        ("<article>One<div class='comments'><article>me too</article></div></article>", "One"),
        ("<article>One<div class='related-menu'><article>no</article></div><p>Two</p></article>", "One\nTwo"),
        ("<nav><article>no</article></nav><main>In.</main>", "In."),
        ("<div class='site-footer'>no</div><div class='footerless'>In.</div>", "In."),
        ("<article><p title='a>b' class=x>In.</p></article>", "In."),
        ("<article>a < b <3 c</article>", "a < b <3 c"),
        ("<article>In.<p class=\"x", "In."),
        ("<article>In.</p></div></article>out", "In."),
        ("<article>In.<script>x</scripty></script >More</article>", "In.More"),
    ],
)
def test_layouts(html, text):
    assert "\n".join(pages.split_page(html)[0] or [t for k, t in pages.split_page(html)[1] if k == pages.OUTER]) == text


BROKEN = ["<a ", '<a "', "<div>", "</p>", "<div></p>", "<a 'x=\"", "<script>", "<!--", "<", "<p class='", "<a href='x>y'>", 'a="', "a ", "<b c"]


@pytest.mark.parametrize("unit", BROKEN)
@pytest.mark.parametrize("start", ["", "<div ", "<article>"])
def test_broken_pages_of_a_megabyte(unit, start):
    began = time.perf_counter()
    pages.split_page(start + unit * (1_000_000 // len(unit)) + ">")
    assert time.perf_counter() - began < 5


def made_page(rng):
    """Markup of random nested parts, and the text that a reader takes from its article: a plain walk over the same tree."""
    words = lambda n: " ".join(rng.choice([f"w{k}" for k in range(500)], n))
    said = []

    def part(depth, kept):
        kind = rng.integers(0, 8 if depth < 4 else 3)
        if kind < 3:
            t = words(rng.integers(1, 8))
            cut = rng.integers(0, len(t) + 1)
            said.extend([t] * kept)
            return f"<p class='{rng.choice(['ad-1920', 'lead', 'nav-open'])}'>{t[:cut]}<b data-x=\"a>b\">{t[cut:]}</b></p>"
        if kind == 3:
            tag = rng.choice(["nav", "footer", "aside", "form"])
            return f"<{tag}>{part(depth + 1, False)}</{tag}>"
        if kind == 4:
            return f"<div class='{rng.choice(['comments', 'site-menu', 'x sidebar', 'ads'])}'>{part(depth + 1, False)}{part(depth + 1, False)}</div>"
        if kind == 5:
            return f"<script>if (a < b) {{ '<p>{words(3)}</p>' }}</script><!-- <p>{words(2)}</p> -->"
        return f"<{'section' if kind == 6 else 'div'} class='{rng.choice(['has-sidebar', 'body', 'article-header', 'with-menu'])}'>" + "".join(part(depth + 1, kept) for _ in range(rng.integers(1, 4))) + ("</section>" if kind == 6 else "</div>")

    inside = "".join(part(0, True) for _ in range(rng.integers(1, 6)))
    wrap = rng.choice(["page has-sidebar", "nav-open", "content", "sidebar"])
    return f"<body class='menu'><header>{words(3)}</header><div class='{wrap}'><article>{inside}</article></div><div class='sidebar'>{words(5)}</div><footer>{words(4)}</footer></body>", "\n".join(said)


def test_generated_pages(spark):
    rng = np.random.default_rng(17)
    made = [made_page(rng) for _ in range(400)]
    df = spark.createDataFrame([(k, "http://x.com", h, "x", 1) for k, (h, _) in enumerate(made)], "page_id long, url string, html string, text string, salt int")
    got = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    assert all(got[k] == t for k, (_, t) in enumerate(made) if t)
    assert sum(bool(t) for _, t in made) > 300


def brute_hosts(rows, length):
    """What is left of texts [(host, text)] when all words go that a window repeats which another text of the host, or this one elsewhere, has."""
    seen = {}
    for host, text in set(rows):
        w = text.split()
        for i in range(len(w) - length + 1):
            seen[host, tuple(w[i : i + length])] = seen.get((host, tuple(w[i : i + length])), 0) + 1
    out = []
    for host, text in rows:
        w = text.split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if seen[host, tuple(w[i : i + length])] > 1:
                gone[i : i + length] = True
        left, at = [], 0
        for block in text.split("\n"):
            n = len(block.split())
            left.append(" ".join(x for x, g in zip(w[at : at + n], gone[at : at + n], strict=True) if not g))
            at += n
        out.append("\n".join(x for x in left if x))
    return out


@pytest.mark.parametrize("mark", ["div", "article"])
def test_host_runs_against_brute_force(spark, mark):
    """Pages without an article lose runs, not blocks, that their host repeats; articles do so only when asked."""
    rng = np.random.default_rng(12)
    line = [" ".join(rng.choice([f"w{k}" for k in range(300)], 9)) for _ in range(6)]
    rows, bodies = [], []
    for k in range(60):
        own = [" ".join(rng.choice([f"v{j}" for j in range(400)], rng.integers(3, 30))) for _ in range(3)]
        own[0] += " " + line[k % 6] + " " + own[2]
        own.insert(1, line[(k + 1) % 6])
        if k % 9 == 8:
            own = bodies[-1][1].split("\n")
        host = f"h{k % 3}.com" if k % 9 != 8 else bodies[-1][0]
        bodies.append((host, "\n".join(own)))
        rows.append((k, f"http://{host}/{k}", f"<{mark}>" + "".join(f"<p>{x}</p>" for x in own) + f"</{mark}>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in pages.main_text(df, "outside" if mark == "div" else "everywhere").collect()}
    assert [got[k] for k in range(60)] == brute_hosts(bodies, pages.LENGTH)
    if mark == "article":
        assert {r["page_id"]: r["text"] for r in pages.main_text(df).collect()} == {k: t for k, (_, t) in enumerate(bodies)}


def corpus():
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "gre") for b in ("lan", "mer", "nix", "pol", "rus", "tem")]
    harsh = ["vile", "rotten", "horrid", "nasty"]
    docs, labels = [], []
    for k in range(700):
        w = list(rng.choice(words, 60))
        kind = "toxic" if k % 7 == 0 else "signs" if k % 11 == 0 else "stutter" if k % 13 == 0 else "good"
        if kind == "toxic":
            w[10], w[30] = rng.choice(harsh, 2)
        if kind == "signs":
            w = [x + "$$$" for x in w]
        if kind == "stutter":
            w = [x for x in w[:6] for _ in range(10)]
        sentence = " ".join(x + ("." if i % 12 == 11 and kind != "signs" else "") for i, x in enumerate(w))
        docs.append((k, sentence, "en" if k % 2 else None, "s", len(sentence)))
        labels.append((k, int(kind in ("good", "toxic")), int(kind == "toxic")))
    return docs + [(900, None, "en", "s", 0), (901, " \n", None, "s", 2)], labels


def test_classifier_on_held_out_labels(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([r for r in labels if r[0] % 2 or r[0] % 3 == 0] + [(None, 1, 0), (5, 1, None)], "doc_id long, quality long, toxic long")
    got = {r["doc_id"]: r["keep"] for r in weak_labels.classify(d, known).collect()}
    assert len(got) == len(docs) and not got[900] and not got[901]
    held = [r for r in labels if not (r[0] % 2 or r[0] % 3 == 0)]
    right = [got[k] == (q == 1 and t == 0) for k, q, t in held]
    assert np.mean(right) > 0.97
    kept = weak_labels.keep_good(d, known)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v}
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert weak_labels.classify(d, none).count() == len(docs) and weak_labels.classify(d.limit(0), none).count() == 0


def test_estimate_recovers_classes():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.2
    v = np.full((4000, len(weak_labels.LABELLERS)), weak_labels.KEEP)
    for k, rate in enumerate((0.7, 0.6, 0.8, 0.5, 0.6)):
        v[:, k] = np.where(np.where(truth, rng.random(4000) < rate, rng.random(4000) < 0.03), weak_labels.REJECT, weak_labels.KEEP)
    p, n = np.unique(weak_labels.pattern(v), return_counts=True)
    bad, _ = weak_labels.estimate(p, n.astype(float))
    guess = dict(zip(p.tolist(), bad.tolist(), strict=True))
    assert np.mean([(guess[x] > 0.5) == t for x, t in zip(weak_labels.pattern(v).tolist(), truth, strict=True)]) > 0.95


def test_pipeline_runs_stage_by_stage(spark, small, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "passage_dedup", "decontaminate", "tokenize"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, small)
        made.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.schema(made.schema).parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= before and len(ids) == out.count()
        if name != "tokenize":
            assert out.columns == docs.columns
        before, docs = ids, out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()} == before


def test_registry():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("text,want", [("", []), ("<p>a", [(1, 0, "a")]), ("a<b c", [(1, 0, "a<b c")]), ("<p title='>'>x</p>", [(1, 0, "x")])])
def test_blocks(text, want):
    assert pages.blocks(text) == want
