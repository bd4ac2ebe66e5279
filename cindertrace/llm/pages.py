"""Main text of web pages, by structure and by what a host repeats.

Each page is cut into blocks. Blocks inside an article are its main text, but for menus, asides,
footers, forms, notices, adverts and comments in them. If no article has text, it is main's; an article or
main that lies in a container named like boilerplate (layout classes may say anything) counts where it has
more text than what lies outside such containers. A class, id or role names boilerplate as a whole or by
its last part (site-footer), not by a part of another kind (has-sidebar, nav-open, ad-1920). Pages
with neither keep the blocks that are in no container of boilerplate, less the runs of words that their
host repeats: what such pages offer, and what stands outside the main text of all others, is laid end to
end by host, and a sparse suffix array over it finds long substrings that distinct pages of one host
repeat. Pages that offer the same text count as one page there, so that copies don't cover each other.

host_runs="everywhere" lets the array decide on main text too. That is right only where main texts are
all different: a passage that two articles of a host share is then taken for boilerplate.

Defined results: null and empty html give an empty text; unclosed and stray tags end at the next
enclosing close; character references are decoded, white space (Unicode) becomes one blank, a line
break is white space; blocks without text are left out. Repeated rows and rows with a null page_id
have their rows. A null or strange url is a host of its own kind, the empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.llm.common import cut, prepare, record_batch, table
from cindertrace.llm.repeats import covered, repeated_ranges
from cindertrace.llm.words import Words, sliding_argmin

#: Words in the shortest repeated substring.
LENGTH = 6
HEAD = 3

#: Names of attributes begin where no name goes on, so that a search is linear in a tag of any length.
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
NAME = re.compile("/?[a-zA-Z][^\\s/>]*+")
STOP = re.compile("[\"'>]")
#: A quote that is not closed within so many characters is none.
QUOTED = 1 << 16
WORD = re.compile("[A-Z]?[a-z0-9]+|[A-Z]+")
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
RAW_END = {name: re.compile(rf"</{name}(?![^\s/>])", re.I) for name in RAW}
UNCLOSED = frozenset("p li dt dd tr td th option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no main text, wherever they are.
ASIDE = frozenset("nav footer aside form dialog menu head select button svg math object canvas audio video datalist".split())
#: Words of class, id and role that name such parts.
NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond related recommended breadcrumb breadcrumbs pagination pager"
    " widget toolbar search contentinfo complementary dialog form copyright legal disclaimer skip hidden".split()
)
#: Of those, what names a part that is no main text even inside an article.
INNER_NAMES = frozenset("nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored notice notices cookie cookies consent comment comments disqus reply replies form hidden".split())
COMMENTS = frozenset("comment comments reply replies".split())
#: A compound that begins with one of these tells of a layout, not of a part.
LAYOUT = frozenset("has have with without no not is show hide hides toggle open js".split())
#: OUTER: any text; NAMED: in an element that its names call boilerplate; ASIDE_KIND: in one that is boilerplate by what it is.
OUTER, NAMED, ASIDE_KIND = 1, 2, 3
#: Where a block lies: neither, main or article in a named container, main, article.
NAMED_MAIN, NAMED_ARTICLE, MAIN, ARTICLE = 1, 2, 3, 4


def named(value: str) -> set[str]:
    """What the words of a class, id or role call an element: the whole word or its last part."""
    out = set()
    for word in value.split():
        parts = [p.lower() for p in WORD.findall(word)]
        if parts and (len(parts) == 1 or parts[0] not in LAYOUT):
            out |= {word.lower(), parts[-1]}
    return out


def aside(name: str, attributes: str, inside: bool = False) -> int:
    """OUTER, NAMED or ASIDE_KIND, for an element; inside: it is in an article or main."""
    if name in ASIDE:
        return ASIDE_KIND
    if not attributes or name in ("html", "body"):
        return OUTER
    words = set()
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role"):
            words |= named(value)
        elif key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return ASIDE_KIND
    if name in ("article", "main"):
        return ASIDE_KIND if words & COMMENTS else OUTER
    if re.search(r"(^|\s)hidden(\s|$|=)", attributes):
        return ASIDE_KIND
    return NAMED if words & (INNER_NAMES if inside else NAMES) else OUTER


def tag_end(html: str, at: int) -> int:
    """Where the tag ends that goes on at `at`: the first > outside quotes; -1 if there is none."""
    first = html.find(">", at)
    while first >= 0 and (m := STOP.search(html, at)):
        if m[0] == ">":
            return m.start()
        stop = html.find(m[0], m.end(), m.end() + QUOTED)
        at = stop + 1 if stop >= 0 else m.end()
    return first


def tags(html: str) -> Iterator[tuple[str, str, str]]:
    """(text before it, name with / if it closes, attributes) of each tag; the last has neither. Linear in the page's length."""
    at, text, end = 0, [], len(html)
    while at < end:
        i = html.find("<", at)
        if i < 0:
            break
        if i > at:
            text.append(unescape(html[at:i]))
        if html.startswith("<!--", i):
            stop = html.find("-->", i + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if html.startswith(("<!", "<?"), i):
            stop = html.find(">", i)
            at = stop + 1 if stop >= 0 else end
            continue
        m = NAME.match(html, i + 1)
        if not m:
            text.append("<")
            at = i + 1
            continue
        stop = tag_end(html, m.end())
        if stop < 0:  # what the page's end cuts off is a tag if it has an attribute, else text
            at = end if "=" in html[i:] else i
            break
        at = stop + 1
        name = m[0].lower()
        if name in RAW:
            close = RAW_END[name].search(html, at)
            stop = html.find(">", close.end()) if close else -1
            at = stop + 1 if stop >= 0 else end
            continue
        yield "".join(text), name, html[m.end() : stop]
        text = []
    if at < end:
        text.append(unescape(html[at:]))
    yield "".join(text), "", ""


def blocks(html: str) -> list[tuple[int, int, str]]:
    """(kind, place, text) of each block that has text, in order."""
    out: list[tuple[int, int, str]] = []
    open_: list[tuple[str, int, int]] = []  # name, and place and kind around it
    names: Counter[str] = Counter()
    place, kind, own = 0, OUTER, []

    def close() -> None:
        text = " ".join("".join(own).split())
        own.clear()
        if text:
            out.append((kind, place, text))

    for text, tag, attributes in tags(html):
        own.append(text)
        name = tag.removeprefix("/")
        if name in INLINE:
            if name == "br":
                own.append(" ")
            continue
        close()
        if tag != name:
            if names[name]:
                while True:
                    last, place, kind = open_.pop()
                    names[last] -= 1
                    if last == name:
                        break
            continue
        if not name or name in VOID or name in UNCLOSED and not attributes or attributes.endswith("/"):
            continue
        open_.append((name, place, kind))
        names[name] += 1
        if kind == ASIDE_KIND:
            continue
        found = aside(name, attributes, place > 0)
        main = name == "main" or 'role="main"' in attributes
        if found == ASIDE_KIND or name == "header" and not place:
            kind = ASIDE_KIND
        elif name == "article" or main:
            # what is named boilerplate around an article or main is not known to be so
            inner = (ARTICLE, NAMED_ARTICLE) if name == "article" else (MAIN, NAMED_MAIN)
            if kind == OUTER or not place:
                place, kind = max(place, inner[kind == NAMED]), OUTER
        else:
            kind = max(kind, found)
    return out


def split_page(html: str | None) -> tuple[list[str], list[tuple[int, str]]]:
    """The main blocks, and (kind, text) of all others."""
    found = blocks(html or "")
    size: Counter[int] = Counter()
    for kind, place, text in found:
        if kind == OUTER:
            size[place] += len(text)
    best = ARTICLE if size[ARTICLE] else max((MAIN, NAMED_ARTICLE, NAMED_MAIN), key=lambda p: size[p])
    main = [t for k, p, t in found if k == OUTER and p == best]
    rest = [(k, t) for k, p, t in found if k != OUTER or p != best]
    return main, rest


def minimisers(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    grams = w.grams(HEAD)
    best = sliding_argmin(grams, length - HEAD + 1)
    starts = np.flatnonzero(w.inside(length)[: len(best)])
    place = best[starts]
    return starts, place, grams[place], place


def unique_runs(blocks: list[str], gone: np.ndarray) -> list[str]:
    """The blocks without the words that gone marks, over all of them; blocks with none left are left out."""
    out, at = [], 0
    for text in blocks:
        words = text.encode().split()
        own = gone[at : at + len(words)]
        at += len(words)
        out.append(text if not own.any() else b" ".join(w for w, g in zip(words, own, strict=True) if not g).decode())
    return [t for t in out if t]


def main_text(pages: DataFrame, host_runs: str = "outside") -> DataFrame:
    """page_id, url, text of every row of pages(page_id, url, html).

    Pages with an article or main are told from their structure, in one pass without a shuffle
    (host_runs="outside"); what the others offer is written once and joined with what their host repeats.
    """
    if host_runs not in ("outside", "everywhere"):
        raise ValueError(host_runs)
    everywhere = host_runs == "everywhere"
    prepare(pages.sparkSession)
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host).alias("salt"))
    offered = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("salt", pa.int64()), ("text", pa.string()), ("open", pa.bool_())])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two rows for a page at most: what may be cut (open), and what only shows what its host repeats."""
        for b in batches:
            out = []
            for page_id, url, html, salt in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "salt")), strict=True):
                main, rest = split_page(html)
                if not main or everywhere:
                    out.append((page_id, url, salt, "\n".join(main or [t for kind, t in rest if kind == OUTER]), True))
                if main and rest:
                    out.append((None, None, salt, "\n".join(t for _, t in rest), False))
            if out:
                yield record_batch(offered, *zip(*out, strict=True))

    def structured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, u, main) for p, u, h in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) if (main := split_page(h)[0])]
            yield record_batch(schema, *([r[k] for r in out] for k in range(2)), ["\n".join(r[2]) for r in out])

    def cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                own = text.split("\n")
                out.append("\n".join(unique_runs(own, covered(len(text.encode().split()), ranges, LENGTH, False))))
            yield record_batch(schema, b.column("page_id"), b.column("url"), out)

    kinds = "page_id long, url string, text string"
    texts = cut(rows.mapInArrow(offer, "page_id long, url string, salt long, text string, open boolean").withColumn("key", F.xxhash64("salt", "text")))
    # one row stands for all that offer the same text on a host
    first = texts.groupBy("salt", "key").agg(F.first("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "key", "text", "salt")
    ranges = repeated_ranges(cut(first), minimisers, LENGTH).select("key", "ranges")
    open_ = texts.filter("open").join(ranges, "key", "left").select("page_id", "url", "text", "ranges").mapInArrow(cleared, kinds)
    return open_ if everywhere else rows.select("page_id", "url", "html").mapInArrow(structured, kinds).unionByName(open_)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
