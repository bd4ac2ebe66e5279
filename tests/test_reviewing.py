"""Reviewers' roles against a plain version, pages of members, windows that are refused, and saved models."""

import random

import pytest
from pyspark.sql import functions as F

from cindertrace.operators import reviewing
from cindertrace.sources import exports, models

REVIEWS = "id long, seq long, role string, source_label string, certainty string, inside boolean, qualifies boolean, reviewer string"


def plain_role(slots, reviews, name, adjudicates, seen):
    """A case's role for one reviewer, from its reviews in their order."""
    blind = [r for r in reviews if r["role"] == "REVIEWER"]
    settled = any(r["role"] == "ADJUDICATOR" and len(blind) > 1 and r["seq"] > max(b["seq"] for b in blind) for r in reviews)
    pending = not settled and len(blind) > 1 and len({r["source_label"] for r in blind}) > 1
    mine = any(r["reviewer"].lower() == name.lower() for r in reviews)
    if pending and adjudicates and not mine:
        return "ADJUDICATOR"
    if not (mine or seen or pending) and len(blind) < slots:
        return "REVIEWER"
    return None


@pytest.fixture(scope="module")
def random_cases(spark):
    rng = random.Random(5)
    cases = [(k, 1 + k % 2, rng.randrange(10**6), rng.random() < 0.6) for k in range(300)]
    reviews, seen = [], []
    for k in range(300):
        for seq in range(rng.randrange(4)):
            reviews.append({"id": k, "seq": seq, "role": "ADJUDICATOR" if seq > 1 else "REVIEWER", "source_label": rng.choice(["INDUSTRIAL", "OTHER", "UNRESOLVED"]), "certainty": "HIGH", "inside": True, "qualifies": False, "reviewer": rng.choice(["Ann", "BEN", "cay"])})
        if rng.random() < 0.2:
            seen += [(k, "ANN"), (k, "ann")]
    table = spark.createDataFrame(cases, "id long, review_slots long, place long, history_complete boolean")
    return cases, reviews, seen, table, spark.createDataFrame(reviews, REVIEWS), spark.createDataFrame(seen, "id long, reviewer string")


@pytest.mark.parametrize("adjudicates", [True, False])
def test_roles_and_desk(random_cases, adjudicates):
    cases, reviews, seen, *tables = random_cases
    judged = reviewing.roles(*tables, "ann", adjudicates)
    got = {r["id"]: r["role"] for r in judged.collect()}
    shown = {k for k, _ in seen}
    want = {k: plain_role(slots, [r for r in reviews if r["id"] == k], "ann", adjudicates, k in shown) for k, slots, _, _ in cases}
    assert got == want
    order = {k: (not complete, place, k) for k, _, place, complete in cases}
    desk = reviewing.desk(judged, 7).collect()
    for role in ("ADJUDICATOR", "REVIEWER"):
        first = sorted((k for k in want if want[k] == role), key=order.get)[:7]
        assert {r["id"] for r in desk if r["role"] == role} == set(first)
    counts = reviewing.desk_counts(judged, adjudicates).first()
    assert counts["remaining_reviews"] == sum(r == "REVIEWER" for r in want.values())
    assert counts["remaining_adjudications"] == (sum(r == "ADJUDICATOR" for r in want.values()) if adjudicates else None)
    added = {r["id"] for r in reviewing.newly_seen(judged, "ann").collect()}
    assert added == {k for k in want if want[k] == "ADJUDICATOR" and k not in shown}


def test_without_reviews(spark, random_cases):
    cases, _, _, table, reviews, seen = random_cases
    judged = reviewing.roles(table, reviews.limit(0), seen.limit(0), "ann", True)
    assert {r["role"] for r in judged.collect()} == {"REVIEWER"}
    assert reviewing.roles(table.limit(0), reviews, seen, "ann", True).count() == 0


def test_member_pages_hold_every_member_once_in_order(spark):
    rng = random.Random(2)
    sizes = {1: 1, 2: 9, 3: 10, 4: 31}
    rows = [(k, rng.randrange(5), 100 * k + j) for k, n in sizes.items() for j in range(n)]
    members = spark.createDataFrame(rows, "id long, at long, obs_id long").withColumn("acquired_at", F.timestamp_seconds("at"))
    pages = reviewing.member_pages(members, ["obs_id"], 3).collect()
    for k, n in sizes.items():
        own = sorted((p["page"], p["n"], [m["obs_id"] for m in p["members"]]) for p in pages if p["id"] == k)
        assert [o for _, _, part in own for o in part] == [o for _, _, o in sorted((i, at, o) for i, at, o in rows if i == k)]
        assert [p for p, _, _ in own] == list(range(1, -(-n // 3) + 1)) and all(n <= 3 for _, n, _ in own)
    assert reviewing.member_pages(members.limit(0), ["obs_id"]).count() == 0


def test_audit_finds_facilities_of_both_kinds(spark):
    cases = spark.createDataFrame([(1, 70.0, 22.0, "TRAIN", "a"), (2, 70.003, 22.0, "TEST", "b"), (3, 71.0, 22.0, "TRAIN", "c"), (4, 71.012, 22.0, "VALIDATION", "d"), (5, 75.0, 22.0, "TRAIN", "e")], "id long, lon double, lat double, split string, split_group string")
    areas = spark.createDataFrame([(10, 70.0015, 22.0), (11, 75.0, 22.0)], "fac_id long, lon double, lat double")
    plants = spark.createDataFrame([(20, 71.006, 22.0), (21, 75.0, 22.0)], "fac_id long, lon double, lat double")
    audit = reviewing.grouping_audit(cases, areas, plants)
    found = sorted((r["kind"], r["fac_id"], r["cases"], r["groups"], tuple(r["splits"])) for r in audit.collect())
    assert found == [("area", 10, 2, 2, ("TEST", "TRAIN")), ("plant", 20, 2, 2, ("TRAIN", "VALIDATION"))]
    assert tuple(reviewing.audit_verdict(audit).first()) == (2, 4, False)
    assert tuple(reviewing.audit_verdict(reviewing.grouping_audit(cases.filter("split = 'TRAIN'"), areas, plants)).first()) == (0, 0, True)


def test_windows_are_refused_not_cut(spark):
    rng = random.Random(8)
    obs = [(k, rng.uniform(-2, 3), rng.uniform(-2, 3), rng.randrange(10 * 86400)) for k in range(800)]
    asked = [(j, x, y, x + w, y + w, rng.randrange(8), 1 + rng.randrange(4)) for j, (x, y, w) in enumerate((rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice([0.1, 1.0, 4.0])) for _ in range(40))]
    o = spark.createDataFrame(obs, "obs_id long, lon double, lat double, at long").withColumn("acquired_at", F.timestamp_seconds("at"))
    day = F.lit("1970-01-01").cast("date")
    r = spark.createDataFrame(asked, "request_id long, west double, south double, east double, north double, a int, d int")
    r = r.withColumns({"start_date": F.date_add(day, F.col("a")), "end_date": F.date_add(day, F.col("a") + F.col("d"))}).drop("a", "d")
    want = {j: {k for k, x, y, s in obs if w <= x <= e and lo <= y <= hi and a * 86400 <= s < (a + d) * 86400} for j, w, lo, e, hi, a, d in asked}
    judged = exports.windows(r, o, 20)
    assert {x["request_id"]: (x["matches"], x["refused"]) for x in judged.collect()} == {j: (len(v), len(v) > 20) for j, v in want.items()}
    assert {len(v) > 20 for v in want.values()} == {True, False} and any(not v for v in want.values())
    got = sorted((x["request_id"], x["obs_id"]) for x in exports.window_rows(r, judged, o).collect())
    assert got == sorted((j, k) for j, v in want.items() if len(v) <= 20 for k in v)


def report(name, status="PROMOTED"):
    return {"model_id": name, "case_set": "set-one", "algorithm": "gbt", "status": status, "label_policy": "gold-or-silver", "labels_sha256": "0" * 64, "baselines_macro_f1": 0.5, "evaluation": {"full": {"macro_f1": 0.8}, "brier_full_calibrated": 0.1}}


def test_saved_models(spark, tmp_path):
    from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(k, float(k % 7), float(k % 2)) for k in range(60)], "id long, x double, label double")
    train = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=2, seed=1).fit(train)
    scored = model.transform(train).select("id", F.col("prediction").alias("p"))
    folder = str(tmp_path)
    for n in range(3):
        models.save(spark, folder, report(f"model-{n}"), f"2024-02-0{n + 1}T00:00:00Z", model, ["x"], {"slope": 1.0}, scored)
    assert [r["model_id"] for r in models.newest(spark, folder, 2).collect()] == ["model-2", "model-1"]
    assert models.changed(spark, folder, "model-1").count() == 0
    back = GBTClassificationModel.load(f"{folder}/models/model-1/files/model").transform(train).select("id", F.col("prediction").alias("p"))
    saved = models.predictions(spark, folder, "model-1", "id long, p double")
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, scored.collect())) == sorted(map(tuple, back.collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        models.save(spark, folder, report("model-1"), "2024-03-01T00:00:00Z")
    (tmp_path / "models/model-1/files/model_card.md").write_text("Better than it was.")
    (tmp_path / "models/model-1/files/calibration.json").unlink()
    (tmp_path / "models/model-1/files/.calibration.json.crc").unlink()
    (tmp_path / "models/model-1/files/.model_card.md.crc").unlink()
    assert {(r["path"], r["problem"]) for r in models.changed(spark, folder, "model-1").collect()} == {("model_card.md", "HASH_MISMATCH"), ("calibration.json", "MISSING")}
    with pytest.raises(ValueError, match="UNKNOWN_MODEL"):
        models.changed(spark, folder, "model-9")


def test_dry_runs_show_no_scores():
    assert models.summary(report("model-a", models.DRY_RUN)) == {"status": models.DRY_RUN, "label_policy": "gold-or-silver"}
    assert models.summary(report("model-a")) == {"status": "PROMOTED", "label_policy": "gold-or-silver", "baselines_macro_f1": 0.5, "macro_f1": {"full": 0.8}, "brier": 0.1}
    assert "no evidence" in models.card(report("model-a", models.DRY_RUN))
