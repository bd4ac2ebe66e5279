"""How corpus filters interact: every order of five filters, replayed on every document.

1. Each document's failures are told once, as bits (A to D from its text, E from the table: is its
   text that of a document with a smaller doc_id?).
2. The flags are crossed with the 120 orders, which are broadcast; an order's five steps are exploded,
   each with what the document failed before it and whether its first failure is there.
3. Conditional sums by part, order and step, combined in each task before rows are shuffled: a task
   passes on 600 rows for each of its parts, however many documents it has.

Texts are compared by their SHA-256. The least doc_id of each text comes back to the documents by a
join; texts that more than one in HOT of all rows have (so at most HOT texts) are broadcast, so that no
task gets a large group of copies.

Defined results: a null text is empty, a null source an empty string. A null doc_id is smaller than
none and none is smaller than it: such a row never fails E and makes no other fail, and it has no label.
Repeated rows count each; rows with one doc_id and one text do not fail E by each other. A doc_id with
several labels counts as good (toxic) if one says so. An empty table gives no row. Further columns are
ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.llm.common import cut, table, texts

FILTERS = "ABCDE"
#: A: fewest words; B: least share of distinct words; C: greatest share of capitals (in hundredths); D: signs.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
#: Texts that more than one in so many rows have are broadcast.
HOT = 1000
#: Documents that one task replays.
TASK_ROWS = 200_000


def text_flags(text: Column) -> Column:
    """The bits of A to D (A is 1, B is 2, and so on)."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.char_length(text), F.regexp_like(text, F.lit(SIGNS))]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def document_flags(documents: DataFrame) -> DataFrame:
    """doc_id, part and flags of every document."""
    text = F.coalesce("text", F.lit(""))
    texts(documents)
    own = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_flags(text).alias("flags"), F.unhex(F.sha2(text, 256)).alias("said")))
    rows = own.count()
    first = cut(own.groupBy("said").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL"))
    common = F.broadcast(first.filter(F.col("n") * HOT > rows).select("said", F.col("first").alias("common")))
    rare = first.filter(F.col("n") * HOT <= rows).select("said", "first")
    told = own.join(common, "said", "left")
    # rows with a common text meet none of the rare ones, so they need not lie together
    spread = F.when(F.col("common").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16))).otherwise(-1).cast("int")
    told = told.withColumn("spread", spread).join(rare.withColumn("spread", F.lit(-1)), ["said", "spread"], "left")
    late = F.coalesce(F.col("doc_id") > F.coalesce("common", "first"), F.lit(False))
    return told.select("doc_id", "part", (F.col("flags") + late.cast("int") * 16).alias("flags"))


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """With good and toxic, told by labels(doc_id, quality, toxic)."""
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = flags.filter("doc_id IS NOT NULL").join(said, "doc_id", "left").select("part", "flags", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return known.unionAll(flags.filter("doc_id IS NULL").select("part", "flags", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def orders(spark: SparkSession) -> DataFrame:
    """filter_order, and steps: of each its number, its filter's bit, and the bits of the filters before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        bits = [1 << k for k in order]
        rows.append(("".join(FILTERS[k] for k in order), [(n + 1, b, sum(bits[:n])) for n, b in enumerate(bits)]))
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step:int,bit:int,before:int>>")


def replay(flags: DataFrame) -> DataFrame:
    """The audit of flags(part, flags, good, toxic): one row for each part, order and step."""
    flags = cut(flags)
    tasks = max(flags.sparkSession.sparkContext.defaultParallelism, -(-flags.count() // TASK_ROWS))  # a row is 600 here, which its bytes do not tell
    crossed = flags.repartition(tasks).crossJoin(F.broadcast(orders(flags.sparkSession)))
    steps = crossed.select("part", "filter_order", "flags", "good", "toxic", F.inline("steps"))
    fails, earlier = F.col("flags").bitwiseAND(F.col("bit")) != 0, F.col("flags").bitwiseAND(F.col("before")) != 0
    first = fails & ~earlier
    told = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(~fails & ~earlier).alias("kept"), F.count_if(first).alias("removed"), F.count_if(fails & earlier).alias("redundant"), F.count_if(F.col("flags") == F.col("bit")).alias("unique_fails"),
        F.count_if(first & F.col("good")).alias("good_lost"), F.count_if(first & F.col("toxic")).alias("toxic_lost"),
    )
    told = cut(told.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))))
    credit = told.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return told.join(credit, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(labelled(document_flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lead AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
said AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
    CASE WHEN len(words) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
    CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END) AS failed
  FROM docs JOIN lead USING (text) LEFT JOIN said USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
patterns AS (SELECT part, failed, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
steps AS (
  SELECT part, filter_order, step, n, good, toxic, failed, contains(failed, filter_order[step]) AS here,
    translate(failed, filter_order[1:step - 1], '') <> failed AS earlier
  FROM patterns, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
told AS (
  SELECT part, filter_order, step, filter_order[step] AS filter,
    coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (here AND len(failed) = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (here AND NOT earlier AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT earlier AND toxic), 0) AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM told
"""
