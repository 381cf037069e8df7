"""Mixing sources to target weights by Pareto order sampling.

1. Targets. Sources share the wanted words by weight; a target stops at ``MOST`` times the source's
   words, and what it can't take is shared again among the others.
2. Expected copies. Inside a source, documents of one merit have the same expected copies; a merit twice as
   high has twice as many, up to ``MOST``. Their whole part is certain, the rest is an inclusion probability p.
3. Order. A document draws a uniform number u from a hash of its id. Its rank in the source is by random odds
   over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``; the first ones are taken until the words that the certain copies
   leave are reached. The sample so has a fixed size; the one document that stands on the mark is taken in part.

No source is sorted as a whole: ranks fall into bins whose number grows with the source, bins wholly
before the mark are taken, and only the bin with the mark (about ``BIN`` documents) is put in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.common import checkpointed, looked_up

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, over and over.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: Copies of a document at most.
MOST = 2
#: Documents with fewer words have half the merit of the others.
SHORT = 20
BIN = 8192
SEED = 11


def _level(group: list[str], total: Column, weight: Column, cap: Column, order: list[str]) -> tuple[Column, Column]:
    """What each row gets when ``total`` is shared by weight inside the group and nobody gets above its cap: whether it is at its cap, and its share otherwise.

    In the order of cap by weight, a row is at its cap if that is below its share of what the rows before it leave.
    """
    fullness = F.coalesce(F.try_divide(cap, weight), F.lit(0.0))
    window = Window.partitionBy(*(group or [F.lit(0)])).orderBy(fullness, *order)
    before = F.coalesce(F.sum(cap).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(weight).over(window.rowsBetween(0, Window.unboundedFollowing))
    level = F.coalesce(F.try_divide(total - before, after), F.lit(0.0))
    return cap <= weight * level, level


def _shared(rows: DataFrame, name: str, group: list[str], total: Column, weight: Column, cap: Column, order: list[str]) -> DataFrame:
    """``rows`` with the column ``name``: the share of ``total`` by weight, at most the cap."""
    full, level = _level(group, total, weight, cap, order)
    marked = rows.withColumn("_full", full).withColumn("_level", level)
    # behind the first row below its cap the levels only fall: the highest one is that of all
    common = F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy(*(group or [F.lit(0)])))
    return marked.withColumn(name, F.when(F.col("_full"), cap).otherwise(weight * common)).drop("_full", "_level")


def sized(docs: DataFrame, merit: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words), merit and draw (uniform, by a hash of seed and id; of the text where there is no id) of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    known = docs.select("doc_id", "source", size.alias("size"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))).alias("name"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("name")).cast("binary"), 256)
    draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    if merit is None:
        merit = F.when(F.col("size") < SHORT, 0.5).otherwise(1.0)
    return known.select("doc_id", "source", "size", merit.cast("double").alias("merit"), draw.alias("draw"))


def _allotted(rows: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """One row for each source and merit: the source's size, documents and target, certain copies, inclusion probability and words left to the sample."""
    cells = rows.groupBy("source", "merit").agg(F.sum("size").alias("cell_size"), F.count("*").alias("n"))
    sources = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"), F.sum("n").alias("documents"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*(F.lit(float(w)) for w in weights))
    sources = sources.withColumn("place", place).withColumn("weight", F.element_at(table, F.col("place") % len(weights) + 1))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share))
    sources = _shared(sources.withColumn("total", total), "target", [], F.col("total"), F.col("weight"), F.col("source_size") * F.lit(float(most)), ["place"])
    cells = cells.withColumnRenamed("source", "cell_source").join(sources, F.col("cell_source").eqNullSafe(F.col("source"))).drop("cell_source")
    weight = F.col("merit") * F.col("cell_size")
    cells = _shared(cells, "words", ["place"], F.col("target"), weight, F.col("cell_size") * F.lit(float(most)), ["merit"])
    # a share within a rounding error of whole copies is whole
    expected = F.coalesce(F.try_divide(F.col("words"), F.col("cell_size").cast("double")), F.lit(0.0))
    cells = cells.withColumn("expected", F.when(F.abs(expected - F.round(expected)) < 1e-9, F.round(expected)).otherwise(expected))
    cells = cells.withColumn("certain", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.floor("expected"))
    left = F.round("target").cast("long") - F.sum(F.col("certain") * F.col("cell_size")).over(Window.partitionBy("place"))
    open_words = F.sum(F.when(F.col("p") > 0, F.col("cell_size")).otherwise(0)).over(Window.partitionBy("place"))
    cells = cells.withColumn("sampled", F.least(F.greatest(left, F.lit(0)), open_words))
    return cells.select("place", "source", "merit", "source_size", "documents", "target", "certain", "p", "sampled")


def mix(docs: DataFrame, merit: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, part of every document of ``docs`` (doc_id, text, source; other columns are not read).

    ``taken`` is ``copies`` whole copies and the first ``part`` words of one more; only one document of a source has a part. ``merit`` is a
    column expression over ``size`` and ``source`` with few different values above 0; by default short documents have half.
    Sources weigh ``weights`` in code-point order, null last, over and over. A null or empty text has size 0 and nothing is taken of it; a source
    without words has target 0. Repeated rows draw the same number and count as documents of their own; rows without a doc_id draw by their text.
    Equal ranks go by doc_id. No rows give no rows. Sources are one row each in the step that finds their targets.
    """
    rows = checkpointed(sized(docs, merit, seed))
    plan = checkpointed(_allotted(rows, weights, share, most))
    joined = rows.withColumnsRenamed({"source": "_source", "merit": "_merit"}).join(
        looked_up(plan), F.col("_source").eqNullSafe(F.col("source")) & F.col("_merit").eqNullSafe(F.col("merit")))
    odds = F.try_divide(F.col("draw") / (1 - F.col("draw")), F.col("p") / (1 - F.col("p")))
    bins = F.ceil(F.col("documents") / BIN)
    # odds over odds, put between 0 and 1; the mark is about 1/2, where no bin holds more than its share
    order = odds / (1 + odds)
    ranked = joined.withColumn("order", order).withColumn("bin", F.when(F.col("p") > 0, F.least(F.floor(F.col("order") * bins), bins - 1)))
    ranked = ranked.select("doc_id", "size", "place", "source_size", "target", "certain", "sampled", "order", "bin")
    words = ranked.where("bin IS NOT NULL").groupBy("place", "bin").agg(F.sum("size").alias("words"), F.first("sampled").alias("sampled"))
    upto = F.sum("words").over(Window.partitionBy("place").orderBy("bin"))
    mark = words.withColumn("upto", upto).where((F.col("upto") - F.col("words") < F.col("sampled")) & (F.col("sampled") <= F.col("upto")))
    mark = mark.select("place", F.col("bin").alias("mark"), (F.col("sampled") - F.col("upto") + F.col("words")).alias("rest"))
    marked = ranked.join(looked_up(checkpointed(mark)), "place", "left")  # no document is shuffled for its source
    on_mark = F.coalesce(F.col("bin") == F.col("mark"), F.lit(False))
    clear = marked.where(~on_mark).withColumn("extra", F.when(F.col("bin") < F.col("mark"), F.col("size")).otherwise(0))
    within = Window.partitionBy("place").orderBy("order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.sum("size").over(within), F.lit(0))
    near = marked.where(on_mark).withColumn("extra", F.greatest(F.least(F.col("rest") - reached, F.col("size")), F.lit(0)))
    whole = F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    return clear.unionByName(near).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("certain") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("certain") + whole).otherwise(0).cast("long").alias("copies"), F.when(whole == 1, 0).otherwise(F.col("extra")).cast("long").alias("part"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: doc_id, copy (from 0), text; the last copy of a document in part ends behind its last word taken.

    ``docs`` must have different ids that are not null.
    """
    chosen = mix(docs, **options).where("copies > 0 OR part > 0").select("doc_id", "copies", "part")
    joined = docs.select("doc_id", "text").join(chosen, "doc_id")
    copies = F.sequence(F.lit(0).cast("long"), F.col("copies") + F.when(F.col("part") > 0, 0).otherwise(-1))
    rows = joined.select("doc_id", F.explode(copies).alias("copy"), "text", "copies", "part")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, copy, copies, part in zip(*(batch.column(k).to_pylist() for k in (2, 1, 3, 4))):
                if copy == copies:
                    for n, found in enumerate(re.finditer(WORD, text), 1):
                        if n == part:
                            text = text[: found.end()]
                            break
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "copy", "text"])

    whole = rows.where("copy < copies").select("doc_id", "copy", "text")
    return whole.unionByName(rows.where("copy = copies").mapInArrow(cut, "doc_id long, copy long, text string"))


#: The same in SQL, with every source put in order as a whole.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(sha256('11:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
merits AS (SELECT *, CASE WHEN size < 20 THEN 0.5 ELSE 1.0 END::DOUBLE AS merit FROM docs),
src AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM merits GROUP BY source),
levels AS (SELECT *, 2.0 * source_size AS cap, coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
  1.5 * sum(source_size) OVER () AS total FROM src),
targets AS (SELECT *, CASE WHEN cap <= weight * (total - before) / after THEN cap
  ELSE weight * max((total - before) / after) FILTER (cap > weight * (total - before) / after) OVER () END AS target FROM levels),
cells AS (SELECT source, merit, sum(size)::DOUBLE AS cell FROM merits GROUP BY ALL),
cell_levels AS (SELECT c.*, t.target, t.source_size, merit * cell AS w, 2 * cell AS cap,
  coalesce(sum(2 * cell) OVER (PARTITION BY c.source ORDER BY CASE WHEN cell > 0 THEN 1 / merit ELSE 0 END, merit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(merit * cell) OVER (PARTITION BY c.source ORDER BY CASE WHEN cell > 0 THEN 1 / merit ELSE 0 END, merit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM cells c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
shares AS (SELECT *, CASE WHEN cap <= w * lev THEN cap ELSE w * max(lev) FILTER (cap > w * lev) OVER (PARTITION BY source) END AS words
  FROM (SELECT *, CASE WHEN after > 0 THEN (target - before) / after ELSE 0 END AS lev FROM cell_levels)),
probs AS (SELECT *, floor(e) AS certain, e - floor(e) AS p FROM (SELECT *, CASE WHEN abs(x - round(x)) < 1e-9 THEN round(x) ELSE x END AS e
  FROM (SELECT *, CASE WHEN cell > 0 THEN words / cell ELSE 0 END AS x FROM shares))),
plan AS (SELECT *, least(greatest(round(target) - sum(certain * cell) OVER (PARTITION BY source), 0),
  sum(CASE WHEN p > 0 THEN cell ELSE 0 END) OVER (PARTITION BY source)) AS sampled FROM probs),
ranked AS (SELECT m.*, p.* EXCLUDE (source, merit), CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds
  FROM merits m JOIN plan p ON m.source IS NOT DISTINCT FROM p.source AND m.merit = p.merit),
summed AS (SELECT *, coalesce(sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM ranked)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (certain * size + CASE WHEN odds IS NULL THEN 0 ELSE greatest(least(sampled - reached, size), 0) END)::BIGINT AS taken
FROM summed"""
