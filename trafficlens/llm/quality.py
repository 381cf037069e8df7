r"""Quality rules from the text itself and from how often its lines recur in the corpus.

Lines are normalised (lower case, digits and white space alike) and hashed. For each host the distinct
texts that hold a line are counted; lines of more texts than ``MAX_TEXTS`` are boilerplate and are
removed, and a document that keeps less than ``MIN_KEPT`` of its characters is rejected.
Everything is column expressions; a text's repeated windows are found by sorting
the hashes of its windows inside the row, so only lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
#: Per cent of words in repeated windows.
MAX_REPEATED = 30
#: Distinct texts of a host that a line may stand in.
MAX_TEXTS = 20
#: Share of a document's characters that must be left when such lines are gone.
MIN_KEPT = 0.5


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), BLANKS, " "))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<int>")
    return (
        docs.withColumn("_words", F.array_remove(F.split(text, BLANKS, -1), ""))
        .withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        # hashes of one, two, four, eight words from each word on
        .withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_two", F.zip_with("_one", _shifted(F.col("_one"), 1), lambda a, b: F.xxhash64(a, b)))
        .withColumn("_four", F.zip_with("_two", _shifted(F.col("_two"), 2), lambda a, b: F.xxhash64(a, b)))
        .withColumn("_eight", F.slice(F.zip_with("_four", _shifted(F.col("_four"), 4), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size("_four") - (WINDOW - 1), F.lit(0))))
        .withColumn("_repeats", F.size(F.array_distinct("_eight")) < F.size("_eight"))
        # places of the windows whose neighbour in hash order is the same
        .withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_eight", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("_places", F.sort_array(F.array_distinct(F.flatten(F.zip_with(
            "_sorted", _shifted(F.col("_sorted"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))))))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(
            F.zip_with("_places", _shifted(F.col("_places"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long"))
        .drop("_words", "_lines", "_one", "_two", "_four", "_eight", "_repeats", "_sorted", "_places")
    )


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: doc_id, host, hash of the normalised line, characters, hash of the document's text."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.where("text is not null").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("host"), F.xxhash64("text").alias("whole"),
        F.explode(F.transform(lines, lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.length(x).cast("long").alias("chars")))).alias("x"),
    ).select("doc_id", "host", "whole", "x.line", "x.chars")


def frequent_lines(docs: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """host and line of the normalised lines that stand in more than ``max_texts`` distinct texts of the host."""
    counted = _lines(docs).groupBy("host", "line", "whole").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("one").alias("n_texts"))
    return counted.where(F.col("n_texts") > max_texts)


def quality_rules(docs: DataFrame, max_texts: int = MAX_TEXTS, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row for each document, with base counts, the characters of removed lines, and the verdict.

    A null text has no words and fails. A null source is a host of its own. Copies of a text count
    once for a line. Rows with the same doc_id share the characters of their removed lines. Columns
    beyond doc_id, text and source are not read; no rows give no rows.
    """
    # the key of the join is made of both columns, so that either side is dealt out for the join alone and hot lines can be split
    key = F.concat_ws(":", F.col("line").cast("string"), "host")
    frequent = frequent_lines(docs, max_texts).select(key.alias("key"))
    lines = _lines(docs).select("doc_id", "chars", key.alias("key"))
    removed = lines.join(frequent, "key").groupBy("doc_id").agg(F.sum("chars").alias("removed_chars"), F.count("*").alias("n_removed_lines"))
    chars = F.length(F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "")).cast("long")
    base = with_counts(docs.select("doc_id", "text")).withColumn("line_chars", chars).drop("text").alias("base")
    joined = base.join(removed.alias("removed"), F.col("base.doc_id").eqNullSafe(F.col("removed.doc_id")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    gone = F.coalesce("removed_chars", F.lit(0).cast("long"))
    return joined.select(
        "base.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("line_chars") - gone >= min_kept * F.col("line_chars"))).alias("kept"),
        F.coalesce("n_removed_lines", F.lit(0).cast("long")).alias("n_removed_lines"), gone.alias("removed_chars"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, text FROM d),
places AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS gram FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM places) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM repeated) GROUP BY doc_id),
lines AS (
  SELECT d.doc_id, host, md5(d.text) AS whole, x, length(x) AS chars,
    trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM d JOIN (SELECT doc_id, unnest(l) AS x FROM words) USING (doc_id)),
frequent AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT whole) > {MAX_TEXTS}),
removed AS (SELECT doc_id, sum(chars) AS chars, count(*) AS n FROM lines JOIN frequent USING (host, line) GROUP BY doc_id),
base AS (
  SELECT words.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(removed.chars, 0) AS removed_chars, coalesce(removed.n, 0) AS n_removed_lines, length(array_to_string(l, '')) AS line_chars
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)),
verdict AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND line_chars - removed_chars >= {MIN_KEPT} * line_chars AS kept,
  n_removed_lines::BIGINT AS n_removed_lines, removed_chars::BIGINT AS removed_chars
FROM verdict
"""
