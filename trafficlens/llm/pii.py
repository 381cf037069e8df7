r"""Personal data by form, and by what the corpus says about the words beside it.

Forms (mail addresses, network addresses, card and phone numbers) are found with regular expressions.
A form found is a protected entity. The words of a document are terms; how strongly a term reveals an entity is estimated from
the documents that hold both, with a prior of ``PRIOR`` documents that speaks for the entity's share e of all documents:

    p(entity | term) = (n(entity, term) + PRIOR * e) / (n(term) + PRIOR)

A term discloses an entity if at most ``RESIDUE`` bits of uncertainty are left, -log2 p(entity | term), and it tells at least ``GAIN``
bits, log2(p(entity | term) / e). Counts are of documents, so a name that stands anywhere in the one document that holds an address is told apart
from a word that other documents use as well. A disclosing term is generalised wherever it stands in a document of its entity.

Everything is column expressions. Texts are searched once; hashes of words, mentions and counts are written and shuffled, and pairs
are made only of terms that stand mostly in documents with entities.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import checkpointed

#: Kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
#: Expressions of the forms. Runs that can only fail are left out by possessive quantifiers and by what stands around them, so that
#: no run is searched from each of its places; a mail address may begin inside a run where the one before it ended.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Four parts of at most 255.
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
#: A term: letters and digits.
TERM = r"[\p{L}\p{N}]++"
PRIOR = 0.5
RESIDUE = 0.6
GAIN = 1.0
#: What a span of each kind is replaced by.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each of some integers, the sum or the like of all before it, 0 for the first.

    Made in blocks of about the square root of their number, as an array that grows in an aggregate is copied each time.
    """

    def running(block: Column, first: Column) -> Column:
        return F.aggregate(block, F.array(first), lambda done, x: F.concat(done, F.array(both(F.element_at(done, -1), x))))

    def joined(blocks: Column) -> Column:
        firsts = running(F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), both)), F.lit(0))
        return F.flatten(F.zip_with(blocks, F.slice(firsts, F.lit(1), F.size(blocks)), lambda block, first: F.slice(running(block, first), F.lit(1), F.size(block))))

    size = F.ceil(F.sqrt(F.size(values))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, size))
    return F.when(F.size(values) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<int>"))


def _located(text: Column, form: str, kind: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points: what lies between them has a length, too."""
    matches = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    between = F.split(text, form, -1)
    pieces = F.zip_with(F.transform(between, lambda x: F.length(x)), matches, lambda gap, value: F.struct((gap + F.length(value)).alias("step"), value.alias("value")))

    def placed(pieces: Column) -> Column:
        before = _before(F.transform(pieces, lambda x: x["step"]), lambda a, b: a + b)
        return F.zip_with(pieces, before, lambda x, at: F.struct(
            (at + x["step"] - F.length(x["value"])).alias("start"), F.lit(kind).alias("kind"), (at + x["step"]).alias("end"), x["value"].alias("value")))

    return _let(F.filter(pieces, lambda x: x["value"].isNotNull()), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a number, doubled at every other place from the right, sum to a multiple of ten."""
    digits = _digits(value)

    def weight(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, 1).cast("int")
        return total + F.when(place % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weight) % 10 == 0


def _passes(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def forms_of(text: Column) -> Column:
    """The spans of all forms, by start and kind."""
    none = F.array().cast(_SPAN)
    possible = {"email": F.instr(text, "@") > 0, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": F.instr(text, "+") > 0}
    found = [
        F.when(possible[kind], F.filter(_located(text, form, k), partial(_passes, kind))).otherwise(none)
        for k, (kind, form) in enumerate(FORMS.items())
    ]
    return F.sort_array(F.concat(*found))


def seen(docs: DataFrame) -> DataFrame:
    """doc_id, whole (the text's hash), forms, entities and words (hashes, each once) of every document with text: all that the texts are searched for."""
    text = F.col("text")
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w)))
    found = docs.where(text.isNotNull()).select("doc_id", F.xxhash64(text).alias("whole"), forms_of(text).alias("forms"), words.alias("words"))
    entities = F.array_distinct(F.transform("forms", lambda m: F.xxhash64(m["kind"], F.lower(m["value"]))))
    return checkpointed(found.withColumn("entities", entities))


def disclosed(found: DataFrame, residue: float = RESIDUE, gain: float = GAIN) -> DataFrame:
    """doc_id, whole and words (hashes) of the documents of :func:`seen` that hold disclosing terms of their entities."""
    within = found.where(F.size("entities") > 0)
    least = 2.0 ** -residue
    # a term can disclose an entity only if it stands mostly in documents that hold any
    terms = found.select(F.explode("words").alias("term"), (F.size("entities") > 0).cast("int").alias("held"))
    terms = terms.groupBy("term").agg(F.count("*").alias("n_term"), F.sum("held").alias("n_held"))
    terms = terms.where((F.col("n_held") > 0) & (F.col("n_held") + PRIOR >= least * (F.col("n_term") + PRIOR)))
    # rows that repeat a document count as documents; they hold the same pairs
    places = within.groupBy("doc_id", "whole").agg(F.first("entities").alias("entities"), F.first("words").alias("words"), F.count("*").alias("copies"))
    places = places.select("doc_id", "whole", "entities", "copies", F.explode("words").alias("term")).join(terms, "term")
    pairs = checkpointed(places.select("doc_id", "whole", "copies", "term", "n_term", F.explode("entities").alias("entity")))
    entities = within.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = found.agg(F.count("*").alias("n")).scalar()
    counted = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_pair"), F.first("n_term").alias("n_term")).join(entities, "entity")
    share = F.col("n_entity") / n
    posterior = (F.col("n_pair") + PRIOR * share) / (F.col("n_term") + PRIOR)
    flagged = counted.where((posterior >= least) & (F.log2(posterior / share) >= gain)).select("entity", "term")
    return pairs.join(flagged, ["entity", "term"]).groupBy("doc_id", "whole").agg(F.collect_set("term").alias("words"))


def sanitised(docs: DataFrame, residue: float = RESIDUE, gain: float = GAIN) -> DataFrame:
    """``row`` (the whole row of ``docs``), ``forms`` (spans by form) and ``terms`` (spans of disclosing terms), for every row.

    A null text has no spans and is no document of the counts. A null doc_id has its own spans; rows that repeat both id and text have
    the same ones, and count as often as they stand there. Terms are compared in lower case, and listed where they stand outside of forms.
    Without entities there are no terms. Other columns stay in ``row``, whatever their names; no rows give no rows.
    """
    found = seen(docs)
    forms = found.where(F.size("forms") > 0).groupBy("doc_id", "whole").agg(F.first("forms").alias("forms"))
    known = forms.join(disclosed(found, residue, gain).withColumnsRenamed({"doc_id": "_doc", "whole": "_text"}),
                       F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("whole") == F.col("_text")), "left").drop("_doc", "_text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("_whole"))
    joined = rows.join(known, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_whole") == F.col("whole")) & F.col("row.text").isNotNull(), "left")
    none = F.array().cast(_SPAN)
    # forms become blanks of their length, so words are looked for outside of them
    blanked = _let(F.col("forms"), lambda spans: _rewritten(F.col("row.text"), spans, lambda s, at: F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], at))))
    outside = F.filter(_located(blanked, TERM, len(FORMS)), lambda x: F.array_contains(F.col("words"), F.xxhash64(F.lower(x["value"]))))
    plain = F.transform(outside, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(None).cast("string").alias("value")))
    return joined.select("row", F.coalesce("forms", none).alias("forms"), F.when(F.size("words") > 0, plain).otherwise(none).alias("terms"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`sanitised` rows."""
    kinds = F.transform("forms", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:-1])]
    return found.select("row.doc_id", *counts, F.sha2(listed(F.col("forms")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.sort_array(F.concat("forms", "terms"))).alias("spans"))


def _rewritten(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with something in place of each sorted span, given it and the end of the spans before it; what lies inside earlier spans is left out."""
    ends = F.transform(spans, lambda s: s["end"])
    pieces = F.zip_with(spans, _before(ends, lambda a, b: F.greatest(a, b)), lambda s, at: F.when(s["end"] <= at, "").otherwise(
        F.concat(F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0))), by(s, at))))
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.coalesce(F.array_max(ends), F.lit(0)) + 1, F.length(text)))


def masked(found: DataFrame) -> DataFrame:
    """The rows of :func:`sanitised` with every span of ``text`` replaced by the mask of its kind; of overlapping spans the first wins and the rest is cut."""
    masks = F.array(*(F.lit(MASKS[k]) for k in KINDS))
    text = F.col("row.text")
    replaced = _let(F.sort_array(F.concat("forms", "terms")), lambda spans: _rewritten(text, spans, lambda s, at: F.element_at(masks, s["kind"] + 1)))
    changed = F.when(F.size("forms") + F.size("terms") > 0, replaced).otherwise(text)
    names = found.schema["row"].dataType.fieldNames()
    return found.select(*((changed if c == "text" else F.col("row").getField(c)).alias(c) for c in names))
