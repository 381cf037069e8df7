import zlib

import numpy as np

from trafficlens.llm import langid


def test_grams_against_plain_loops():
    texts = ["", "Ab, c!", "  ", "É1é x", "abc" * 50]
    buckets, bounds, has_letter = langid.grams(texts)
    for k, text in enumerate(texts):
        norm = " "
        for c in f"{text.lower()} ":
            if c.isalpha():
                norm += c
            elif norm[-1] != " ":
                norm += " "
        expected = []
        for i in range(len(norm)):
            for n in langid.ORDERS:
                gram = norm[i:i + n]
                if len(gram) == n and gram != " ":
                    value = sum(ord(c) * f for c, f in zip(gram, langid._FACTORS)) % 2**64
                    expected.append((((value ^ (value >> 29)) * langid._FACTORS[3]) % 2**64) >> (64 - langid.BUCKET_BITS))
        assert buckets[bounds[k]:bounds[k + 1]].tolist() == expected
        assert has_letter[k] == any(c.isalpha() for c in text)


def test_predictions(spark, docs_of):
    texts = ["the cat and the dog", "le chat et le chien", "the house of the man", "la maison de la femme", None, "", "123 !?", "the " * 5000] * 6
    lang = {k: "en" if t and "the" in t else "fr" for k, t in enumerate(texts) if t and t[0].isalpha()}
    rows = {r.doc_id: r for r in langid.identified(docs_of(texts, lang=lang)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        assert rows[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert rows[k].lang_pred == lang.get(k, "und") and 0 <= rows[k].score <= 1
        assert (rows[k].score == 0) == (k not in lang)


def test_held_out_rows_teach_nothing(spark, docs_of):
    out = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 0]
    texts = ["texte" if k in out else "words" for k in range(60)]
    rows = langid.identified(docs_of(texts, lang={k: "fr" if k in out else "en" for k in range(60)})).collect()
    assert {r.lang_pred for r in rows} == {"en"}


def test_nothing_to_learn_from(spark, docs_of):
    assert [(r.lang_pred, r.score) for r in langid.identified(docs_of(["a", None])).collect()] == [("und", 0.0)] * 2
    assert langid.identified(docs_of([])).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
