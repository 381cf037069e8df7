import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm import test_minhash, test_pii, test_suffix  # noqa: E402
from trafficlens.llm import langid, pii  # noqa: E402


def corpus():
    draw = random.Random(9)
    word = {"en": ["the", "and", "house", "with", "there", "thing", "whole", "other"], "fr": ["le", "et", "maison", "avec", "où", "chose", "été", "autre"]}
    rows = []
    vocabulary = {k: v + ["".join(draw.choice(v) for _ in range(2)) for _ in range(300)] for k, v in word.items()}
    passage = " ".join(draw.choice(vocabulary["en"]) for _ in range(60))
    for k in range(70):
        lang = draw.choice(["en", "fr"])
        words = [draw.choice(vocabulary[lang]) for _ in range(draw.randint(20, 120))]
        if k % 9 == 0:
            words[10:10] = passage.split()
        if k % 7 == 0:
            words[5:5] = ["mail", f"a{k}@mail.example.com", "or", "4111111111111111"]
        rows.append((" ".join(words), lang))
        if k % 6 == 0:
            copy = list(words)
            copy[-1] = "changed"
            rows.append((" ".join(copy), lang))
            rows.append((" ".join(words), None))
    rows += [(None, None), ("", "en"), ("123 456", "en"), ("?!", None), ("the " * 3000, "en")]
    draw.shuffle(rows)
    return rows


def test_stages_by_brute_force(spark, docs_of):
    rows = corpus()
    texts = {k: t for k, (t, _) in enumerate(rows)}
    docs = docs_of([t for t, _ in rows], lang={k: lang for k, (_, lang) in enumerate(rows)})
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        seen[name] = spark.createDataFrame(docs.collect(), docs.schema)
        docs = seen[name]
        if name != "packing":
            assert docs.columns == columns
    got = {name: {r.doc_id: r.text for r in frame.collect()} for name, frame in seen.items() if name != "packing"}
    # language: what has no letter goes, the model being sure of all else
    expected = {k: t for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert got["language"] == expected
    ids = sorted(expected)
    _, label = test_minhash.brute([expected[k] for k in ids], 5)
    expected = {k: expected[k] for n, k in enumerate(ids) if label[n] == n}
    assert got["near_dedup"] == expected
    ids = sorted(expected)
    left = [x[3].decode(errors="ignore") for x in test_suffix.brute([expected[k] for k in ids], 100)]
    expected = {k: t for k, t in zip(ids, left) if t.strip()}
    assert got["substring_dedup"] == expected
    ids = sorted(expected)
    terms = test_pii.brute_terms([(k, expected[k]) for k in ids])
    assert any(terms)
    for n, k in enumerate(ids):
        spans = [(start, kind, end) for start, kind, end in test_pii.brute(expected[k])]
        spans += [(int(s.split(":")[1]), 4, int(s.split(":")[2])) for s in terms[n]]
        out, at = "", 0
        for start, kind, end in sorted(spans):
            if end > at:
                out += expected[k][at:start] + pii.MASKS[pii.KINDS[kind]]
                at = end
        expected[k] = out + expected[k][at:]
    assert got["personal_data"] == expected
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    pieces = seen["packing"].collect()
    for k, text in expected.items():
        tokens = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(tokens)
        assert all(zlib.crc32(tokens[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    assert {p.doc_id for p in pieces} == expected.keys()


def test_empty_table(spark, docs_of):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
    assert docs.count() == 0


NAMES = ("lang_pred", "_lang_pred", "score", "kept_id", "kept", "component_id", "n_shingles", "row", "doc", "_doc", "_shift", "shift", "runs", "asked", "n_removed",
         "n_bytes", "forms", "terms", "whole", "_whole", "words", "entities", "entity", "term", "text_", "a.b", "key", "value")


def test_extra_columns_with_names_of_the_stages(spark, docs_of):
    docs = docs_of(["the house mail a@b.co and the other thing " * 9, "the other house " * 40, None, ""], lang=dict.fromkeys(range(4), "en"))
    for name in NAMES:
        docs = docs.withColumn(name, langid.F.lit(f"own {name}"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.columns == columns and docs.count() == 2
            assert all(r[c] == f"own {c}" for r in docs.collect() for c in NAMES)
    assert {r.doc_id for r in docs.collect()} == {0, 1}


def test_held_out_rows_are_kept_too(spark, docs_of):
    docs = docs_of(["the house and the other thing"] * 20, lang={k: "en" for k in range(20)})
    assert corpus_pipeline.language(spark, docs, "").count() == 20 and docs.where(langid.held_out(docs.doc_id)).count() > 0
