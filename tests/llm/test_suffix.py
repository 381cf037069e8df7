import hashlib
import random

import numpy as np
import pytest

from trafficlens.llm import suffix
from trafficlens.llm.sais import common_prefixes, suffix_arrays


def brute(texts, length):
    """Removed spans of each text, from a table of all windows."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            window = raw[k:k + length]
            if window in seen:
                gone[k:k + length] = [True] * length
            seen.add(window)
        out.append((len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def corpus(seed, n=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 6)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = [None, "", "x", "a" * 700, "ab" * 300, "a" * 99, "\0" * 260, shared[0][:99], shared[0][:100]]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(draw.randint(0, 40)))]
        for _ in range(draw.randint(0, 3)):
            passage = draw.choice(shared)
            a = draw.randrange(len(passage))
            parts += [passage[a:] if draw.random() < 0.5 else passage, " ".join(word() for _ in range(draw.randint(0, 20)))]
        texts.append(" ".join(parts))
    texts += [texts[20], texts[21], texts[20]]
    draw.shuffle(texts)
    return texts


def check(frame, texts, length=100):
    expected = brute(texts, length)
    rows = {r.doc_id: r for r in frame.collect()}
    assert rows.keys() == set(range(len(texts)))
    for k, row in rows.items():
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == expected[k], (k, texts[k])


def test_suffix_arrays():
    draw = random.Random(1)
    for trial in range(150):
        texts = [[draw.randint(1, draw.choice([1, 2, 4, 20])) for _ in range(draw.randint(0, 50))] * draw.choice([1, 3]) + [0] for _ in range(draw.randint(1, 6))]
        texts.sort(key=len, reverse=True)
        sizes = np.array([len(t) for t in texts])
        flat = np.array([x for t in texts for x in t])
        arrays = suffix_arrays(flat, sizes, 21)
        prefixes = common_prefixes(flat.astype(np.uint8), arrays, sizes, 10)
        base = 0
        for text in texts:
            order = sorted(range(len(text)), key=lambda i: text[i:])
            assert (arrays[base:base + len(text)] - base).tolist() == order
            assert prefixes[base + order[0]] == 0
            for a, b in zip(order, order[1:]):
                same = next((j for j in range(10) if max(a, b) + j >= len(text) or text[a + j] != text[b + j]), 10)
                assert prefixes[base + b] == same or max(a, b) + prefixes[base + b] >= len(text)
            base += len(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_by_brute_force(spark, docs_of, seed):
    texts = corpus(seed)
    check(suffix.without_repeats(docs_of(texts).repartition(3)), texts)


@pytest.mark.parametrize("period", [79, 80, 81, 82, 83])
def test_periods_about_the_grams_of_a_window(spark, docs_of, period):
    draw = random.Random(period)
    # one lone document for each size: its alphabet is its own, so that no group has a second content
    texts = []
    for k, size in enumerate((250, 405, 900)):
        unit = "".join(draw.choices([chr(0x100 + 40 * k + j) for j in range(40)], k=period // 2)) + "x" * (period % 2)
        raw = unit.encode() * (size // period + 1)
        texts.append(raw[: size - size % period].decode())
    expected = brute(texts, 100)
    assert all(e[1] > 0 for e in expected[1:])
    check(suffix.without_repeats(docs_of(texts)), texts)


def test_wide_groups_and_long_runs(spark, docs_of, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", 3)
    monkeypatch.setattr(suffix, "RUN", 64)
    texts = corpus(3)
    check(suffix.without_repeats(docs_of(texts).repartition(3)), texts)


def test_wide_groups_in_small_pieces(spark, docs_of, monkeypatch):
    """Groups that go on over many pieces of a stream, at every depth of dealing."""
    monkeypatch.setattr(suffix, "GROUP", 2)
    monkeypatch.setattr(suffix, "HASHED_ROWS", 7)
    monkeypatch.setattr(suffix, "SORTED_ROWS", 5)
    texts = corpus(7, 40)
    check(suffix.without_repeats(docs_of(texts).repartition(2)), texts)


def test_a_passage_of_very_many_documents(spark, docs_of):
    """2,000 documents share a passage with ever different surroundings; some share more than it, and one text holds it twice."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(1, 8)))
    passage = " ".join(word() for _ in range(50))
    texts = []
    for k in range(2000):
        before, after = (" ".join(word() for _ in range(draw.randint(0, 25))) for _ in range(2))
        if k % 7 == 0 and texts:
            before = texts[draw.randrange(len(texts))].split(passage)[0][-draw.randint(1, 90):]
        if k % 11 == 0 and texts:
            after = texts[draw.randrange(len(texts))].split(passage)[-1][: draw.randint(1, 90)]
        texts.append(before + passage + after)
    texts[1500] = passage + "x" + passage
    check(suffix.without_repeats(docs_of(texts).repartition(4)), texts)


@pytest.mark.parametrize("length", [1, 2, 20, 25, 47])
def test_other_lengths(spark, docs_of, monkeypatch, length):
    monkeypatch.setattr(suffix, "GROUP", 3)
    texts = [t for t in corpus(9, 25) if len(t or "") < 600]
    check(suffix.without_repeats(docs_of(texts), length=length), texts, length)


def test_extra_columns_with_the_names_inside(spark, docs_of):
    names = ["doc", "_doc", "shift", "_shift", "runs", "asked", "row", "group", "content", "place", "first", "last", "data", "anchor", "kept", "n_bytes", "a.b"]
    long = "".join(random.Random(5).choices("abcdefgh", k=300))
    docs = docs_of([long, "y" + long])
    for name in names:
        docs = docs.withColumn(name, suffix.F.lit(f"own {name}"))
    rows = suffix.cut_rows(docs).collect()
    assert sorted((r.row.doc_id, r.n_removed) for r in rows) == [(0, 0), (1, 300)]
    assert all(r.row[name] == f"own {name}" for r in rows for name in names)


def test_other_columns_nulls_and_repeated_rows(spark, docs_of):
    long = "".join(random.Random(5).choices("abcdefgh", k=300))
    docs = docs_of([long, long + "x"])
    docs = docs.union(docs.where("doc_id = 0")).union(docs_of([long]).withColumn("doc_id", suffix.F.lit(None).cast("long")))
    rows = [(r.doc_id, r.n_removed, bytes(r.kept).decode()) for r in suffix.without_repeats(docs).select("doc_id", "n_removed", "kept", "n_chars").collect()]
    assert sorted(rows, key=str) == sorted([(0, 0, long), (0, 0, long), (1, 300, "x"), (None, 300, "")], key=str)
    assert suffix.without_repeats(docs_of([])).count() == 0


def test_rows_without_an_id_are_documents_of_their_own(spark, docs_of):
    draw = random.Random(6)
    passage, other, more = ("".join(draw.choices("abcdefgh", k=k)) for k in (300, 250, 500))
    docs = docs_of(["start " + passage])
    unnamed = docs_of([other + passage, more + other[:50], other + passage]).withColumn("doc_id", suffix.F.lit(None).cast("long"))
    rows = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in suffix.without_repeats(docs.union(unnamed)).collect()]
    assert sorted(rows, key=str) == sorted([(0, 306, 0, "start " + passage), (None, 550, 300, other), (None, 550, 300, other), (None, 550, 0, more + other[:50])], key=str)


def test_digest(spark, docs_of):
    from trafficlens.llm import queries

    texts = corpus(4)[:30]
    expected = brute(texts, 100)
    for row in queries.substring_digest(docs_of(texts)).collect():
        assert row.kept_sha256 == hashlib.sha256(expected[row.doc_id][3]).hexdigest()
