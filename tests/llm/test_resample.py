import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trafficlens.llm import resample


def features(text, most):
    lowered = (text or "").translate({k: k + 32 for k in range(ord("A"), ord("Z") + 1)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(rows, goal, most):
    source, target = Counter(), Counter()
    for _, text in rows:
        source.update(map(bucket, features(text, most)[1]))
    for text in goal:
        target.update(map(bucket, features(text, most)[1]))
    s, t = sum(source.values()), sum(target.values())
    out = []
    for doc_id, text in rows:
        words, found = features(text, most)
        gains = [math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    best = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(best[: len(best) * 10 // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    bits = ["Wort", "WORT", "ÄÖ", "naïve", "x1", "Ω𝄞", "-", "a_b", "it's", "\x7f", "\x00", "KK", "9" * 70, "9" * 70 + "x", "y" * 64, "y" * 65]
    return [(k, rng.choice(" \n,.").join(rng.choice(bits) + str(rng.choice(["", rng.randrange(30)])) for _ in range(rng.randrange(60)))) for k in range(n)]


@pytest.mark.parametrize("most", [1, 3])
def test_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(resample, "SLICE_BYTES", 3000)
    rows = corpus(300, most) + [(300, None), (301, ""), (302, "lang " * 50_000), (303, "z" * 300_000), (None, "ohne id " * 20), (5, "noch einmal fünf " * 30)]
    goal = [None, "", "Wort x1 naïve " * 30, "nur hier"]
    docs = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "doc_id long, text string, rank int, score double")
    target = spark.createDataFrame([(t, 0) for t in goal], "text string, n int")
    found = sorted((tuple(r) for r in resample.resampled(docs, target, ngram=most).collect()), key=repr)
    assert found == brute(rows, goal, most)


def test_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(7, "wort " * 25)] * 40, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    out = resample.resampled(docs, none).collect()
    assert sorted(r.rank for r in out if r.rank) == [1, 2, 3, 4] and len({r.score for r in out}) == 1
    assert resample.resampled(docs.limit(0), none).count() == 0


def test_table_holds_under_collisions(monkeypatch):
    """Bytes decide, even where all keys are one, or two."""
    texts = [t for _, t in corpus(60, 5)]
    plain = Counter(w for t in texts for w in features(t, 2)[1])
    for weak in (lambda x: 7, lambda x: len(x) % 2):
        monkeypatch.setattr(resample.xxhash, "xxh64_intdigest", weak)
        found = resample.grams(pa.array([*texts, None]), 2)
        table = resample.Table(found, 10_000)
        data = found.data.tobytes().decode()
        raw = found.data.tobytes()
        names = [raw[a:b].decode() for a, b in zip(found.start.tolist(), found.end.tolist())]
        assert data and Counter(names) == plain
        counted = {}
        for name, slot in zip(names, table.slots.tolist()):
            assert counted.setdefault(slot, name) == name and table.count[slot] == plain[name] and table.bucket[slot] == bucket(name)
        assert len(counted) == len(plain)


def test_sliced_batches():
    texts = pa.array(["not me", None, "Two words", "", "x"]).slice(1, 3)
    found = resample.grams(texts, 1)
    assert found.words.tolist() == [0, 2, 0] and found.data.tobytes() == b"two words " and np.array_equal(found.row, [1, 1])
