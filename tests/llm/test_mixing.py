import hashlib
import random
import re
from collections import defaultdict

import pytest

from trafficlens.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def draw(doc_id):
    return (int(hashlib.sha256(f"11:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def filled(total, weights, caps):
    """Shares by weight, at most the cap, what is left shared again, round by round."""
    out, free, left = {}, set(weights), total
    while free:
        unit = left / sum(weights[k] for k in free) if sum(weights[k] for k in free) else 0.0
        full = {k for k in free if caps[k] <= weights[k] * unit}
        if not full:
            return {**out, **{k: weights[k] * unit for k in free}}
        out.update({k: float(caps[k]) for k in full})
        left -= sum(caps[k] for k in full)
        free -= full
    return out


def brute(texts, sources):
    sizes = [words(t) for t in texts]
    order = sorted(set(sources), key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, x in zip(sizes, sources) if x == s) for s in order}
    target = filled(1.5 * sum(sizes), {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {s: 2 * total[s] for s in order})
    taken = {}
    for s in order:
        own = [k for k, x in enumerate(sources) if x == s]
        merit = {k: 0.5 if sizes[k] < 20 else 1.0 for k in own}
        cell = defaultdict(int)
        for k in own:
            cell[merit[k]] += sizes[k]
        share = filled(target[s], {m: m * n for m, n in cell.items()}, {m: 2 * n for m, n in cell.items()})
        expected = {m: share[m] / n if n else 0.0 for m, n in cell.items()}
        expected = {m: float(round(e)) if abs(e - round(e)) < 1e-9 else e for m, e in expected.items()}
        left = round(target[s]) - sum(int(expected[merit[k]]) * sizes[k] for k in own)

        def odds(k):
            p = expected[merit[k]] % 1
            return draw(k) / (1 - draw(k)) / (p / (1 - p))

        for k in own:
            taken[k] = int(expected[merit[k]]) * sizes[k]
        for k in sorted((k for k in own if expected[merit[k]] % 1), key=odds):
            part = max(min(left, sizes[k]), 0)
            taken[k] += part
            left -= part
    return sizes, total, target, taken


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    sources = [None if k % 11 == 0 else "hot" if k % 3 == 0 else rng.choice(["b", "a", "é", "𝄞", "z1", ""]) for k in range(400)]
    texts = [None if k % 37 == 0 else "" if k % 41 == 0 else " ".join("w%d" % rng.randrange(9) for _ in range(int(rng.paretovariate(0.8)) % 900 + (k % 5) * 8)) for k in range(400)]
    return texts + ["word " * 60_000, "one", "two\n\x0bthree"], sources + ["long", "tiny", "tiny"]


@pytest.mark.parametrize("size", [4, 8192])
def test_brute_force(docs_of, monkeypatch, corpus, size):
    monkeypatch.setattr(mixing, "BIN", size)
    texts, sources = corpus
    sizes, total, target, taken = brute(texts, sources)
    rows = mixing.mix(docs_of(texts, source=dict(enumerate(sources)))).collect()
    assert len(rows) == len(texts)
    by_source = defaultdict(int)
    for r in rows:
        s = sources[r.doc_id]
        assert (r.size, r.source_size, r.taken) == (sizes[r.doc_id], total[s], taken[r.doc_id])
        assert abs(r.target - target[s]) < 1e-3 and r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part
        by_source[s] += r.taken
    for s, n in by_source.items():
        assert abs(n - target[s]) <= 1


def test_repeats_without_ids_and_empty(spark, docs_of):
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (None, None, None), (7, "d " * 30, "x"), (7, "d " * 30, "x"), (8, "", "empty")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(table).collect()
    assert len(out) == 6 and sum(r.taken for r in out) == round(sum({r.source_size: r.target for r in out}.values()))
    assert mixing.mix(docs_of([])).count() == 0
    assert [(r.taken, r.target) for r in mixing.mix(docs_of([None, ""])).collect()] == [(0, 0.0)] * 2


def test_inclusion_follows_probability(spark):
    """Over many seeds, documents of half the merit are taken half as often."""
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id % 2 = 0, 'x y', repeat('w ', 25)) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    often = defaultdict(list)
    for seed in range(6):
        for r in mixing.mix(docs, share=0.3, seed=seed).collect():
            often[r.size].append(r.taken / r.size)
    assert abs(sum(often[2]) / len(often[2]) / (sum(often[25]) / len(often[25])) - 0.5) < 0.12


def test_mixture_has_the_words(docs_of, corpus):
    texts, sources = corpus
    docs = docs_of(texts, source=dict(enumerate(sources)))
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    got = defaultdict(int)
    for r in mixing.mixture(docs).collect():
        assert texts[r.doc_id].startswith(r.text)
        got[r.doc_id] += words(r.text)
    assert got == taken
