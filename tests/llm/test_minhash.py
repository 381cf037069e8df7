import random
import re

import numpy as np
import pytest

from trafficlens.llm import minhash
from trafficlens.llm.components import components


def plain_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + words]) for k in range(len(w) - words + 1)}


def reach(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def brute(texts, words, threshold=80):
    sets = [plain_set(t, words) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return [len(s) for s in sets], reach(len(sets), links)


def corpus(seed, groups=12, copies=12, size=120):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 5))) for _ in range(400)]
    texts = [None, "", " \n ", "one", "ONE", "one two", "one  two", "one\ttwo three"]
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.choice([0, 1, 2, 4, 6, 9])):
                text[draw.randrange(size)] = draw.choice(vocabulary)
            texts.append(" ".join(text))
    draw.shuffle(texts)
    return texts


def check(frame, texts, words):
    sizes, label = brute(texts, words)
    rows = {r.doc_id: r for r in frame.collect()}
    assert rows.keys() == set(range(len(texts)))
    for k in range(len(texts)):
        assert (rows[k].n_shingles, rows[k].component_id, rows[k].kept) == (sizes[k], label[k], label[k] == k), k


def test_shingles():
    texts = corpus(1)[:60]
    for words in (1, 2, 5):
        values, bounds = minhash.shingles(texts and [t or "" for t in texts], words)
        known = {}
        for k, text in enumerate(texts):
            own = values[bounds[k]:bounds[k + 1]]
            assert len(own) == len(plain_set(text, words)) and (np.diff(own.astype(object)) > 0).all()
            assert known.setdefault(frozenset(plain_set(text, words)), own.tolist()) == own.tolist()


@pytest.mark.parametrize("words", [2, 5])
def test_components_by_brute_force(spark, docs_of, words):
    texts = corpus(2)
    check(minhash.near_duplicates(docs_of(texts), words), texts, words)


def test_large_nodes(spark, docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "NODE", 24)
    monkeypatch.setattr(minhash, "PIVOTS", 4)
    monkeypatch.setattr(minhash, "DEPTH", 1)
    texts = corpus(3, groups=2, copies=90)
    check(minhash.near_duplicates(docs_of(texts), 2), texts, 2)


def test_edges(spark, docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0
    docs = docs_of(["a b c", "a b c", "x " * 100_000]).union(docs_of(["a b c"]).withColumn("doc_id", minhash.F.lit(None).cast("long")))
    rows = sorted(minhash.near_duplicates(docs, 2).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [(0, 0, True), (1, 0, False), (2, 2, True), (None, None, True)]


def test_chains(spark):
    draw = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(draw.randrange(100, 160), draw.randrange(100, 160)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
    label = reach(300, links)
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.v for r in rows} == {x for link in links for x in link}
    assert all(r.component == label[r.v] for r in rows)
