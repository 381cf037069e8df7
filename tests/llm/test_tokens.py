import hashlib
import random

import numpy as np
import pytest
import regex

public_tokenizers = pytest.importorskip("public_tokenizers")

from trafficlens.llm import bpe, packing, pretoken  # noqa: E402

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "It's a test, we'll see: 'street' ''s", "日本語のテキスト 123 été\n\n  x", "a" * 5000, "ab" * 4000 + "c", "=" * 3000 + " " * 2500 + "x", "a\x1cb 　c",
         "<|endoftext|> and <|endoftext|>", "\n", " ", "'", "x 's"]


def _library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_the_patterns():
    pattern = regex.compile(public_tokenizers.PATTERN)
    draw = random.Random(1)
    for _ in range(500):
        texts = ["".join(draw.choice("ab 'srtvelmd\n\t  é1!? 　日") for _ in range(draw.randint(0, 40))) for _ in range(3)]
        joined, starts, ends, _, bounds = pretoken.pieces(texts)
        assert [[joined[starts[k]:ends[k]] for k in range(bounds[i], bounds[i + 1])] for i in range(3)] == [pattern.findall(t) for t in texts]


def test_ids_are_the_librarys():
    draw = random.Random(2)
    texts = TEXTS + ["".join(draw.choice("abcdefgh") for _ in range(20000))]
    ids, bounds = bpe.Ids(bpe.ranks_of(MULTI)).of(texts)
    library = _library()
    for k, text in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == library.encode_ordinary(text)


def test_round_trip(spark, docs_of):
    texts = [*TEXTS, None, TEXTS[1]]
    library = _library()
    rows = {r.doc_id: r for r in bpe.bpe_round_trip(docs_of(texts), MULTI).collect()}
    for k, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(docs_of([]), MULTI).count() == 0


def test_pack_covers_every_token_with_one_open_window():
    draw = random.Random(3)
    for _ in range(100):
        lengths = [draw.choice([1, 2, 60, 128, 129, 300, 1024, 2500, draw.randint(1, 3000)]) for _ in range(draw.randint(0, 60))]
        windows = packing.pack(lengths)
        covered = {}
        for doc, start, length in sorted(p for _, window in windows for p in window):
            assert covered.get(doc, 0) == start and length > 0
            covered[doc] = start + length
        assert covered == dict(enumerate(lengths))
        sizes = [(tier, sum(p[2] for p in window)) for tier, window in windows]
        assert sum(tier != size for tier, size in sizes) <= 1 and all(size <= tier for tier, size in sizes)


def test_step_groups_are_even():
    sizes = [1024] * 300 + [512] * 100 + [128] * 200
    groups = packing.step_groups(sizes)
    totals = np.bincount(groups, weights=sizes)
    assert len(totals) == 10 and totals.max() - totals.min() <= 1024


def test_packed_sequences(spark, docs_of):
    import zlib

    from tokenizers import Tokenizer

    texts = [*TEXTS, None, TEXTS[1]]
    library = Tokenizer.from_file(JSON)
    rows = packing.packed_sequences(docs_of(texts).repartition(3), JSON).collect()
    for k, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for row in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start):
            assert row.start == at and row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(ids[at:at + row.length].tobytes())
            at += row.length
        assert at == len(ids)
    for sequence in {r.sequence_id for r in rows}:
        at = 0
        for row in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at == row.sequence_tokens <= row.tier <= 1024
    assert packing.packed_sequences(docs_of([]), JSON).count() == 0
