import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from trafficlens.llm import pii


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def only_digits(text):
    return re.sub("[^0-9]", "", text)


#: The contract's own forms, word for word, with its conditions.
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m)) <= 15),
}


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (form, ok) in enumerate(PLAIN.values()) for m in re.finditer(form, text) if ok(m[0])]
    return sorted(spans)


def draw_texts(n, seed):
    draw = random.Random(seed)
    bits = ["a@b.c", "x%y@z-1.example.com", "@", ".", "é", "𝄞", " ", "\n", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4041894974608795", "4111-1111-1111-1112", "12 ",
            "+49 (30) 1234-5678", "+1", "-", "7", "42", "word", "+", "999999999999999999999", ".5.6.7.8"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_forms(spark, docs_of):
    texts = draw_texts(600, 6) + [None, "", "word " * 20_000, "7" * 20_000, "a@b.c_d@e.f%@g@h.i j@k.l@m.n"]
    rows = pii.digest(pii.sanitised(docs_of(texts))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = brute(texts[row.doc_id] or "")
        kinds = Counter(k for _, k, _ in spans)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [kinds[k] for k in range(4)], texts[row.doc_id]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), texts[row.doc_id]
        assert set(text.split(",")) - {""} <= set(row.spans.split(","))
    assert pii.digest(pii.sanitised(docs_of([]))).count() == 0


def words_of(text):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text or "")]


def brute_terms(rows):
    """Spans of disclosing terms of each row, from loops over all documents and pairs."""
    texts = [t for _, t in rows]
    n = sum(t is not None for t in texts)
    n_term, n_entity, n_pair, held = Counter(), Counter(), Counter(), []
    for text in texts:
        entities = {(kind, text[a:b].lower()) for a, kind, b in brute(text or "")}
        terms = {w for _, _, w in words_of(text)}
        held.append((entities, terms))
        n_term.update(terms), n_entity.update(entities), n_pair.update((e, t) for e in entities for t in terms)
    out = []
    for text, (entities, terms) in zip(texts, held):
        flagged = set()
        for e in entities:
            share = n_entity[e] / n
            for t in terms:
                p = (n_pair[e, t] + pii.PRIOR * share) / (n_term[t] + pii.PRIOR)
                if p >= 2 ** -pii.RESIDUE and math.log2(p / share) >= pii.GAIN:
                    flagged.add(t)
        outside = text or ""
        for a, _, b in brute(outside):
            outside = outside[:a] + " " * (b - a) + outside[b:]
        out.append({f"term:{a}:{b}" for a, b, w in words_of(outside) if w in flagged})
    return out


def found_terms(frame):
    out = defaultdict(list)
    for row in pii.digest(pii.sanitised(frame)).collect():
        out[row.doc_id].append({s for s in row.spans.split(",") if s.startswith("term")})
    return out


def test_terms_by_brute_force(spark, docs_of):
    draw = random.Random(7)
    common = [f"common{c}" .replace("0", "a") for c in "abcdefgh"]
    texts = []
    for k in range(120):
        filler = [draw.choice(common) for _ in range(30)]
        if k % 4 == 0:
            filler[15:15] = ["Smithson", "wrote", f"from p{k % 3}@mail.example.com", draw.choice(common), f"unique{'xyz'[k % 3]}", "or", "41"]
        if k % 10 == 0:
            filler += ["or", "Ärger", "41" if k % 20 else "é9"]
        texts.append(" ".join(filler))
    texts += [None, "", "Smithson alone", texts[4], texts[4]]
    expected = brute_terms(list(enumerate(texts)))
    assert any(expected)
    for doc_id, (spans,) in found_terms(docs_of(texts)).items():
        assert spans == expected[doc_id]


def test_rare_entities_and_far_terms(spark, docs_of):
    """An entity in one document; a term 500 characters away; a term of two letters; a word that others use stays."""
    filler = "plain words that all documents use again and again "
    texts = [filler * 3 for _ in range(60)]
    texts[7] = "Quentin " + filler * 12 + "a@b.co " + filler + "Xy " + filler
    found = found_terms(docs_of(texts))
    far = texts[7].index("Xy")
    assert texts[7].index("a@b.co") > 500
    assert found[7] == [{"term:0:7", f"term:{far}:{far + 2}"}]
    assert all(spans == [set()] for k, spans in found.items() if k != 7)
    text = {r.doc_id: r.text for r in pii.masked(pii.sanitised(docs_of(texts))).collect()}
    assert text[7] == texts[7].replace("Quentin", "[TERM]").replace("Xy", "[TERM]").replace("a@b.co", "[EMAIL]")


def test_repeated_and_unnamed_rows(spark):
    rows = [(1, "Ann 1.2.3.4 here"), (1, "Ann 1.2.3.4 here"), (1, "other"), (None, "Bob b@c.de here"), (None, "here"), (2, None)] + [(k, "here and there") for k in range(10, 30)]
    expected = brute_terms(rows)
    found = found_terms(spark.createDataFrame(rows, "doc_id long, text string"))
    for doc_id in {d for d, _ in rows}:
        assert sorted(map(sorted, found[doc_id])) == sorted(sorted(e) for (d, _), e in zip(rows, expected) if d == doc_id)


def test_long_runs(spark, docs_of):
    """Runs that a backtracking or recursive search would die of; what they hold is known."""
    known = [("a@b" + ".c" * 100_000, "email:0:200003"), ("a@b" + ".c-" * 50_000 + "_", "email:0:150003"), ("%" * 200_000 + "@", ""), ("x" * 200_000 + "@-", ""),
             ("+4" + "-1" * 50_000, ""), ("+4" + "(" * 100_000, ""), ("1" * 300_000, ""), ("1.2" + ".7" * 3, "ip:0:7"), ("1 " * 100_000, ""), ("9" * 200_000 + ".9.9.9", "")]
    for row in pii.digest(pii.sanitised(docs_of([t for t, _ in known]))).collect():
        assert row.base_sha256 == hashlib.sha256(known[row.doc_id][1].encode()).hexdigest(), row.doc_id


def test_many_spans_in_a_text(spark, docs_of):
    text = "x a@b.c y " * 4_000
    row = pii.masked(pii.sanitised(docs_of([text] + ["x y"] * 30))).where("doc_id = 0").collect()[0]
    assert row.text == text.replace("a@b.c", "[EMAIL]")


def test_extra_columns_with_the_names_inside(spark, docs_of):
    names = ["forms", "terms", "whole", "_whole", "words", "entities", "entity", "term", "row", "_doc", "_text", "n", "a.b"]
    docs = docs_of(["mail a@b.co now", None])
    for name in names:
        docs = docs.withColumn(name, pii.F.lit(f"own {name}"))
    rows = pii.masked(pii.sanitised(docs)).collect()
    assert len(rows) == 2 and all(r[name] == f"own {name}" for r in rows for name in names)


@pytest.mark.parametrize("text", ["mail a@b.co or 1.2.3.4 now", "+49 30 12345678", "plain", None, ""])
def test_masks(spark, docs_of, text):
    row = pii.masked(pii.sanitised(docs_of([text]))).collect()[0]
    spans = brute(text or "")
    expected = text
    for start, kind, end in reversed(spans):
        expected = expected[:start] + pii.MASKS[pii.KINDS[kind]] + expected[end:]
    assert row.text == expected and row.n_chars == (None if text is None else len(text))
