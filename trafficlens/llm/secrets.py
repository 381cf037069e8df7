r"""Secret scans: fixed forms, and windows of high Shannon entropy.

A candidate string is a long run of characters that keys are made of. A window slides over it;
the counts of its characters, and so its entropy, are updated by the one character that leaves and the one
that enters. Thresholds depend on the character class: hexadecimal, base 64, or letters of both cases. Windows
above it are joined to spans. What an allow-list names is suppressed: a whole candidate, or a part between
its separators, the rest of it being scanned. So are classes that prose has too (letters of one case only, digits only).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trafficlens.llm.common import text_slices

#: Fixed forms, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_letters")
MIN_VALUE, MIN_ACCESS = 6, 20

#: Width of the window, and bits of entropy by class that a window of a secret has at least.
WINDOW = 20
BITS = {"entropy_hex": 3.0, "entropy_base64": 3.85, "entropy_letters": 3.85}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: An identifier, which has separators inside, and a part between separators.
IDENTIFIER = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
PART = re.compile(rf"(?<![A-Za-z0-9+]){IDENTIFIER}(?![A-Za-z0-9+])|[A-Za-z0-9+]+")
#: Fixed forms of strings that look random and are not secret: identifiers, alphabets and placeholders in a part, paths of words
#: (of one case, or capitalised), ruled lines.
ALLOWED = (
    IDENTIFIER,
    r"(?i:[A-Z0-9+]*(abcdefghijkl|0123456789|qwertyuiop|example|placeholder|lorem)[A-Z0-9+]*)",
    r"[/_-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[/_-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[/_-]*[0-9]{0,4}",
    r"[=+/_-]+",
)
_HEX_BYTES = bytes(ord("h") if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_KEY_BYTES = bytes(ord("k") if CANDIDATE.match(chr(b) * WINDOW) else 32 for b in range(128)) + b" " * 128
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed forms."""
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"h" * 24 in text.encode().translate(_HEX_BYTES):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def high_windows(text: str, bits: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Joined spans of the windows whose entropy is ``bits`` or more."""
    counts: dict[str, int] = {}
    total = 0.0  # of c * log2(c); a window's entropy is log2(width) - total / width
    most = (math.log2(width) - bits) * width + 1e-9
    spans: list[tuple[int, int]] = []
    for k, character in enumerate(text):
        if k >= width:
            old = text[k - width]
            c = counts[old]
            counts[old] = c - 1
            total += _C_LOG_C[c - 1] - _C_LOG_C[c]
        c = counts.get(character, 0)
        counts[character] = c + 1
        total += _C_LOG_C[c + 1] - _C_LOG_C[c]
        start = k - width + 1
        if start >= 0 and total <= most:
            if spans and start <= spans[-1][1]:
                spans[-1] = spans[-1][0], k + 1
            else:
                spans.append((start, k + 1))
    return spans


def _kind_of(run: str) -> str | None:
    """The character class of a candidate, or none if prose has it too."""
    lower, upper, digit = (re.search(c, run) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    if digit and (lower or upper):
        return "entropy_hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) else "entropy_base64"
    return "entropy_letters" if lower and upper else None


def _left(run: str, allowed: list[re.Pattern]) -> Iterator[tuple[int, str]]:
    """Place and characters of what the allow-list leaves of a candidate. Parts shorter than a window can't hide one."""
    at = 0
    for part in PART.finditer(run):
        if len(part[0]) >= WINDOW and any(p.fullmatch(part[0]) for p in allowed):
            yield at, run[at : part.start()]
            at = part.end()
    yield at, run[at:]


def entropy_spans(text: str, allowed: list[re.Pattern]) -> list[Span]:
    """Spans of high entropy inside candidate strings that are not allowed."""
    found: list[Span] = []
    if b"k" * WINDOW not in text.encode().translate(_KEY_BYTES):
        return found
    for candidate in CANDIDATE.finditer(text):
        for at, run in _left(candidate[0], allowed):
            kind = _kind_of(run) if len(run) >= WINDOW else None
            if kind is None or any(p.fullmatch(run) for p in allowed):
                continue
            at += candidate.start()
            found += [(kind, at + a, at + b) for a, b in high_windows(run, BITS[kind])]
    return found


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(text: str, allowed: list[re.Pattern]) -> tuple[list[Span], list[Span]]:
    """Spans of the fixed forms, and those that only entropy shows."""
    base = base_spans(text)
    more = [s for s in entropy_spans(text, allowed) if not any(a <= s[1] and s[2] <= b for _, a, b in base)]
    return base, more


def secret_spans(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row for each document: counts and digest of the fixed forms, and all spans in code points.

    A null or empty text has no spans. Rows are scanned one by one: repeated rows give repeated
    results, a null doc_id stays null, other columns are not read. There is no shuffle.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(p) for p in allowed]
        for part, texts in text_slices(batches):
            rows = []
            for text in texts:
                base, more = scan(text, patterns)
                kinds = [s[0] for s in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + more)))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
