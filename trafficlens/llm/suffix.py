"""Exact substring dedup: bytes that a string of ``length`` bytes covers which also starts earlier.

1. Segments. The least hash of the short grams inside a window of ``length`` bytes depends on the
   window alone, so equal windows have the same least hash. A maximal run of window starts with one
   least hash is a segment; segments of one hash form a group, and only windows of one group can be
   equal.
2. Equal segments. Groups are dealt out by hash. Of equal segments all but the earliest repeat as a
   whole. Equal segments of a task's documents meet before they are shuffled.
3. Suffix arrays. Different segments of a group, and those that may repeat themselves, are one text. Its suffix array is made by induced
   sorting and the permuted common prefixes tell which windows are equal; all but the earliest repeat.
   Groups of one size are sorted in step.
4. Wide groups. Beyond ``GROUP`` different segments, as at the edges of a passage that very many documents share, a
   group is dealt out again by longer anchors until its parts are narrow: windows are told apart by how far the least gram stands from
   their start, in ranges of a third of the places each time, and all windows of a range hold the same bytes about the gram, which are
   the anchor of the part. Steps 2 and 3 then work on the parts. A segment stays one row for each range; only the range in which the passage ends
   needs the next, finer one.

Rows are read in order of group and content, so a task holds a bounded number of them, however wide a group is.

The runs of repeated starts of a document then give its removed bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import POWERS, checkpointed, prefix_hashes, span_hashes, splitmix, text_slices
from trafficlens.llm.sais import common_prefixes, suffix_arrays

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of a gram.
GRAM = 20
#: Window starts of a segment at most.
RUN = 1024
#: Different segments of a group that are sorted together at most; wider groups are dealt by longer anchors first.
GROUP = 128
#: Symbols of the texts that are sorted in step, and rows that are read for that.
CELLS = 1_000_000
SORTED_ROWS = 40_000
#: Rows of hashes that are looked at together, and that meet in a task before they are shuffled.
HASHED_ROWS = 200_000
MET_ROWS = 400_000
_BYTE = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(99))
#: Parts that the places of a gram are split into when a group is dealt by longer anchors.
PARTS = 3
#: What a row is: starts that repeat; a segment by its hash; one whose bytes are asked for, in a narrow or a wide group; a segment that may repeat itself.
REPEAT, EQUAL, SORT, WIDE, LOOP = range(5)
#: ``place`` holds the first start, the number of starts after it, and what the row is.
ROW = "group long, content long, doc long, place long"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
#: Added to the starts of a document without an id; its ``doc`` is a hash of its text, and may be another one's id.
UNNAMED = 1 << 38


def _batch(kind: np.ndarray, group: np.ndarray, content: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    place = (first << 24) | ((last - first) << 4) | kind
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (group, content, doc, place)], names=_NAMES)


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """kind, group, content, doc, first and last of rows."""
    group, content, doc, place = (table.column(k).to_numpy() for k in _NAMES)
    first = place >> 24
    return place & 15, group, content, doc, first, first + ((place >> 4) & 0xFFFFF)


def _kind() -> Column:
    return F.col("place").bitwiseAND(F.lit(15))


def _first() -> Column:
    return F.shiftright("place", 24)


def _last() -> Column:
    return _first() + F.shiftright("place", 4).bitwiseAND(F.lit(0xFFFFF))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    rows = np.concatenate([values, np.full(-len(values) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _grams(prefix: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams of the bytes with these prefix hashes."""
    return splitmix((prefix[gram:] - prefix[:-gram]) * POWERS.grown(len(prefix)).down[: len(prefix) - gram])


def segments(raw: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Group, content hash, text number, first and last window start (in the text) of all segments, and whether the least gram stands in it twice."""
    limits = np.append(0, np.cumsum([len(r) for r in raw]))
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    gram = min(GRAM, length)
    prefix = prefix_hashes(_BYTE[data])
    grams = _grams(prefix, gram)
    least = _sliding_least(grams, length - gram + 1)
    text = np.repeat(np.arange(len(raw)), np.diff(limits))
    starts = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1])]))
    ends = np.append(starts[1:], len(least))
    ends = np.minimum(ends, limits[text[starts] + 1] - length + 1)  # windows stay inside their text
    starts, ends = starts[ends > starts], ends[ends > starts]
    parts = -(-(ends - starts) // RUN)
    if parts.max(initial=1) > 1:
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole_ends = np.repeat(ends, parts)
        starts = np.repeat(starts, parts) + number * RUN
        ends = np.minimum(starts + RUN, whole_ends)
    owner = text[starts]
    # places of grams that are the least of some window; of those next to each other, the equal ones that no window start parts
    span = length - gram + 1
    most = ~_sliding_least(np.concatenate([np.full(span - 1, ~np.uint64(0)), ~least, np.full(span - 1, ~np.uint64(0))]), span)
    chosen = np.flatnonzero(most == grams)
    twice = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= span))
    value = grams[chosen[twice]]
    low = np.searchsorted(starts, chosen[twice + 1] - span + 1, side="right") - 1
    high = np.searchsorted(starts, chosen[twice], side="right") - 1
    loops = np.zeros(len(starts), bool)
    for k in range(int((high - low).max(initial=-1)) + 1):
        at = np.clip(low + k, 0, np.maximum(high, 0))
        loops[at[least[starts[at]] == value]] = True
    return least[starts], span_hashes(prefix, starts, ends + length - 1), owner, starts - limits[owner], ends - 1 - limits[owner], loops


def _first_of_equal(group: np.ndarray, content: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by content and place, and for each place in it whether the row repeats an earlier one."""
    order = np.lexsort((first, doc, first >= UNNAMED, content, group))
    g, c, d, f = group[order], content[order], doc[order], first[order]
    fresh = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])) if len(g) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0))
    # the same place twice is a repeated row, not a repeated string
    return order, ~fresh & ((d != d[head]) | (f != f[head]))


def _joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Rows of the starts that repeat; runs that touch are one row, up to half a million starts."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    begin = np.flatnonzero(np.concatenate([np.ones(min(len(doc), 1), bool), (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1) | (first[1:] >> 19 != first[:-1] >> 19)]))
    end = np.append(begin[1:], len(doc))[: len(begin)] - 1
    none = np.zeros(len(begin), np.int64)
    # any group will do; neighbours in a document need not meet
    return _batch(np.full(len(begin), REPEAT), splitmix((doc[begin] ^ (first[begin] << 20)).view(np.uint64)).view(np.int64), none, doc[begin], first[begin], last[end])


def _once(kind: np.ndarray, group: np.ndarray, content: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the earliest of equal segments, and of the starts that repeat, among the rows given."""
    order, repeats = _first_of_equal(group, content, doc, first)
    at = order[repeats]
    yield _joined(doc[at], first[at], last[at])
    at = order[~repeats]
    yield _batch(kind[at], group[at].view(np.int64), content[at].view(np.int64), doc[at], first[at], last[at])


def _doc_key() -> Column:
    """The doc_id; without one, a hash of the text, so that only equal texts are one document."""
    return F.coalesce(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))


def _shift() -> Column:
    return F.when(F.col("doc_id").isNull(), F.lit(UNNAMED)).otherwise(F.lit(0)).cast("long")


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """Rows of all segments; of equal ones among some hundred thousand of a task, only the earliest is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for part, texts in text_slices(batches):
            group, content, owner, first, last, loops = segments([t.encode() for t in texts], length)
            doc, shift = part.column(0).to_numpy()[owner], part.column(1).to_numpy()[owner]
            held.append((np.where(loops, LOOP, EQUAL), group, content, doc, first + shift, last + shift))
            size += len(group)
            if size >= MET_ROWS:
                yield from _once(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if held:
            yield from _once(*(np.concatenate(x) for x in zip(*held)))

    return docs.select(_doc_key().alias("doc"), _shift().alias("shift"), "text").mapInArrow(run, ROW)


class _Groups:
    """Walks a stream of rows in order of group and content, in pieces of bounded size.

    Each step gives the rows that need no look, those that repeat an earlier one of equal content, and the earliest ones of each content:
    of groups of at most ``most`` contents, whole, and of wider ones, as they come.
    """

    def __init__(self, rows: int, most: int) -> None:
        self.rows, self.most = rows, most
        self.wide: int | None = None  # the group that the last piece ended in, once it is known to be wide

    def steps(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table, pa.Table, pa.Table]]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= self.rows:
                *found, rest = self._step(pa.Table.from_batches(held), False)
                yield tuple(found)
                held, size = rest.to_batches(), 0
        if held:
            yield tuple(self._step(pa.Table.from_batches(held), True)[:4])

    def _step(self, table: pa.Table, at_end: bool) -> tuple[pa.Table, ...]:
        kind, group, content, doc, first, _ = _columns(table)
        done = kind == REPEAT
        look = np.flatnonzero(~done)
        order, repeats = _first_of_equal(group[look], content[look], doc[look], first[look])
        order = look[order]
        g, c = group[order], content[order]
        fresh = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])) if len(g) else np.zeros(0, bool)
        earliest, g = order[fresh], g[fresh]
        index = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1 if len(g) else np.zeros(0, np.int64)
        wide = (np.bincount(index)[index] > self.most) | (g == self.wide if self.wide is not None else False) if len(g) else np.zeros(0, bool)
        later = np.zeros(len(g), bool)
        self.wide = None
        if not at_end and len(g):
            # the last group may go on: a wide one waits with its last content only, another one as a whole
            if wide[-1]:
                later[-1], self.wide = True, int(g[-1])
            else:
                later = g == g[-1]
        return (table.filter(pa.array(done)), *(table.take(pa.array(x)) for x in (order[repeats], earliest[~wide & ~later], earliest[wide & ~later], earliest[later])))


def _rows(table: pa.Table, kind: int) -> pa.RecordBatch:
    """The rows' hashes and places, as rows of another kind."""
    _, *columns = _columns(table)
    return _batch(np.full(table.num_rows, kind), *columns)


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group", "content")


def _resolved(rows: DataFrame) -> DataFrame:
    """Repeats among rows of equal content, and requests for the bytes of what else is in their groups."""
    most = GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, repeats, narrow, wide in _Groups(HASHED_ROWS, most).steps(batches):
            yield _rows(done, REPEAT)
            _, _, _, doc, first, last = _columns(repeats)
            yield _joined(doc, first, last)
            group, looping = narrow.column("group").to_numpy(), _columns(narrow)[0] == LOOP
            index = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1 if len(group) else np.zeros(0, np.int64)
            ask = (np.bincount(index)[index] > 1) | (np.bincount(index, weights=looping)[index] > 0) if len(group) else np.zeros(0, bool)
            yield _rows(narrow.filter(pa.array(ask)), SORT)
            yield _rows(wide, WIDE)

    return _by_group(rows).mapInArrow(run, ROW)


def repeats_of(group: np.ndarray, doc: np.ndarray, first: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """doc, first and last of the runs of window starts that repeat an earlier window of their group.

    Rows are ordered by group, doc (those without an id last), first, so earlier windows stand earlier in a group's text. In it, segments end with a mark.
    """
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    sizes = np.add.reduceat(np.array([len(d) + 1 for d in data], np.int64), bounds[:-1]) + 1
    largest_first = np.argsort(-sizes, kind="stable")
    batch = np.cumsum(sizes[largest_first]) // CELLS
    found = []
    for chosen in np.split(largest_first, np.flatnonzero(np.diff(batch)) + 1):
        rows = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in chosen])
        found.append(_sorted_texts(rows, sizes[chosen], np.diff(bounds)[chosen], doc, first, data, length))
    return tuple(np.concatenate(x) for x in zip(*found))


def _sorted_texts(rows: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, doc: np.ndarray, first: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """:func:`repeats_of` for texts of the given sizes, of so many of the ``rows`` each, sorted in step."""
    lengths = np.array([len(data[k]) for k in rows.tolist()])
    # a mark of one symbol behind each segment, one more behind each text
    closing = np.zeros(len(rows), np.int64)
    closing[np.cumsum(numbers) - 1] = 1
    ends = np.cumsum(lengths + 1 + closing) - 1 - closing
    starts = ends - lengths
    plain = np.zeros(int(sizes.sum()), np.uint8)
    inside = np.ones(len(plain), bool)
    inside[ends] = False
    inside[np.cumsum(sizes) - 1] = False
    plain[inside] = np.frombuffer(b"".join([data[k] for k in rows.tolist()]), np.uint8)
    symbols = np.where(inside, plain.astype(np.int64) + 2, 0)
    symbols[ends] = 1
    arrays = suffix_arrays(symbols, sizes, 258)
    prefixes = common_prefixes(plain, arrays, sizes, length)
    # windows that lie in one segment
    valid = np.zeros(len(plain) + 1, np.int64)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + lengths - length + 1, -1)
    place = np.flatnonzero(np.cumsum(valid)[arrays] > 0)
    entries = arrays[place]
    none = np.zeros(0, np.int64)
    if not len(entries):
        return none, none, none
    # equal windows are neighbours in the suffix array, with nothing between them
    heads = np.flatnonzero(np.append(True, (prefixes[entries[1:]] < length) | (np.diff(place) > 1)))
    least = np.repeat(np.minimum.reduceat(entries, heads), np.diff(np.append(heads, len(entries))))
    at = np.sort(entries[entries != least])
    if not len(at):
        return none, none, none
    segment = np.searchsorted(starts, at, side="right") - 1
    begin = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (at[1:] != at[:-1] + 1)]))
    stop = np.append(begin[1:], len(at)) - 1
    row = rows[segment[begin]]
    shift = first[row] - starts[segment[begin]]
    return doc[row], at[begin] + shift, at[stop] + shift


def _shift_of(first: Column) -> Column:
    return F.when(first >= UNNAMED, F.lit(UNNAMED)).otherwise(F.lit(0)).cast("long")


def widths(length: int) -> list[int]:
    """Sizes of the ranges of places of the least gram in a window, from a part of all to one."""
    width = length - min(GRAM, length) + 1
    out = []
    while width > 1 or not out:
        width = -(-width // PARTS)
        out.append(width)
    return out


def parts_of(group: int, raw: bytes, grams: np.ndarray, first: int, last: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """First start, offset of the anchor from it, and bytes of the runs of a segment's windows with the same leftmost least gram."""
    span = length - min(GRAM, length) + 1
    begin = first
    for place in (np.flatnonzero(grams[first : last + span] == np.int64(group).view(np.uint64)) + first).tolist():
        end = min(last, place)
        if end >= begin:
            yield begin, place - begin, raw[begin : end + length]
            begin = end + 1


def dealt(first: int, offset: int, data: bytes, width: int, length: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """Group, content, first start, last start, anchor offset and bytes of a run's windows, by the range that their anchor offset is in.

    All windows of a range have the same bytes about the gram: their hash is the group. ``data`` holds windows whose anchor stands ``offset``, ``offset`` - 1, ... behind their start.
    """
    gram = min(GRAM, length)
    span = length - gram + 1
    least = offset - (len(data) - length)
    for low in range(least // width * width, offset + 1, width):
        high = min(low + width, span) - 1
        a, b = offset - min(high, offset), offset - max(low, least)
        part = data[a : b + length]
        anchor = data[offset - low : offset + gram + span - 1 - high]
        yield (_signed(xxhash.xxh64_intdigest(anchor, low * 1024 + width)), _signed(xxhash.xxh64_intdigest(part)), first + a, first + b, offset - a, part)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: ``anchor`` is the offset of a part's anchor, or less than 0 for a whole segment.
LONG_ROW = f"{ROW}, anchor int, data binary"


def _long_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of group, content, doc, first, last, anchor and bytes."""
    columns = list(zip(*rows)) or [[]] * 7
    group, content, doc, first, last = (np.array(x, np.int64) for x in columns[:5])
    short = _batch(np.full(len(rows), SORT), group, content, doc, first, last)
    return pa.RecordBatch.from_arrays([*short.columns, pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.binary())], names=[*_NAMES, "anchor", "data"])


def _lengthened(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], names=[*_NAMES, "anchor", "data"])


def _with_bytes(keyed: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Segments of narrow groups with their bytes, those of wide groups dealt by their first, shortest anchors.

    ``keyed`` comes whole, so that its shuffle by document is the one that :func:`cut_rows` uses again.
    """
    by_doc = asked.withColumn("shift", _shift_of(_first())).groupBy("doc", "shift").agg(F.collect_list(F.struct(
        _kind().alias("kind"), "group", "content", (_first() - F.col("shift")).alias("first"), (_last() - F.col("shift")).alias("last"))).alias("asked"))
    texts = keyed.join(by_doc, (F.col("_doc") == F.col("doc")) & (F.col("_shift") == F.col("shift")))
    width = widths(length)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, slice_texts in _row_texts(batches):
            docs, shifts, lists = (part.column(part.schema.get_field_index(k)).to_pylist() for k in ("_doc", "_shift", "asked"))
            out: list[tuple] = []
            for doc, shift, text, wanted in zip(docs, shifts, slice_texts, lists):
                raw = text.encode()
                grams = None
                for x in wanted:
                    group, first, last = x["group"], x["first"], x["last"]
                    if x["kind"] == SORT:
                        out.append((group, x["content"], doc, first + shift, last + shift, -1, raw[first : last + length]))
                        continue
                    if grams is None:
                        grams = _grams(prefix_hashes(_BYTE[np.frombuffer(raw, np.uint8)]), min(GRAM, length))
                    for begin, offset, data in parts_of(group, raw, grams, first, last, length):
                        out += [(key, content, doc, a + shift, b + shift, anchor, own) for key, content, a, b, anchor, own in dealt(begin, offset, data, width, length)]
            yield _long_batch(out)

    return texts.mapInArrow(run, LONG_ROW)


def _sorted_groups(rows: DataFrame, length: int, width: int | None) -> DataFrame:
    """Repeated runs of the segments of narrow groups by suffix arrays; wide groups are dealt by anchors for ranges of ``width`` places."""
    most = GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, repeats, narrow, wide in _Groups(SORTED_ROWS, most).steps(batches):
            yield _lengthened(_rows(done, REPEAT))
            _, _, _, doc, first, last = _columns(repeats)
            yield _lengthened(_joined(doc, first, last))
            group = narrow.column("group").to_numpy()
            if len(group):
                index = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
                # a part alone has no two windows with the same anchor offset
                narrow = narrow.filter(pa.array((np.bincount(index)[index] > 1) | (narrow.column("anchor").to_numpy() < 0)))
            if narrow.num_rows:
                _, group, _, doc, first, _ = _columns(narrow)
                at = np.lexsort((first, doc, first >= UNNAMED, group))
                data = narrow.column("data").take(pa.array(at)).to_pylist()
                yield _lengthened(_joined(*repeats_of(group[at], doc[at], first[at], data, length)))
            if wide.num_rows:
                _, _, _, doc, first, _ = _columns(wide)
                found: list[tuple] = []
                for d, begin, offset, data in zip(doc.tolist(), first.tolist(), wide.column("anchor").to_pylist(), wide.column("data").to_pylist()):
                    found += [(key, content, d, a, b, anchor, own) for key, content, a, b, anchor, own in dealt(begin, offset, data, width, length)]
                yield _long_batch(found)

    return _by_group(rows).mapInArrow(run, LONG_ROW)


def _repeated_runs(docs: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """doc, shift (``UNNAMED`` where the doc_id is null), first and last of the runs of starts of repeated strings."""
    resolved = checkpointed(_resolved(_segment_rows(docs, length)))
    rows = _with_bytes(keyed, resolved.where(_kind() != REPEAT), length)
    # the last range is one place: its parts are windows, and equal ones are of one content
    for width in [*widths(length)[1:], None]:
        rows = _sorted_groups(rows, length, width)
    runs = resolved.where(_kind() == REPEAT).select("doc", "place").union(rows.where(_kind() == REPEAT).select("doc", "place"))
    runs = runs.withColumn("shift", _shift_of(_first()))
    return runs.select("doc", "shift", (_first() - F.col("shift")).alias("first"), (_last() - F.col("shift")).alias("last"))


def _row_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches whose first column is the row of a document, with the documents' texts."""
    for batch in batches:
        own = batch.column(0)
        yield from text_slices(iter([pa.RecordBatch.from_arrays([*batch.columns, own.field("text")], names=[*batch.schema.names, "text"])]))


def cut_rows(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``row`` (the whole row of ``docs``), n_bytes, n_removed, n_spans and ``kept`` of :func:`without_repeats`."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(whole, _doc_key().alias("_doc"), _shift().alias("_shift"))
    runs = _repeated_runs(docs.select("doc_id", "text"), keyed, length).groupBy("doc", "shift").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = keyed.join(runs, (F.col("_doc") == F.col("doc")) & (F.col("_shift") == F.col("shift")), "left")
    none = F.lit(None).cast("long")
    schema = docs.select(whole, none.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.lit(None).cast("string" if as_text else "binary").alias("kept")).schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _row_texts(batches):
            wanted = part.column(part.schema.get_field_index("runs")).to_pylist()
            rows = [_cut(text.encode(), runs, length) for text, runs in zip(texts, wanted)]
            if as_text:
                rows = [(*row[:3], row[3].decode(errors="ignore")) for row in rows]
            kinds = [pa.int64()] * 3 + [pa.string() if as_text else pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept``, the bytes that are left of each text.

    With ``as_text``, ``kept`` is a string, from which characters that lost some of their bytes are missing.
    A null text is empty. Earlier is a smaller doc_id, then a smaller start; null doc_ids come last,
    in the order of a hash of the text. Rows that repeat a doc_id have to repeat its text, too; they are one document
    and give repeated rows. Rows without a doc_id are one document where their texts are equal. Other columns
    stay, whatever their names, but for those of the four new ones; :func:`cut_rows` keeps these too. No rows give no rows.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    return cut_rows(docs, length, as_text).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *new)


def _cut(raw: bytes, runs: list[dict] | None, length: int) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs and what is left of a text."""
    if not runs:
        return len(raw), 0, 0, raw
    spans: list[list[int]] = []
    for first, last in sorted((x["first"], x["last"]) for x in runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    left, at = [], 0
    for a, b in spans:
        left.append(raw[at:a])
        at = b
    kept = b"".join([*left, raw[at:]])
    return len(raw), len(raw) - len(kept), len(spans), kept
