"""Suffix-array dedup: removes bytes covered by strings of ``LENGTH`` bytes that also start in a document with a smaller id.

Matches are found exactly, but no suffix array of the corpus is ever in one place. A text is a row of windows, the strings of LENGTH bytes that start in it:

1. Texts are cut into chunks of windows at local minima of a hash. A chunk whose bytes a document with a smaller id has too is removed as
   a whole, and its windows take no further part: whoever repeats them finds them under that smaller id.
2. Every other window names one place in itself, the same wherever it occurs (its minimizer, a gram of ``grams(LENGTH)`` bytes). Only windows whose
   gram two documents give can repeat.
3. Windows in a row that name one place form a segment. Segments meet under their gram's hash, equal ones count once, and each block of hashes is indexed:
   breadth-first backward extension on the block's Burrows-Wheeler transform derives the lengths of common prefixes by increasing value.
   Intervals of rows that share ``l`` bytes give those that share ``l + 1``; intervals of one document are dropped; the expansion stops at
   LENGTH, where each interval gets its smallest id.

Texts are joined to what was found about them by shuffles at every size, for that grows with the texts; AQE splits skewed ones. What meets goes in packed arrays, a row for each task and partition. A task decides what it can by itself: of what several of its own rows give, it sends one, so
that a passage in a third of all documents sends a row from each batch. A gram that more than ``MOST_SEGMENTS`` documents give would
make a block too large; its windows meet one by one, as chunks do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kgloom.llm.common import discard, written

LENGTH = 50
LEAST_LENGTH = 16
#: Windows to either side among which a chunk's first window has the smallest hash.
RADIUS = 64
#: Bytes of text for each partition of an exchange, at most.
PART_BYTES = 32 << 20
#: Bytes of segments in a block, about.
BLOCK_BYTES = 1 << 20
MOST_SEGMENTS = 200_000
#: Bytes of text worked on at once, so that the arrays stay in the processor's cache; longer texts are cut, windows kept whole.
TEXT_BYTES = 256 << 10
#: Rows with a null id come after all others.
LAST = (1 << 63) - 1
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _B
    return h ^ (h >> _U(31))


def _sliding(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row; as many as fit."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def grams(length: int) -> tuple[int, int]:
    """Bytes of a gram, and places that a window may name."""
    places = (length - 6) // 2
    return length - places + 1, places


def parts_of(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in lists of about TEXT_BYTES; each window of each text is in one of them."""
    out, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, TEXT_BYTES):
            part = t[at : at + TEXT_BYTES + length - 1]
            if out and size + len(part) > TEXT_BYTES:
                yield out
                out, size = [], 0
            out.append((i, at, part))
            size += len(part)
    if out:
        yield out


class Windows:
    """The windows of parts that are laid end to end."""

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int = LENGTH) -> None:
        self.length = length
        self.text, self.offset = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        sizes = np.array([len(p[2]) for p in parts])
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.raw = b"".join(p[2] for p in parts)
        self.n = len(self.raw)
        padded = self.raw + bytes(4 * length)
        self.data = np.frombuffer(padded, np.uint8)
        self.words = np.empty(self.n + 3 * length, _U)  # the eight bytes from each place on
        for k in range(8):
            row = self.words[k::8]
            row[:] = np.frombuffer(padded, "<u8", len(row), k)

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which text, and the place in it."""
        part = np.searchsorted(self.begin, at, "right") - 1
        return self.text[part], at - self.begin[part] + self.offset[part]

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, 128 bits of hash of the bytes that they cover (two numbers), of each chunk."""
        import xxhash

        h = (_mix(self.words[: self.n] * _A) >> _U(32)).astype(np.uint32)
        edge = np.full(RADIUS, (1 << 32) - 1, np.uint32)
        least = _sliding(np.concatenate([edge, h, edge]), RADIUS)
        at = np.flatnonzero((h < least[: self.n]) & (h < least[RADIUS + 1 : RADIUS + 1 + self.n]))
        part = np.searchsorted(self.begin, at, "right") - 1
        at = np.unique(np.concatenate([self.begin, at[at <= self.end[part] - self.length]]))
        part = np.searchsorted(self.begin, at, "right") - 1
        stop = np.minimum(np.append(at[1:], self.n), self.end[part] - self.length + 1)
        raw, more = self.raw, self.length - 1
        digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at.tolist(), (stop + more).tolist())])
        return at, stop - at, np.frombuffer(digests, "<u8").reshape(-1, 2)

    def segments(self, dead: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the gram, first window, number of windows of each segment of windows that are not among ``dead`` (text, first, number)."""
        gram, places = grams(self.length)
        letters = self.length + 1 - 2 * places
        open_ = np.zeros(self.n + 1, np.int32)
        np.add.at(open_, self.begin, 1)
        np.add.at(open_, self.end - self.length + 1, -1)
        if len(dead[0]):  # a text that is cut into parts has its dead windows in several
            order = np.argsort(dead[0], kind="stable")
            text, first, number = (x[order] for x in dead)
            low, high = np.searchsorted(text, self.text), np.searchsorted(text, self.text, "right")
            k = np.repeat(np.arange(len(self.text)), high - low)
            j = np.arange(len(k)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[k]
            room = self.end[k] - self.begin[k] - self.length + 1
            a = np.clip(first[j] - self.offset[k], 0, room)
            b = np.clip(first[j] + number[j] - self.offset[k], 0, room)
            np.add.at(open_, self.begin[k] + a, -1)
            np.add.at(open_, self.begin[k] + b, 1)
        # the window's least hash of a few letters names the place, counted from the window's start modulo places
        h = _mix((self.words[: self.n] << _U(8 * (8 - letters))) * _A) >> _U(32) << _U(32)
        least = _sliding(h | np.arange(self.n, dtype=_U), self.length - letters + 1)
        start = np.arange(len(least))
        place = start + ((least & _U((1 << 32) - 1)).astype(np.int64) - start) % places
        place[np.cumsum(open_[: len(least)]) <= 0] = -1
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        number = np.diff(np.append(cut, len(place)))
        on = place[cut] >= 0
        cut, number = cut[on], number[on]
        return self.hashed(place[cut], np.full(len(cut), gram)), cut, number

    def hashed(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64 bits of hash of ``size`` (8 at least) bytes from each place on."""
        out = size.astype(_U) * _A
        for k in range(0, int(size.max(initial=0)), 8):
            on = k < size
            word = self.words[at + np.minimum(k, size - 8)]
            out = np.where(on, _mix((out ^ word) * _A), out)
        return out


def expanded(segments: np.ndarray, windows: np.ndarray, groups: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window, smallest id) of the windows that another id's segment of the same group holds too.

    segments is a matrix of bytes, windows how many windows each row has (from its first byte on). Rows of the transform are ends of windows; at every
    level the column of preceding bytes is read for the rows still open, and its stable sort is the mapping from last to first column: two neighbours of the
    extended order share l + 1 bytes exactly if their preceding bytes agree and the rows that they extend lie in one interval of l shared bytes.
    """
    n, width = segments.shape
    data = segments.ravel()
    owner = np.repeat(np.arange(n), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = owner * width + number + length - 8  # the last eight bytes are the first level
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    last = np.ndarray((len(data),), "<u8", padded, 0, (1,))[at]
    order = np.lexsort((last, groups[owner]))
    rows, key, group = at[order], last[order], groups[owner[order]]
    divided = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]) if len(rows) else np.zeros(0, bool)
    for level in range(8, length + 1):
        # intervals of two ids at least stay open
        heads = np.flatnonzero(divided)
        if not len(heads):
            break
        own = ids[rows // width]
        low, high = np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)
        sizes = np.diff(np.append(heads, len(rows)))
        open_ = low < high
        rows = rows[np.repeat(open_, sizes)]
        if level == length:
            return rows // width, rows % width, np.repeat(low[open_], sizes[open_])
        interval = np.repeat(np.arange(int(open_.sum())), sizes[open_])
        rows = rows - 1
        preceding = data[rows]
        order = np.argsort(preceding, kind="stable")
        rows, preceding, interval = rows[order], preceding[order], interval[order]
        divided = np.concatenate([[True], (preceding[1:] != preceding[:-1]) | (interval[1:] != interval[:-1])]) if len(rows) else np.zeros(0, bool)
    none = np.zeros(0, np.int64)
    return none, none, none


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _of_group(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the value of its group's first row."""
    return values[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else values


# -- what meets: rows (p, decided, cols), where cols are packed columns, p the partition that they go to

_PACKED = "p int, decided boolean, cols array<binary>"
_PACKED_ARROW = pa.schema([("p", pa.int32()), ("decided", pa.bool_()), ("cols", pa.list_(pa.binary()))])


def packed(key: np.ndarray, columns: list[np.ndarray], n: int, decided: bool = False) -> pa.RecordBatch:
    """The columns, dealt over n partitions by the high half of the 64-bit key."""
    where = ((key.astype(_U, copy=False) >> _U(32)) * _U(n) >> _U(32)).astype(np.int32)
    order = np.argsort(where, kind="stable")
    columns = [c[order] for c in columns]
    ps, begin = np.unique(where[order], return_index=True)
    end = np.append(begin[1:], len(where))
    cols = [[c[a:b].tobytes() for c in columns] for a, b in zip(begin.tolist(), end.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(ps), pa.array([decided] * len(ps), pa.bool_()), pa.array(cols, pa.list_(pa.binary()))], schema=_PACKED_ARROW)


def unpacked(batches: Iterator[pa.RecordBatch], kinds: tuple[list, list]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns of a whole partition: those still to decide, and those decided; kinds are their types."""
    found: tuple[list, list] = ([], [])
    for batch in batches:
        for decided, cols in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found[decided].append(cols)
    return tuple([np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate(own)] for rows, own in zip(found, kinds))


def exchanged(rows: DataFrame, give, decide, schema: str, n: int) -> DataFrame:
    """Packed rows of ``give``, brought together, go to ``decide``, a partition at a time."""
    return rows.mapInArrow(give, _PACKED).repartitionById(n, F.col("p")).mapInArrow(decide, schema)


_I8, _I4, _U8 = np.dtype("<i8"), np.dtype("<i4"), np.dtype("<u8")
_CUT = "__k1 bigint, __id bigint, a int, b int"


def _cut_rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["__k1", "__id", "a", "b"])


def _sorted_later(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns (two numbers of a key, id, ...) in order, and which rows come after a smaller id of their key."""
    order = np.lexsort(columns[2::-1])
    columns = [c[order] for c in columns]
    least = _of_group(_changes(columns[0], columns[1]), columns[2])
    return columns, columns[2] > least


_MEET = ([_U8, _U8, _I8, _I8, _I4, _I4], [_I8, _I8, _I4, _I4])


def _give_later(columns: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """Of (key, key, id, k1, a, b) what this task can decide, and what it can't."""
    columns, later = _sorted_later(columns)
    yield packed(columns[0][~later], [c[~later] for c in columns], n)
    k1, own, a, b = (columns[k][later] for k in (3, 2, 4, 5))
    yield packed(_mix(k1.view(_U)), [k1, own, a, b], n, True)


def _decide_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges [a, b) of rows that come after a smaller id of their key."""
    columns, decided = unpacked(batches, _MEET)
    columns, later = _sorted_later(columns)
    yield _cut_rows(decided)
    yield _cut_rows([columns[k][later] for k in (3, 2, 4, 5)])


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Rows and values of a column of lists; a null list is an empty one."""
    column = batch.column(name)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _ranges(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, a, b of a column of lists of structs."""
    rows, values = _lists(batch, name)
    return rows, *(values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))


def _removals(rows: DataFrame, length: int, most: int) -> DataFrame:
    """__k1, __id, __cut of a written table: see removals."""
    gram, places = grams(length)
    width = length + places - 1

    def dead_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, a, b = _ranges(batch, "__dead")
        return row, a, b - a - length + 1

    def give_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1 = _column(batch, "__id"), _column(batch, "__k1")
            found = [[] for _ in _MEET[0]]
            for parts in parts_of(_texts(batch, "__text"), length):
                own = Windows(parts, length)
                first, number, key = own.chunks()
                row, at = own.places(first)
                for out, c in zip(found, (key[:, 0], key[:, 1], ids[row], k1[row], at.astype(_I4), (at + number + length - 1).astype(_I4))):
                    out.append(c)
            if found[0]:
                yield from _give_later([np.concatenate(c) for c in found], n)

    def give_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, dead, found = _column(batch, "__k1"), dead_of(batch), []
            for parts in parts_of(_texts(batch, "__text"), length):
                own = Windows(parts, length)
                h, first, _ = own.segments(dead)
                found.append((h, k1[own.places(first)[0]]))
            if not found:
                continue
            h, who = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((who, h))
            h, who = h[order], who[order]
            once = _changes(h, who)
            h, who = h[once], who[once]
            new = _changes(h)
            givers = np.diff(np.append(np.flatnonzero(new), len(h))).astype(_I4)
            yield packed(h[new], [h[new], who[new], givers], n)
            several = np.repeat(givers > 1, givers)
            yield packed(_mix(who[several].view(_U)), [who[several], h[several]], n, True)

    def decide_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k1, h) of what two texts at least give; a null k1 names a crowded h."""
        (h, who, givers), (known, known_h) = unpacked(batches, ([_U8, _I8, _I4], [_I8, _U8]))
        order = np.lexsort((who, h))
        h, who, givers = h[order], who[order], givers[order]
        new = _changes(h)
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        differ = np.bincount(group, _changes(h, who), len(heads)) > 1
        crowded = np.bincount(group, givers, len(heads)) > most
        pick = differ[group] & (givers == 1)  # the other givers have been told
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([known, who[pick]])), pa.array(np.concatenate([known_h, h[pick]]).view(_I8))], ["__k1", "h"])
        if crowded.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(int(crowded.sum()), pa.int64()), pa.array(h[heads[crowded]].view(_I8))], ["__k1", "h"])

    def wanted_segments(batch: pa.RecordBatch, column: str) -> Iterator[tuple[Windows, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, row, h, first window, place in the text, number of windows of the segments whose h the row's list has."""
        dead = dead_of(batch)
        row, values = _lists(batch, column)
        mark = lambda h, row: h ^ _mix((row + 1).astype(_U) * _A)
        want = np.sort(mark(values.to_numpy(zero_copy_only=False).view(_U), row))
        for parts in parts_of(_texts(batch, "__text"), length) if len(want) else ():
            own = Windows(parts, length)
            h, first, number = own.segments(dead)
            row, at = own.places(first)
            mine = mark(h, row)
            on = want[np.minimum(np.searchsorted(want, mine), len(want) - 1)] == mine
            yield own, row[on], h[on], first[on], at[on].astype(_I4), number[on].astype(_I4)

    def give_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1 = _column(batch, "__id"), _column(batch, "__k1")
            found = []
            for own, row, h, first, at, number in wanted_segments(batch, "__h"):
                cut = own.data[first[:, None] + np.arange(width)]
                found.append((h, own.hashed(first, number + length - 1), ids[row], k1[row], at, number, cut))
            if not found:
                continue
            columns, later = _sorted_later([np.concatenate(c) for c in zip(*found)])
            yield packed(columns[0][~later], [c[~later] for c in columns], n)
            k1, own_id, at, number = (columns[k][later] for k in (3, 2, 4, 5))
            yield packed(_mix(k1.view(_U)), [k1, own_id, at, at + number + np.int32(length - 1)], n, True)

    def give_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, k1 = _column(batch, "__id"), _column(batch, "__k1")
            for own, row, _, first, at, number in wanted_segments(batch, "__crowded"):
                k = np.repeat(np.arange(len(row)), number)
                more = np.arange(len(k)) - np.repeat(np.cumsum(number) - number, number)
                raw = own.raw
                key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[s : s + length]) for s in (first[k] + more).tolist()]), "<u8").reshape(-1, 2)
                a = (at[k] + more).astype(_I4)
                yield from _give_later([key[:, 0], key[:, 1], ids[row[k]], k1[row[k]], a, a + np.int32(length)], n)

    def index_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_U8, _U8, _I8, _I8, _I4, _I4, np.dtype((np.void, width))]
        columns, decided = unpacked(batches, (kinds, _MEET[1]))
        (h, s, ids, k1, at, number, cut), later = _sorted_later(columns)
        yield _cut_rows(decided)
        yield _cut_rows([k1[later], ids[later], at[later], at[later] + number[later] + np.int32(length - 1)])
        # equal segments once, under their smallest id; hashes of segments of one id only are left out
        new = _changes(h, s)
        pick, which = np.flatnonzero(new), np.cumsum(new) - 1
        groups = np.cumsum(_changes(h[pick])) - 1
        heads = np.flatnonzero(_changes(groups))
        if not len(heads):
            return
        low, high = np.minimum.reduceat(ids[pick], heads), np.maximum.reduceat(ids[pick], heads)
        open_ = np.flatnonzero((low < high)[groups])
        block = np.arange(len(open_)) * width // BLOCK_BYTES
        block = _of_group(_changes(groups[open_]), block)  # a hash's segments stay together
        first_row = np.append(np.flatnonzero(~later), len(later))  # rows of the smallest id of their segment
        rows_of = np.searchsorted(which[first_row[:-1]], np.arange(len(pick) + 1))
        for x in np.split(open_, np.flatnonzero(np.diff(block)) + 1) if len(open_) else ():
            p = pick[x]
            own, window, least = expanded(np.frombuffer(cut[p].tobytes(), np.uint8).reshape(len(p), width), number[p], groups[x], ids[p], length)
            on = least < ids[p][own]
            order = np.lexsort((window[on], own[on]))
            own, window = own[on][order], window[on][order]
            start = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)])[: len(own)])
            stop = np.append(start[1:], len(own))[: len(start)] - 1
            own, a, b = x[own[start]], window[start].astype(_I4), (window[stop] + length).astype(_I4)
            many = rows_of[own + 1] - rows_of[own]  # rows of one id that give the segment
            k = np.repeat(np.arange(len(own)), many)
            row = first_row[rows_of[own][k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)]
            yield _cut_rows([k1[row], ids[row], at[row] + a[k], at[row] + b[k]])

    spark = rows.sparkSession
    size = rows.agg(F.sum(F.length("__text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    gathered = lambda cuts, name: cuts.groupBy("__k1", "__id").agg(F.collect_list(F.struct("a", "b")).alias(name))
    chunks = written(gathered(exchanged(rows, give_chunks, _decide_later, _CUT, n), "__dead"), "chunks")
    alive = rows.join(chunks.hint("merge"), ["__k1", "__id"], "left").select("__k1", "__id", "__text", "__dead")
    met = written(exchanged(alive, give_grams, decide_grams, "__k1 bigint, h bigint", n), "met")
    crowded, pairs = met.where("__k1 is null").select("h").distinct(), met.where("__k1 is not null")
    some = not crowded.isEmpty()
    if some:
        pairs = pairs.join(crowded.withColumn("c", F.lit(True)), "h", "left")
    else:
        pairs = pairs.withColumn("c", F.lit(None).cast("boolean"))
    wanted = pairs.groupBy("__k1").agg(F.collect_list(F.when(F.col("c").isNull(), F.col("h"))).alias("__h"), F.collect_list(F.when(F.col("c"), F.col("h"))).alias("__crowded"))
    wanted = written(wanted, "wanted")
    discard(met)
    asked = alive.join(wanted.hint("merge"), "__k1")
    cuts = exchanged(asked.select("__k1", "__id", "__text", "__dead", "__h"), give_segments, index_segments, _CUT, n)
    if some:
        cuts = cuts.union(exchanged(asked.select("__k1", "__id", "__text", "__dead", "__crowded"), give_windows, _decide_later, _CUT, n))
    cuts = cuts.union(chunks.select("__k1", "__id", F.inline("__dead")))
    out = written(gathered(cuts, "__cut"), "cuts", keep=True)
    discard(chunks, wanted)
    return out


def removals(rows: DataFrame, length: int = LENGTH, most_segments: int | None = None) -> DataFrame:
    """__k1, __id, __cut: the ranges [a, b) of bytes to remove, of rows (__k1, __id, __text binary) that lose any. A written table.

    A row is named by __id and __k1, a chunk, segment or window by 128 bits of hash. Ranges may overlap. length is LEAST_LENGTH or more.
    """
    if length < LEAST_LENGTH:
        raise ValueError(f"length must be {LEAST_LENGTH} or more")
    return _removals(rows.where(F.length("__text") >= length), length, MOST_SEGMENTS if most_segments is None else most_segments)


def spans(texts: list[bytes], row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, a, b of the ranges of each text in order, those that touch or overlap as one."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)  # one apart, so that no range touches another text's
    begin = np.cumsum(sizes) - sizes
    start, stop = begin[row] + a, begin[row] + b
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order]) if len(order) else stop
    new = np.concatenate([[True], start[1:] > stop[:-1]])[: len(start)]
    heads = np.flatnonzero(new)
    row = row[order][heads]
    last = np.append(heads[1:], len(start))[: len(heads)] - 1
    return row, start[heads] - begin[row], stop[last] - begin[row]


def kept(texts: list[bytes], cuts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The texts without the spans."""
    out = list(texts)
    row, a, b = (x.tolist() for x in cuts)
    k = 0
    while k < len(row):
        i, at, pieces = row[k], 0, []
        while k < len(row) and row[k] == i:
            pieces.append(texts[i][at : a[k]])
            at = b[k]
            k += 1
        out[i] = b"".join([*pieces, texts[i][at:]])
    return out


def _joined(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """__row, __text (binary), __cut of every row."""
    number = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST))
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), number.alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("__text"))
    keyed = base.withColumn("__k1", F.xxhash64("__id", "__text"))
    cuts = removals(keyed.select("__k1", "__id", "__text"), length)
    return keyed.join(cuts.hint("merge"), ["__k1", "__id"], "left").select("__row", "__text", "__cut")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is an empty one. Only smaller ids count as earlier: rows of one id remove nothing from each other, and a row with
    a null id comes after all that have one. Strings are judged on the input. Repeated rows give repeated rows, other columns are
    not read, an empty table gives an empty one. Texts of any length are taken whole, in parts that share their edges.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, "__text")
            row, a, b = found = spans(texts, *_ranges(batch, "__cut"))
            removed, number = np.bincount(row, b - a, len(texts)).astype(np.int64), np.bincount(row, minlength=len(texts))
            digests = [hashlib.sha256(t).hexdigest() for t in kept(texts, found)]
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed), pa.array(number.astype(np.int64)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _joined(docs.select(f"`{id_col}`", f"`{text_col}`"), id_col, text_col, length).select(F.col(f"__row.`{id_col}`").alias("__id"), "__text", "__cut")
    return joined.mapInArrow(run, f"__id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("__id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs, all their rows and columns, with text_col less the bytes that removed_spans tells of; a code point cut in two goes whole.

    A null text stays null, an empty one empty; repeated rows stay, each with its text; an empty table gives an empty one.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, "__text")
            left = [t.decode("utf-8", "ignore") for t in kept(texts, spans(texts, *_ranges(batch, "__cut")))]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(left, pa.string())], ["__row", "__kept"])

    joined = _joined(docs, id_col, text_col, length)
    schema = StructType([joined.schema["__row"], StructField("__kept", StringType())])
    out = joined.mapInArrow(run, schema)
    return out.select(*(F.when(F.col(f"__row.`{c}`").isNotNull(), F.col("__kept")).alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in names))
