"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents become ids; only what exceeds a sequence is cut. Pieces are dealt into groups of about ``GROUP_PIECES`` (the number of
groups follows the number of pieces), each group is packed by best fit, longest first, and local search then moves
pieces, or exchanges one for one or two for one (either way), into bins at least as full, each step raising the sum of squared fills. A
group ends when it has as few bins as its tokens fill, or when no move or exchange of any two of its bins helps; nothing ends it before.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import Cache, by_bytes, written
from kgloom.llm.merging import PairTable

GROUP_PIECES = 8192
CACHE_WORDS = 400_000
#: Words of code points below this are normalised here; a word with any other goes to the library whole.
PLAIN_BELOW = 0x250
PUNCTUATION = frozenset(",.;:!?")
#: One of these between a letter and white space is a match of its own, so it can be taken for a word.
LAST = "([a-z])([,.;:!?]) "
#: Differences that are looked at in one array at most.
AT_ONCE = 1 << 20


class WordIds:
    """Ids of a word-end BPE file, as the tokenizers library gives them, with a cache of words.

    No match of that file's pre-tokenizer crosses white space, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.cache: Cache = Cache(CACHE_WORDS)
        split = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split).findall
        self.odd = regex.compile(rf"[^\x00-\u{PLAIN_BELOW - 1:04x}]").search
        vocab, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner, self.last = np.array([vocab[c] for c in chars], np.int32), np.array([vocab[c + end] for c in chars], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        table = np.array([(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(merges)], np.int64).reshape(-1, 4)
        self.pairs = PairTable(*table.T)

    def _learn(self, words: list[str]) -> None:
        """Caches the ids of words. Below PLAIN_BELOW nothing composes, so such words only need lower case; their pieces are merged once each."""
        cache, split, odd = self.cache, self.split, self.odd
        # what most words are is told by three calls; the rest is looked at one by one
        pieces_, cut = {w for w in words if w.isalpha() and w.isascii() and w.islower()}, []
        for w in set(words).difference(pieces_):
            if not w.isascii() and odd(w) or "<|" in w:
                cache[w] = array("I", self.library.encode(w, add_special_tokens=False).ids).tobytes()
                continue
            low = w.lower()
            if low.isalpha():
                own = (low,)
            elif low[-1:] in PUNCTUATION and low[:-1].isalpha():
                own = (low[:-1], low[-1])
            else:
                own = tuple(split(low))
            pieces_.update(own)
            if own != (w,):
                cut.append((w, own))
        self._merge([*cache.unknown([pieces_])])
        get = cache.__getitem__
        for w, own in cut:
            cache[w] = get(own[0]) if len(own) == 1 else b"".join(map(get, own))

    def _merge(self, pieces_: list[str]) -> None:
        """Caches the ids of pieces, each of which is one match of the pre-tokenizer."""
        if not pieces_:
            return
        raw = [p.encode() for p in pieces_]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, ends = self.inner[data], np.cumsum(sizes)
        ids[ends - 1] = self.last[data[ends - 1]]
        ids, left = self.pairs.merge_flat(ids, sizes)
        got, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(left)).tolist()
        self.cache.update(zip(pieces_, [got[a:b] for a, b in zip([0, *ends], ends)]))

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        # lower case does not depend on neighbours here, so "The" and "the" need not be two words
        plain = [t.isascii() or not self.odd(t) and "İ" not in t for t in texts]
        cut = [(t.lower() if p and "<|" not in t else t).replace("\n", " ") for t, p in zip(texts, plain)]
        # words stay in Arrow, where each distinct one has a number; only those become Python's
        apart = pc.replace_substring_regex(pa.array(cut, pa.large_string()), LAST, r"\1 \2 ")
        lists = pc.split_pattern(apart, " ")
        words = lists.values.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(list(self.cache.unknown([distinct])))
        told = pa.array(list(map(self.cache.__getitem__, distinct)), pa.large_binary()).take(words.indices)
        self.cache.trim()
        _, offsets, data = told.buffers()
        ends = np.frombuffer(offsets, np.int64)[np.asarray(lists.offsets)].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_workers: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), and __n, which tells rows alike apart."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["__id", "piece", "start", "length", "ids_crc32", "__n", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _workers:
            _workers[tokenizer] = WordIds(tokenizer)
        own, n, end = _workers[tokenizer], TaskContext.get().partitionId() << 40, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_bytes(texts):
                at, rows = [], []
                for k, raw in enumerate(own.batch(texts[a:b]), a):
                    raw += end
                    for i, s in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[s : s + 4 * capacity]
                        at.append(k)
                        rows.append((i, s // 4, len(part) // 4, zlib.crc32(part), n, *[np.frombuffer(part, "<u4").tolist()] * with_ids))
                        n += 1
                cols = list(zip(*rows))
                kinds = [pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    schema = f"__id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, __n bigint" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


class Units:
    """What bins would give back in an exchange: its size, the room and number of its bin, and its items, added at the end only.

    A source that found nothing among the first so many need not look at them again, unless it changes itself.
    """

    def __init__(self) -> None:
        self.end = self.dead = 0
        self.table = np.zeros((5, 1 << 12), np.int32)  # size, room (-1: not there any more), bin, first item, second item
        self.range: dict[int, tuple[int, int]] = {}

    def drop(self, b: int) -> None:
        start, stop = self.range.pop(b, (0, 0))
        self.table[1, start:stop] = -1
        self.dead += stop - start

    def add(self, b: int, room: int, units: list[tuple[int, int, int]]) -> None:
        stop = self.end + len(units)
        while stop > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
        if units:
            own = self.table[:, self.end : stop]
            own[1], own[2] = room, b
            own[0], own[3], own[4] = np.array(units, np.int32).T
        self.range[b] = (self.end, stop)
        self.end = stop

    def shrink(self, seen: np.ndarray) -> None:
        """Takes out what is not there any more, once that is the most; seen are places, which move along."""
        if 2 * self.dead <= self.end + 4096:
            return
        there = self.table[1, : self.end] >= 0
        place = np.concatenate([[0], np.cumsum(there)])
        self.end, self.dead = int(place[-1]), 0
        self.table[:, : self.end] = self.table[:, : len(there)][:, there]
        self.range = {b: (int(place[i]), int(place[j])) for b, (i, j) in self.range.items()}
        seen[:] = place[seen]

    def best(self, source: int, free: int, out: np.ndarray, since: int) -> tuple[int, int, int] | None:
        """Gain, place in out (sizes), place here of the exchange that raises the squares most, among bins at least as full as the source."""
        size, room, owner = self.table[:3, since : self.end]
        at = np.flatnonzero((room > 0) & (room <= free) & (owner != source))
        found, step = None, max(1, AT_ONCE // max(1, len(at)))
        size, room = size[at], room[at]
        for a in range(0, len(out) if len(at) else 0, step):
            more = out[a : a + step, None] - size
            gain = np.where((more > 0) & (more <= room), more.astype(np.int64) * (more + (free - room)), 0)
            i, j = divmod(int(gain.argmax()), len(at))
            if gain[i, j] > (found[0] if found else 0):
                found = int(gain[i, j]), a + i, since + int(at[j])
        return found


class Bins:
    """Bins of one capacity; items are numbers whose sizes are given."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        some = 0  # bit f: some bin has exactly f free
        for k in sorted(range(len(self.sizes)), key=lambda k: -self.sizes[k]):
            size = self.sizes[k]
            fits = some >> size
            if fits:
                f = size + (fits & -fits).bit_length() - 1
                b = by_free[f].pop()
                if not by_free[f]:
                    some &= ~(1 << f)
                self.items[b].append(k)
            else:
                f, b = self.capacity, len(self.items)
                self.items.append([k])
                self.free.append(f)
            f -= size
            self.free[b] = f
            by_free[f].append(b)
            some |= 1 << f

    def _units(self, b: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(size, item, other item or -1) of the single pieces and of the pairs of a bin, one of each size."""
        sizes = self.sizes
        one = {sizes[k]: k for k in self.items[b]}
        twice = {sizes[k]: k for k in self.items[b] if one[sizes[k]] != k}
        two = {x + y: (k, m) for x, k in one.items() for y, m in one.items() if x < y} | {2 * x: (k, one[x]) for x, k in twice.items()}
        return [(x, k, -1) for x, k in one.items()], [(x, k, m) for x, (k, m) in two.items()]

    def _enter(self, b: int) -> None:
        for units in (self.singles, self.pairs):
            units.drop(b)
        self.seen[:, b] = 0
        if self.items[b] and self.free[b]:
            one, two = self._units(b)
            self.singles.add(b, self.free[b], [(0, -1, -1), *one])
            self.pairs.add(b, self.free[b], two)

    def _step(self, source: int) -> int | None:
        """One change that moves content out of ``source`` into another open bin, at least as full, and raises the sum of squared fills: that bin."""
        one, two = self._units(source)
        found = []
        # a piece for none, one or two, and two for one (two for none are two moves); one has been tried with all seen before
        for out, units, k in ((one, self.singles, 0), (one, self.pairs, 1), (two, self.singles, 0)):
            if out and (got := units.best(source, self.free[source], np.array([x[0] for x in out], np.int32), int(self.seen[k, source]))):
                found.append((got[0], out[got[1]][1:], units.table[2:, got[2]].tolist()))
        if not found:
            self.seen[:, source] = self.singles.end, self.pairs.end
            return None
        _, out, (t, *back) = max(found, key=lambda x: x[0])
        self._swap(source, [k for k in out if k >= 0], t, [k for k in back if k >= 0])
        return t

    def _swap(self, s: int, out: list[int], t: int, back: list[int]) -> None:
        moved = sum(self.sizes[k] for k in out) - sum(self.sizes[k] for k in back)
        self.items[s] = [k for k in self.items[s] if k not in out] + back
        self.items[t] = [k for k in self.items[t] if k not in back] + out
        self.free[s] += moved
        self.free[t] -= moved

    def improve(self) -> None:
        """Change bins, the emptiest first, while fewer bins could do and some change helps; every change makes a fuller bin fuller, so this ends."""
        least, used = -(-sum(self.sizes) // self.capacity), sum(map(bool, self.items))
        if used <= least:
            return
        self.singles, self.pairs, self.seen = Units(), Units(), np.zeros((2, len(self.items)), np.int64)
        for b in range(len(self.items)):
            self._enter(b)
        helped = True
        while helped:
            helped = False
            for source in sorted((b for b in range(len(self.items)) if self.items[b] and self.free[b]), key=lambda b: -self.free[b]):
                while self.items[source] and self.free[source] and (t := self._step(source)) is not None:
                    helped = True
                    self._enter(source)
                    self._enter(t)
                    self.singles.shrink(self.seen[0])
                    self.pairs.shrink(self.seen[1])
                if not self.items[source]:
                    used -= 1
                    if used <= least:
                        return


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Lists of places in ``sizes``, each of at most ``capacity``."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.improve()
    return [b for b in bins.items if b]


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every row.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Only documents longer than ``capacity`` are cut,
    into pieces of ``capacity``; the last may be shorter. In a sequence pieces stand gapless from 0. Repeated rows are packed
    each; a null id stays null; other columns are not read; an empty table gives an empty one.
    """
    table = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    groups = max(1, -(-table.count() // GROUP_PIECES))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [c for c in table.columns if c != "__n"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__n", ignore_index=True)
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        sizes = rows["length"].tolist()
        for i, got in enumerate(pack(sizes, capacity)):
            at = 0
            for k in got:
                sequence[k], offset[k] = (key[0] << 32) + i, at
                at += sizes[k]
        return rows[names].assign(sequence_id=sequence, offset=offset)

    schema = f"__id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids + ", sequence_id bigint, offset bigint"
    return table.withColumn("__g", F.pmod(F.xxhash64("__n"), F.lit(groups))).groupBy("__g").applyInPandas(run, schema).withColumnRenamed("__id", id_col)
