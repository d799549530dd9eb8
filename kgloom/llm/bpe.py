"""Byte-level BPE: pre-tokenisation over arrays of code points, then cached pair merging.

No regular expression looks at a text. Every code point gets a class; each class is a function from the state before it to
the state after it; the functions of up to ``BLOCK`` code points are composed by an associative scan (doubling, a table
composes two of them), the blocks' results by a walk over blocks. Where a token starts follows from the class and state at a place and
its neighbours. The slices go through a bounded cache of merged pieces, whose offsets are kept to decode any range of ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import Cache, by_bytes
from kgloom.llm.merging import PairTable

# Classes of code points. The last three are found by looking at the code points that follow.
LETTER, NUMBER, BLANK, SPACE, OTHER, END, SHORT, LONG = range(8)
# States: an apostrophe may start a contraction (FREE) or not (BOUND: the space or symbol before takes it); letters of a contraction to come.
FREE, BOUND, ONE_LEFT, TWO_LEFT = range(4)
#: After a code point of each class, by the state before it.
AFTER = {
    LETTER: (FREE, FREE, FREE, ONE_LEFT),
    NUMBER: (FREE, FREE, FREE, FREE),
    BLANK: (BOUND, BOUND, BOUND, BOUND),
    SPACE: (FREE, FREE, FREE, FREE),
    OTHER: (BOUND, BOUND, BOUND, BOUND),
    END: (FREE, FREE, FREE, FREE),
    SHORT: (ONE_LEFT, BOUND, BOUND, BOUND),
    LONG: (TWO_LEFT, BOUND, BOUND, BOUND),
}
#: Code points with the property White_Space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Steps of a scan by doubling cover so many code points.
BLOCK = 64
#: Stands after each text in an array of several; no text can hold it.
STOP = 0x110000
CACHE_PIECES = 200_000
#: Tokens of up to so many bytes are decoded from a matrix.
WIDE = 16


def _packed(after: tuple) -> int:
    return sum(s << 2 * i for i, s in enumerate(after))


#: A function of four states as eight bits, by class; THEN[f, g]: f, then g.
STEP = np.array([_packed(AFTER[c]) for c in range(8)], np.uint8)
_f = np.arange(256)
THEN = sum(((_f[None, :] >> 2 * ((_f[:, None] >> 2 * i) & 3)) & 3) << 2 * i for i in range(4)).astype(np.uint8)
_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of every code point, from the general categories of the Unicode database."""
    if not _classes:
        import regex  # not unicodedata, whose tables are older: other classes, other ids

        table = np.full(STOP + 1, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, STOP)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[WHITE] = SPACE
        table[0x20] = BLANK
        table[STOP] = END
        _classes.append(table)
    return _classes[0]


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The state before each place, from FREE at the first."""
    n = len(kinds)
    rows = -(-n // BLOCK)
    f = np.full(rows * BLOCK, STEP[END], np.uint8)
    f[:n] = STEP[kinds]
    f = f.reshape(rows, BLOCK)
    width = 1
    while width < BLOCK:
        f[:, width:] = THEN[f[:, :-width], f[:, width:]]
        width *= 2
    state, before = 0, np.empty(rows, np.uint8)
    ends = f[:, -1]
    if rows and (ends == np.array([s * 0x55 for s in range(4)])[:, None]).any(0).all():  # all constant: no walk
        before[0], before[1:] = 0, ends[:-1] & 3
    else:
        for i, g in enumerate(ends.tolist()):
            before[i] = state
            state = (g >> 2 * state) & 3
    out = np.empty((rows, BLOCK), np.uint8)
    out[:, 0] = before
    out[:, 1:] = (f[:, :-1] >> (2 * before)[:, None]) & 3
    return out.reshape(-1)[:n]


def starts(points: np.ndarray) -> np.ndarray:
    """Where tokens of the pre-tokenizer start, for code points of texts that each end with STOP (itself a start)."""
    kinds = class_table()[points]
    tick = np.flatnonzero(points == 0x27)
    if len(tick):
        more = np.concatenate([points, np.full(2, STOP, points.dtype)])
        one, two = more[tick + 1], more[tick + 2]
        kinds[tick[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        long = np.zeros(len(tick), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        kinds[tick[long]] = LONG
    state = states_before(kinds)
    plain = np.where(kinds >= SHORT, OTHER, kinds).astype(np.uint8)
    before = np.concatenate([[END], plain[:-1]]).astype(np.uint8)
    white = (plain == BLANK) | (plain == SPACE)
    white_before = np.concatenate([[False], white[:-1]])
    next_solid = np.concatenate([~white[1:] & (plain[1:] != END), [False]])
    inside = state >= ONE_LEFT
    begun = (np.concatenate([[0], state[:-1]]) == ONE_LEFT)  # the place before ended a contraction
    # a solid place goes on with what is before it if that is of its kind, or a blank
    solid = ~inside & (begun | ((plain != before) & (before != BLANK)))
    space = ~white_before | next_solid
    return np.where(plain == END, True, np.where(white, space, solid))


class Encoding:
    """Ranks of byte strings; encodes texts to ids and decodes ids, offsets included."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.cache: Cache = Cache(CACHE_PIECES)
        self._single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self._pairs: PairTable | None = None
        self._sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self._bytes = np.zeros((len(self._sizes), WIDE), np.uint8)
        for b, i in ranks.items():
            self._sizes[i] = len(b)
            self._bytes[i, : min(len(b), WIDE)] = np.frombuffer(b[:WIDE], np.uint8)

    @classmethod
    def load(cls, path: str) -> Encoding:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def pairs(self) -> PairTable:
        """Neighbours merge where their joined bytes have a rank."""
        if self._pairs is None:
            ranks = self.ranks
            found = [(x, y, i) for t, i in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None]
            left, right, into = np.array(found, np.int64).reshape(-1, 3).T
            self._pairs = PairTable(left, right, into, into)
        return self._pairs

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: of all neighbours, the two whose joined bytes rank first are joined, again and again."""
        ranks, single = self.ranks, self._single
        out = [[r] if (r := ranks.get(p)) is not None else None for p in pieces]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self.pairs().merge_rows([[single[b] for b in pieces[k]] for k in rest]), strict=True):
            out[k] = ids
        return out

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Each text's slices, as the pre-tokenizer cuts it."""
        joined = "\0".join(texts) + "\0" if texts else ""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[ends] = STOP
        at = np.flatnonzero(starts(points)).tolist()
        every = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])]
        stops = np.searchsorted(np.array(at), ends).tolist()
        # slices are wanted without the stops themselves
        return [every[a:b] for a, b in zip([0, *(s + 1 for s in stops[:-1])], stops)]

    def _fill(self, cut: list[list[str]]) -> None:
        new = list(self.cache.unknown(cut))
        for p, ids in zip(new, self.merge([p.encode("utf-8", "surrogatepass") for p in new]), strict=True):
            self.cache[p] = (" ".join(map(str, ids)), np.array(ids, np.uint32).tobytes())

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = self.pieces(texts)
        self._fill(cut)
        out = [np.frombuffer(b"".join([self.cache[p][1] for p in ps]), np.uint32).tolist() for ps in cut]
        self.cache.trim()
        return out

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and, one more than ids, the byte offsets at which they start."""
        ids = self.encode_batch([text])[0]
        return ids, np.cumsum([0, *(len(self.tokens[i]) for i in ids)])

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        size = self._sizes[ids]
        if len(ids) and size.max() > WIDE:
            return b"".join([self.tokens[i] for i in ids.tolist()])
        return self._bytes[ids][np.arange(WIDE) < size[:, None]].tobytes()

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """For each text: the number of ids, the SHA-256 of the ids as decimals, and of the bytes decoded from them."""
        cut = self.pieces(texts)
        self._fill(cut)
        n, ids, back = [], [], []
        for ps in cut:
            got = list(map(self.cache.__getitem__, ps))
            flat = np.frombuffer(b"".join([x for _, x in got]), np.uint32)
            n.append(len(flat))
            ids.append(hashlib.sha256(" ".join([s for s, _ in got]).encode()).hexdigest())
            back.append(hashlib.sha256(self.decode(flat)).hexdigest())
        self.cache.trim()
        return n, ids, back


_workers: dict[str, Encoding] = {}


def encoding(path: str) -> Encoding:
    """The encoding of a rank file, made once in a worker."""
    if path not in _workers:
        _workers[path] = Encoding.load(path)
    return _workers[path]


def encode_texts(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, offsets array<int> (bytes; one more than ids) of every row; a null text has no ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_bytes(texts):
                ids = own.encode_batch(texts[a:b])
                offsets = [np.cumsum([0, *(len(own.tokens[i]) for i in x)]).tolist() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], ["__id", "ids", "offsets"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"__id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("__id", id_col)


def decode_ids(encoded: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text of rows with ids; bytes that are no UTF-8 become U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks)
        for batch in batches:
            texts = [own.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__id", "text"])

    return encoded.select(F.col(id_col).alias("__id"), "ids").mapInArrow(run, f"__id {kind}, text string").withColumnRenamed("__id", id_col)


def round_trip_digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded again.

    ranks: path of a rank file that all executors have. A null text is an empty one. Repeated rows give repeated rows, a null
    id stays null, other columns are not read, an empty table gives an empty one. A text of any length is taken whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_bytes(texts, 1 << 20):
                n, ids, back = own.digests(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["__id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"__id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("__id", id_col)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
