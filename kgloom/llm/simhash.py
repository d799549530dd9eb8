"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Of two fingerprints at most 2 bits apart some segment is
alike (pigeonhole), and any other differs in 2 bits at most. A segment, seen as a word of 23 bits, lies within 3 bits of exactly
one codeword of the perfect binary Golay code; the codewords nearest to the segment and to what one flipped bit makes of it
(five or six, as 12-bit indices) are its fuzzy keys, and two segments at most 2 bits apart share one, since a word between them
is one flip away from both. So a fingerprint gets keys of one segment exact and one fuzzy index of the next, for each of the
three; fingerprints that share a key are compared. Only distinct fingerprints take part, so exact copies cost nothing.

A key that more than ``MOST_SHARED`` fingerprints share would give pairs in the square of its group. Those fingerprints are joined another
exact way: each gives itself and its 64 one-bit flips, and fingerprints that give the same word are within 2 bits of each
other, so each is linked to the least of them. That is linear, and the components come out the same.

Sets of shingles that are less alike than 2 bits allow take ``PRINTS`` fingerprints each (:func:`set_prints`), whose segments are decoded without
flips: the indices of two segments are a key (:func:`code_keys`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import named_rows, one_row_each, scratch, written
from kgloom.operators.components import components

#: Generator polynomial of the Golay code (fixed value): x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 2
MOST_SHARED = 24
PRINTS = 32
_random = np.random.default_rng(8)
_FACTORS = _random.integers(0, 1 << 63, (2, PRINTS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_tables: list[tuple] = []


def _remainder(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        out = np.where((out >> bit) & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and the error of each syndrome: every one has exactly one of at most 3 bits."""
    if not _tables:
        low, high = _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)
        bits = 1 << np.arange(23)
        errors = [np.zeros(1, np.int64), bits, np.array([a | b for i, a in enumerate(bits) for b in bits[:i]]), np.array([a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]])]
        every = np.concatenate(errors)
        table = np.full(1 << 11, -1, np.int64)
        table[_remainder(every)] = every
        assert len(every) == 1 << 11 and table.min() >= 0
        _tables.append((low, high, table))
    return _tables[0]


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within 3 bits of each 23-bit word."""
    low, high, errors = golay_tables()
    words = words.astype(np.int64)
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """n x (bits + 1) indices: of each word and of its one-bit flips; two words at most 2 bits apart share one."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    return nearest(words[:, None] ^ flips)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, key) for all keys of unsigned 64-bit fingerprints, each once."""
    who, keys = [], []
    for i, (at, bits) in enumerate(SEGMENTS):
        next_at, next_bits = SEGMENTS[(i + 1) % 3]
        cut = lambda a, b: ((prints >> np.uint64(a)) & np.uint64((1 << b) - 1)).astype(np.int64)
        fuzzy = np.sort(fuzzy_indices(cut(next_at, next_bits), next_bits), 1)
        new = np.concatenate([np.ones((len(prints), 1), bool), fuzzy[:, 1:] != fuzzy[:, :-1]], 1)
        row, col = np.nonzero(new)
        who.append(row)
        keys.append((i << 40) | (cut(at, bits)[row] << 12) | fuzzy[row, col])
    return np.concatenate(who), np.concatenate(keys)


def _set_bits(words: np.ndarray) -> np.ndarray:
    """In how many words of each row each of the 64 bits is set; words are added by threes, in planes of sums and carries."""
    out, weight = np.zeros((len(words), 64), np.int64), 1
    while words.shape[1]:
        carried = [words[:, :0]]
        while third := words.shape[1] // 3:
            a, b, c = words[:, :third], words[:, third : 2 * third], words[:, 2 * third : 3 * third]
            odd = a ^ b
            carried.append(a & b | odd & c)
            words = np.concatenate([odd ^ c, words[:, 3 * third :]], 1)
        bits = np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        out += weight * bits.reshape(*words.shape, 64).sum(1, dtype=np.int64)
        words, weight = np.concatenate(carried, 1), 2 * weight
    return out


def set_prints(own: np.ndarray) -> np.ndarray:
    """The ``PRINTS`` SimHashes of a set of 64-bit hashes: the first of the hashes as they are, each other of them mixed anew; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.uint64)
    counts = np.zeros((PRINTS, 64), np.int64)
    for a in range(0, len(own), 8192):
        words = own[a : a + 8192] * _FACTORS[0]
        words = (words ^ (words >> np.uint64(32))) * _FACTORS[1]
        words ^= words >> np.uint64(29)
        words[0] = own[a : a + 8192]
        counts += _set_bits(words)
    return np.packbits(2 * counts > len(own), axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def code_keys(prints: np.ndarray) -> np.ndarray:
    """n x PRINTS x 3 keys of n x PRINTS fingerprints: for each of the three segments the Golay indices of it and of the next."""
    codes = np.stack([nearest(((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).ravel()).reshape(prints.shape) for at, bits in SEGMENTS], 2)
    return np.arange(3 * PRINTS).reshape(PRINTS, 3) << 24 | codes << 12 | np.roll(codes, -1, 2)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; words are lower-cased in A-Z only; no words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and space or U+0009 to U+000D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[a : a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, fp (the fingerprint as a signed bigint) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["__id", "fp"])

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"__id {kind}, fp bigint")


def _keys(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            who, keys = keys_of(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[who])], ["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key bigint, fp bigint")


def links(prints: DataFrame, most_shared: int = MOST_SHARED) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints at most 2 bits apart, enough to join all that a chain of such joins."""
    keys = _keys(prints)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keys.join(shared, "key"), "met")
    few = met.where(F.col("n") <= most_shared)
    pairs = few.alias("x").join(few.alias("y"), "key").where("x.fp < y.fp").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= DISTANCE).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = met.where(F.col("n") > most_shared).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("bigint") for v in (1 << i for i in range(64))))
    words = many.select("fp", F.explode(flips).alias("__flip")).select("fp", F.col("fp").bitwiseXOR(F.col("__flip")).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    stars = words.join(least, "word").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def simhash_groups(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row.

    component_id is the smallest id among the rows that a chain of fingerprints, each at most 2 bits from the next, reaches; rows
    with equal fingerprints are in one component. Null and empty texts have fingerprint 0 and are linked like others. A null
    id is never the smallest (the component of null ids only is null). Repeated rows give repeated rows; other columns are
    not read; an empty table gives an empty one.
    """
    with scratch():
        rows = written(fingerprints(docs, width, id_col, text_col), "prints", keep=True)
        prints = written(rows.groupBy("fp").agg(F.min("__id").alias("least")), "distinct")
        roots = written(components(links(prints)), "roots")
        rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = written(rooted.join(ids, "root").select("fp", "component_id"), "named", keep=True)
        hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
        return rows.join(named, "fp").select(F.col("__id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all their columns, with one row of each component of :func:`simhash_groups`: that of the smallest id (null ids last).

    Null and empty texts are alike. Of rows alike in id and text one stays, any of them. Column names may be of any kind; an empty
    table gives an empty one.
    """
    with scratch():
        named = named_rows(docs, id_col, text_col)
        prints = written(fingerprints(named.select(F.struct("__id", "__k1", "__k2").alias("__all"), "__text"), width, "__all", "__text").select("fp", "__id.*"), "prints")
        best = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "__k1", "__k2")).alias("best")
        distinct = written(prints.groupBy("fp").agg(best), "distinct")
        roots = written(components(links(distinct)), "roots")
        rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
        first = rooted.groupBy("root").agg(F.min("best").alias("first"))
        stay = rooted.select("fp", "root").join(first, "root").select("fp", F.col("first.__k1").alias("s1"), F.col("first.__k2").alias("s2"))
        return one_row_each(named, prints, stay)
