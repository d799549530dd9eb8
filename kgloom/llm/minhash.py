"""MinHash near-dedup with b-bit signatures.

A text is the set of its hashed shingles of ``WIDTH`` words. Of ``MINIMA`` minima of a set, each ``ROWS`` that follow one another are a band's key, which
brings sets together; two sets of similarity 0.8 share none of the 32 keys 5 times in 10^8. Of each minimum the ``BITS`` low bits are kept, packed into
planes of 64-bit words: minima of one hash function agree in these bits if they are equal, and else by chance once in 2^BITS, so the share of
agreeing places, counted by bits, less that chance estimates the similarity. Candidates of the bands whose estimate is below ``LEAST`` go, which a pair of
similarity 0.8 is 4 times in 10^9 (not at all likelier given a shared band); the whole sets of the rest decide. Which candidates are made is told in
:mod:`kgloom.llm.near_duplicates`: signatures bring the sets of keys together, and the whole sets of what came together are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import named_rows, one_row_each, scratch, written
from kgloom.llm.near_duplicates import MINIMA, MOST_SHARED, MOST_TOGETHER, ROWS, Signatures, bands, groups, links_of, minima, shingles, texts_by_set

WIDTH, BITS, LEAST = 2, 2, 0.5
WORDS = MINIMA // 64


def packed(least: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of minima as 64-bit words: those of the first bit of all, then of the next."""
    planes = (least[None] >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def similarity(x: Column, y: Column) -> Column:
    """The similarity that two packed signatures tell: the share of agreeing places, corrected for those that agree by chance."""
    differ = lambda w: [F.get(x, F.lit(k * WORDS + w)).bitwiseXOR(F.get(y, F.lit(k * WORDS + w))) for k in range(BITS)]
    apart = F.lit(0)
    for w in range(WORDS):
        some, *rest = differ(w)
        for one in rest:
            some = some.bitwiseOR(one)
        apart = apart + F.bit_count(some)
    chance = 2.0**-BITS
    return ((MINIMA - apart) / MINIMA - chance) / (1 - chance)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the estimate is at least ``LEAST``, all rows of packed signatures with all."""
    apart = np.zeros((len(x), len(y)), np.int32)
    for w in range(WORDS):
        some = x[:, None, w] ^ y[None, :, w]
        for k in range(1, BITS):
            some |= x[:, None, k * WORDS + w] ^ y[None, :, k * WORDS + w]
        apart += np.bitwise_count(some)
    chance = 2.0**-BITS
    return ((MINIMA - apart) / MINIMA - chance) / (1 - chance) >= LEAST


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """__id, fp (names the set of shingles; null: the empty one), size, keys, sign of every row of docs (__id, __text)."""
    kind = docs.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            least = [minima(s, MINIMA) if len(s) else None for s in sets]
            fps = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            keys = pa.array([bands(m) if m is not None else None for m in least], pa.list_(pa.int64()))
            signs = pa.array([packed(m).view(np.int64) if m is not None else None for m in least], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), keys, signs], ["__id", "fp", "size", "keys", "sign"])

    return docs.select("__id", "__text").mapInArrow(run, f"__id {kind}, fp bigint, size bigint, keys array<bigint>, sign array<bigint>")


def _components(docs: DataFrame, width: int, most: tuple[int, int], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """named_rows; fp, size, __id, __k1, __k2 of every row; fp, best, root of every set that is not empty."""
    named = named_rows(docs, id_col, text_col)
    rows = written(_signed(named.select(F.struct("__id", "__k1", "__k2").alias("__id"), "__text"), width).select("fp", "size", "keys", "sign", "__id.*"), "prints", keep=True)
    best = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "__k1", "__k2")).alias("best")
    distinct = written(rows.where("fp is not null").groupBy("fp").agg(best, F.first("keys").alias("keys"), F.first("sign").alias("sign")), "distinct")
    keyed = distinct.select(F.explode(F.array_distinct("keys")).alias("key"), "fp")
    signs = Signatures(distinct.select("fp", "sign"), lambda x, y: similarity(x, y) >= LEAST, alike)
    edges = links_of(keyed, signs, texts_by_set(named, distinct), width, MINIMA // ROWS // 8, *most)
    return named, rows, groups(distinct.select("fp", "best"), edges)


def minhash_groups(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", most_shared: int = MOST_SHARED, most_together: int = MOST_TOGETHER) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Rows whose sets have a similarity of 0.8 or more are linked; component_id is the smallest id that chains of links reach, and a row is kept if it is
    its own. Texts without words, null and empty ones among them, have no shingles and are linked with nothing. A null id is never the smallest; where a
    component has no other, component_id and kept are null. Repeated rows give repeated rows (all kept, or none); other columns are not read; an empty table
    gives an empty one.
    """
    with scratch():
        _, rows, rooted = _components(docs, width, (most_shared, most_together), id_col, text_col)
        least = rooted.groupBy("root").agg(F.min("best.id").alias("component_id"))
        found = written(rooted.join(least, "root").select("fp", "component_id"), "found", keep=True)
        own = rows.where("fp is not null").join(found, "fp").select("__id", "size", "component_id")
        out = own.union(rows.where("fp is null").select("__id", "size", "__id"))
        return out.select(F.col("__id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", (F.col("__id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", most_shared: int = MOST_SHARED, most_together: int = MOST_TOGETHER) -> DataFrame:
    """docs, all their columns, with one row of each component of :func:`minhash_groups`: that of the smallest id (null ids last).

    Rows without words all stay. Of rows alike in id and text one stays, any of them. Column names may be of any kind; an empty table gives an empty one.
    """
    with scratch():
        named, rows, rooted = _components(docs, width, (most_shared, most_together), id_col, text_col)
        first = rooted.groupBy("root").agg(F.min("best").alias("first"))
        stay = rooted.select("fp", "root").join(first, "root").select("fp", F.col("first.__k1").alias("s1"), F.col("first.__k2").alias("s2"))
        bare = named.join(rows.where("fp is null").select("__k1", "__k2").distinct(), ["__k1", "__k2"], "left_semi").select("__row.*")
        some = named.join(rows.where("fp is not null").select("__k1", "__k2").distinct(), ["__k1", "__k2"], "left_semi")
        return one_row_each(some, rows.where("fp is not null").select("fp", "__k1", "__k2"), stay).union(bare)
