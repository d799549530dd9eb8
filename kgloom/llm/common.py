"""What the operators of this subpackage share: row keys and batch helpers, and the library's written tables that cut lineage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.session import discard, new_folder, scratch, shared_folder, written

__all__ = ["BATCH_BYTES", "Cache", "by_bytes", "bytes_of", "discard", "named_rows", "new_folder", "one_row_each", "row_key", "scratch", "shared_folder", "written"]

#: A batch that crosses to Python holds about this many bytes of text at most (one longer text makes a batch of its own).
BATCH_BYTES = 4 << 20


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that name a row by what it holds, nulls included; rows alike share them."""
    return [F.xxhash64(*cols).alias("__k1"), F.xxhash64(F.lit("k2"), *reversed(cols)).alias("__k2")]


def bytes_of(text: str | bytes) -> int:
    """Bytes of a text in UTF-8."""
    return len(text) if isinstance(text, bytes) or text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def by_bytes(texts: Sequence[str | bytes], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts that hold about ``most`` bytes each, and no more unless one text does."""
    a = size = 0
    for b, own in enumerate(map(bytes_of, texts)):
        if b > a and size + own > most:
            yield a, b
            a, size = b, 0
        size += own
    if len(texts) > a:
        yield a, len(texts)


def named_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__row (all columns), __id, __text, and __k1, __k2, which rows alike in id and text share. No column of docs can clash with these."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{id_col}`").cast("bigint").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return own.select("*", *row_key(F.col("__id"), F.col("__text")))


def one_row_each(named: DataFrame, prints: DataFrame, stay: DataFrame) -> DataFrame:
    """The columns of named_rows' table for one row of each fp whose key stays: prints has __k1, __k2, fp of every row, stay fp, s1, s2.

    Rows are known by what they hold, so it does not matter in which order a table is read again. Of rows that share a key one is taken.
    """
    same = (F.col("__k1") == F.col("s1")) & (F.col("__k2") == F.col("s2"))
    verdicts = prints.join(stay, "fp").groupBy("__k1", "__k2").agg(F.count("*").alias("n"), F.max(same).alias("stays")).where("not stays or n > 1")
    verdicts = written(verdicts, "verdicts", keep=True)
    joined = named.select("__row", "__k1", "__k2").join(verdicts, ["__k1", "__k2"], "left")
    out = joined.where("stays is null").select("__row")
    if not verdicts.where("stays").isEmpty():
        out = out.union(joined.where("stays").groupBy("__k1", "__k2").agg(F.first("__row").alias("__row")).select("__row"))
    return out.select("__row.*")


class Cache(dict):
    """A dict of two generations, each of at most ``most`` keys: what was not asked for during one generation goes."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old[key]
        self[key] = value
        return value

    def unknown(self, keys: list[list]) -> set:
        """What the lists hold that no generation has."""
        return set().union(*keys).difference(self).difference(self.old)

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
