"""Near duplicates by Jaccard similarity of word shingles: keys bring texts together, their whole shingle sets decide.

A text is the set of its hashed shingles of ``WIDTH`` words. Only distinct sets take part, so exact copies cost nothing.

In the pipeline each set has several SimHash fingerprints and a minimum for each, and a key of each Golay-decoded segment of each with that minimum: the
Golay indices of two segments are 24 bits, by which sets that have nothing in common meet too, and the more often the more sets there are; sets
share a minimum as often as they are similar. A fingerprint bit of two sets of similarity 0.8 differs with probability 0.15, so no number of keys of that
kind is sure to bring them together. For what they leave parted there are MinHash bands: of a set's ``BANDS`` keys, each of ``ROWS`` minima, two sets of
similarity j share one at least with probability 1 - (1 - j^ROWS)^BANDS, which is 0.999997 at 0.8.

What is compared is found in two steps (:func:`links_of`). First, sets whose signatures are not too unlike for a near pair, and that share a key, come
together: each set with the least of the least sets of its keys; then, of each key that still holds sets of two components, one set a component with the
least; then, in the keys that are left, all with all by their signatures, which gives a tree of links a key. So a group of n near copies makes about n rows at
each step, not as many as its keys or its pairs. Then the whole sets of each component are compared, all with all, in blocks of about ``BLOCK`` sets,
where a pair of blocks is one matrix product that gives no more links than it has sets; a set is sent once for each block of its component.

That takes the square of a component, so components of more than ``MOST_TOGETHER`` sets, as a template's pages make them, go another exact way: candidates
with one partner a set and round, whose verdicts join components; then, in keys of at most ``MOST_SHARED`` sets, all pairs across components; larger keys
give their sets to a pool, in which two sets of similarity 0.8 share one of the rarest fifth of their shingles, and sets that share such a shingle are
compared, pairwise where they are few, and else in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm import simhash
from kgloom.llm.common import discard, named_rows, one_row_each, scratch, written
from kgloom.operators.components import components

WIDTH = 5
#: The least similarity of near duplicates, as a fraction.
SIMILAR = (4, 5)
#: Fingerprints of a set that are its signature. Of sets of similarity 0.8 at most 96 of these 512 bits differ on average (standard deviation 9), of sets apart 256.
SIGNED, APART = 8, 150
BANDS, ROWS = 24, 4
MOST_SHARED = 24
BLOCK, MOST_TOGETHER = 256, 4096
#: Rows of small groups that one call of a function takes, about.
AT_ONCE = 2048
_random = np.random.default_rng(42)
#: Hash functions that minima may be taken under.
MINIMA = 128
_FACTORS = _random.integers(0, 1 << 31, (MINIMA, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, (MINIMA, 1), np.uint32)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's distinct word shingles; words are lower-cased in A-Z only; fewer words are one shingle, no words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and space or U+0009 to U+000D
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n))


def minima(own: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least value of a set of shingles under each of n hash functions (``MINIMA`` at most); none for an empty set."""
    if not len(own):
        return np.zeros(0, np.uint32)
    high = (own >> np.uint64(32)).astype(np.uint32)
    return np.min([(high[a : a + 2048] * _FACTORS[:n] + _SHIFTS[:n]).min(1) for a in range(0, len(high), 2048)], 0)


def bands(least: np.ndarray) -> np.ndarray:
    """A key of each ``ROWS`` minima that follow one another."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(-1, ROWS))], np.uint64).view(np.int64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; none for an empty set."""
    return bands(minima(own))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """__id, fp (names the set of shingles; 0: the empty one), prints (its fingerprints), least (a minimum for each of these), keys (of its bands)."""
    kind = docs.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            least = [minima(s) for s in sets]
            prints = pa.array([simhash.set_prints(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            some = pa.array([m[: simhash.PRINTS].view(np.int32) for m in least], pa.list_(pa.int32()))
            keys = pa.array([bands(m) for m in least], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), prints, some, keys], ["__id", "fp", "prints", "least", "keys"])

    return docs.select("__id", "__text").mapInArrow(run, f"__id {kind}, fp bigint, prints array<bigint>, least array<int>, keys array<bigint>")


def _coded(distinct: DataFrame) -> DataFrame:
    """key, fp for all Golay-code keys of the sets' fingerprints.

    A key is the Golay index of a segment and the fingerprint's minimum; without the column least, the Golay indices of the segment and of the next.
    """
    read = [c for c in ("fp", "prints", "least") if c in distinct.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, simhash.PRINTS)
            keys = simhash.code_keys(prints.view(np.uint64))
            if "least" in read:
                least = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(prints.shape)
                keys = keys >> 12 << 32 | least[:, :, None]
            fps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys[0].size if len(keys) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(fps)], ["key", "fp"])

    return distinct.where(F.size("prints") > 0).select(*read).mapInArrow(run, "key bigint, fp bigint")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """fp, own (the hashes of its shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, width).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["fp", "own"])

    return texts.select("fp", "__text").mapInArrow(run, "fp bigint, own array<bigint>")


def tree_of_near(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places, at most one fewer than sets, that join all that chains of near sets join."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    who = np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = counts[column] > 1
    who, column = who[both], np.unique(column[both], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    same = np.zeros((n, n), np.float64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [a, a + 4096])
        has = np.zeros((n, 4096), np.float32)
        has[who[i:j], column[i:j] - a] = 1
        same += has @ has.T
    near = SIMILAR[1] * same >= SIMILAR[0] * (sizes[:, None] + sizes - same)
    return _tree(near)


def _tree(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places, at most one fewer than places, that join all that chains in a matrix of near places join."""
    out, new = [], np.ones(len(near), bool)
    for start in range(len(near)):
        if new[start]:
            new[start], todo = False, [start]
            while todo:
                x = todo.pop()
                found = np.flatnonzero(near[x] & new)
                new[found] = False
                out += [(x, int(y)) for y in found]
                todo += found.tolist()
    return out


def _in_blocks(keyed: DataFrame, tree: Callable[[pd.DataFrame], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): links among the roots of the rows (key, n, fp, root and others) of each key, as tree finds them among the rows; n: the rows of the key.

    Small keys share calls, and a call tells a link once; larger ones are compared in pairs of blocks of about ``BLOCK`` rows.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    calls = max(1, keyed.where(F.col("n") <= BLOCK).count() // AT_ONCE)
    own = keyed.withColumn("__i", F.when(blocks > 1, F.pmod(F.xxhash64("fp"), blocks).cast("int")).otherwise(0))
    own = own.withColumn("__j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    call = F.when(blocks > 1, F.xxhash64("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(calls)))
    rest = [c for c in keyed.columns if c not in ("key", "n")]
    own = own.select(call.alias("__c"), (blocks > 1).alias("__many"), F.least("__i", "__j").alias("__a"), F.greatest("__i", "__j").alias("__b"), "key", *rest)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "root"], ignore_index=True)  # the least root first, so that many keys tell the same links
        keys, roots = rows["key"].to_numpy(), rows["root"].to_numpy()
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        out, a = set(), 0
        for b in ends.tolist():
            if b - a > 1 and roots[a] != roots[b - 1]:
                own = roots[a:b].tolist()
                out |= {(own[x], own[y]) for x, y in tree(rows.iloc[a:b]) if own[x] != own[y]}
            a = b
        return pd.DataFrame(list(out), columns=["a", "b"], dtype="int64")

    return own.groupBy("__c", "__many", "__a", "__b").applyInPandas(run, "a bigint, b bigint")


def _sets_near(rows: pd.DataFrame) -> list[tuple[int, int]]:
    return tree_of_near(rows["own"].tolist())


def _rooted(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """sets with root, that of their component, or their own fp."""
    return sets.join(roots, sets["fp"] == roots["node"], "left").select(*sets.columns, F.coalesce("root", "fp").alias("root"))


def _open(keyed: DataFrame, roots: DataFrame, decided: bool = False) -> DataFrame:
    """key, n, fp, root, head (the least root of the key and the least of its sets in the key) of the keys whose sets are of several components.

    decided: keys of two sets that are alone have been decided, and are not open.
    """
    rooted = _rooted(keyed.select("key", "n", "fp"), roots)
    spans = rooted.groupBy("key").agg(F.min(F.struct("root", "fp")).alias("head"), F.max("root").alias("q"), F.max("n").alias("m"), F.count_if(F.col("root") == F.col("fp")).alias("alone"))
    spans = spans.where("head.root < q").where("m > 2 or alone < 2" if decided else "true").select("key", "head")
    return written(rooted.join(spans, "key"), "open")


def _prefixes(pool: DataFrame, sets: DataFrame) -> DataFrame:
    """key, n, fp, root, size for the rarest shingles of each set (fp, root) that another of the pool has as well.

    Two sets with a similarity of s have a shingle in common among the first floor((1 - s) * size) + 1 of theirs, in any order that is the same for all;
    rare ones come first.
    """
    size = F.size("own")
    each = pool.join(sets, "fp").select("fp", "root", size.alias("size"), F.explode("own").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("n"))
    most = F.floor(F.col("size") * (SIMILAR[1] - SIMILAR[0]) / SIMILAR[1]).cast("int") + 1
    first = each.join(often, "key").groupBy("fp", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own")).select("fp", "root", "size", F.explode(F.slice("own", 1, most)).alias("one"))
    return written(first.select("one.key", "fp", "root", "size").where("one.n > 1"), "prefixes")


def _spanned(keyed: DataFrame) -> DataFrame:
    """key, fp, n (sets of the key), least (the least of them) of the keys of several sets."""
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1"), "key")


def _stars(met: DataFrame) -> DataFrame:
    """(a, b): each set with one other, the least of the least sets of its keys."""
    return met.where("least < fp").groupBy("fp").agg(F.min("least").alias("a")).select("a", F.col("fp").alias("b"))


def _heads(held: DataFrame) -> DataFrame:
    """(a, b, keys): of each component that shares keys with a lesser one, one set and one of theirs, and how many keys these are."""
    pair = F.min(F.struct(F.col("head.fp").alias("a"), F.col("fp").alias("b"))).alias("pair")
    pairs = held.where("root <> head.root").groupBy("root", "head.root").agg(pair, F.count_distinct("key").alias("keys"))
    return pairs.select("pair.*", "keys")


def _roots(edges: DataFrame) -> DataFrame:
    return written(components(edges), "roots")


def _edges(roots: DataFrame) -> DataFrame:
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


class Signatures:
    """The signatures (fp, sign) of sets, and how far alike those of near sets are: ``bits`` of a matrix of words against another's give a matrix of truth values."""

    def __init__(self, table: DataFrame, pair: Callable[[Column, Column], Column], rows: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        self.table, self.pair, self.rows = table, pair, rows

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be near."""
        left, right = (self.table.select(F.col("fp").alias(c), F.col("sign").alias(f"__{c}")) for c in ("a", "b"))
        return pairs.join(left, "a").join(right, "b").where(self.pair(F.col("__a"), F.col("__b"))).select("a", "b")

    def in_keys(self, held: DataFrame) -> DataFrame:
        """(a, b): links that join all sets of a key that may be near."""
        compare = self.rows

        def tree(rows: pd.DataFrame) -> list[tuple[int, int]]:
            words = [np.asarray(x, np.int64) for x in rows["sign"]]
            if not all(map(len, words)):
                return [(0, k) for k in range(1, len(words))]  # without signatures all may be near
            own = np.stack(words).view(np.uint64)
            return _tree(compare(own, own))

        return _in_blocks(held.select("key", "n", "fp", "root").join(self.table, "fp"), tree)


def _together(met: DataFrame, signs: Signatures, many: int) -> DataFrame:
    """node, root: components of the sets that share a key and may be near by their signatures.

    Components that share many keys are one without a look at signatures: that only makes more to compare, and leaves no key of theirs open.
    """
    roots, held = _roots(signs.alike(written(_stars(met), "pairs"))), met
    for last in (False, True):
        held = _open(held, roots, decided=last)
        heads = written(_heads(held), "pairs")
        roots = _roots(_edges(roots).union(signs.alike(heads.where(F.col("keys") < many).select("a", "b"))).union(heads.where(F.col("keys") >= many).select("a", "b")))
    held = _open(held, roots, decided=True)
    if held.isEmpty():
        return roots
    return _roots(_edges(roots).union(written(signs.in_keys(held).distinct(), "links")))


def _in_rounds(met: DataFrame, signs: Signatures, texts_of: Callable[[DataFrame], DataFrame], width: int, most_shared: int) -> DataFrame:
    """(a, b): links that join all near sets that share a key of met, without comparing all sets of a component."""

    def near(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The near ones of the pairs (a, b), and all of them."""
        tried = written(pairs, "pairs")
        own = written(signs.alike(tried), "alike")
        sets = written(_sets(texts_of(own.select(F.col("a").alias("fp")).union(own.select("b")).distinct()), width), "sets")
        held = own.join(sets.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b").join(sets.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a")
        same = F.size(F.array_intersect("x", "y"))
        out = written(held.where(SIMILAR[1] * same >= SIMILAR[0] * (F.size("x") + F.size("y") - same)).select("a", "b"), "near")
        discard(sets)
        return out, tried

    found, first = near(_stars(met))
    roots = _roots(found)
    held = _open(met, roots)
    found, second = near(_heads(held).select("a", "b").join(first, ["a", "b"], "left_anti"))
    roots = _roots(_edges(roots).union(found))
    held = _open(held, roots)
    if held.isEmpty():
        return _edges(roots)

    def across(sets: DataFrame, fits: Callable[[str, str], Column]) -> DataFrame:
        """The pairs of sets (key, fp, root, sign and others) of a key that are of two components and fit."""
        own = sets.alias("x").join(sets.alias("y"), "key").where("x.fp < y.fp and x.root <> y.root").where(signs.pair(F.col("x.sign"), F.col("y.sign"))).where(fits("x", "y"))
        return own.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    signed = held.join(signs.table, "fp")
    pairs = across(signed.where(F.col("n") <= most_shared).select("key", "fp", "root", "sign"), lambda x, y: F.lit(True))
    pool = written(signed.where(F.col("n") > most_shared).select("fp", "root").distinct(), "pool")
    blocks = None
    if not pool.isEmpty():
        sets = written(_sets(texts_of(pool.select("fp")), width), "pool-sets")
        rare = _prefixes(pool, sets)
        shared = rare.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("p"), F.max("root").alias("q")).where("p < q").select("key", "n")
        rare = written(rare.join(shared, "key"), "rare")
        sizes = lambda x, y: SIMILAR[1] * F.least(F.col(f"{x}.size"), F.col(f"{y}.size")) >= SIMILAR[0] * F.greatest(F.col(f"{x}.size"), F.col(f"{y}.size"))
        pairs = pairs.union(across(rare.where(F.col("n") <= most_shared).join(signs.table, "fp").select("key", "fp", "root", "sign", "size"), sizes))
        blocks = written(_in_blocks(rare.where(F.col("n") > most_shared).select("key", "n", "fp", "root").join(sets, "fp"), _sets_near), "blocks")
    found, _ = near(pairs.distinct().join(first.union(second), ["a", "b"], "left_anti"))
    return _edges(_roots(_edges(roots).union(found if blocks is None else found.union(blocks))))


def links_of(keyed: DataFrame, signs: Signatures, texts_of: Callable[[DataFrame], DataFrame], width: int, many: int, most_shared: int = MOST_SHARED, most_together: int = MOST_TOGETHER) -> DataFrame:
    """(a, b): links that join all near sets that share a key (key, fp), and so all that chains of such do.

    texts_of: the texts (fp, __text) of a table of fps. many: keys that bring sets together whatever their signatures.
    """
    met = written(_spanned(keyed), "met")
    roots = _together(met, signs, many)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    placed = written(roots.join(sizes, "root").select(F.col("root").alias("key"), "n", F.col("node").alias("fp")), "placed")
    sets = _sets(texts_of(placed.where(F.col("n") <= most_together).select("fp")), width)
    own = placed.where(F.col("n") <= most_together).select("key", "n", "fp", F.col("fp").alias("root")).join(sets, "fp")
    out = written(_in_blocks(own, _sets_near), "blocks")
    large = placed.where(F.col("n") > most_together).select("fp")
    if not large.isEmpty():
        out = out.union(_in_rounds(written(_spanned(met.select("key", "fp").join(large, "fp", "left_semi")), "met"), signs, texts_of, width, most_shared))
    return out


def alike_prints(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of fingerprints are at most ``APART`` bits apart, all with all."""
    apart = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        apart += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return apart <= APART


def links(distinct: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int = WIDTH, most_shared: int = MOST_SHARED, most_together: int = MOST_TOGETHER) -> DataFrame:
    """(a, b): links that join all near sets; distinct has fp, prints, keys and may have least, texts_of gives the texts (fp, __text) of fps."""
    keyed = _coded(distinct).union(distinct.select(F.explode(F.array_distinct("keys")), "fp"))

    def alike(x: Column, y: Column) -> Column:
        apart = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SIGNED)), F.lit(0))
        return F.coalesce(apart <= APART, F.lit(True))

    signs = Signatures(distinct.select("fp", F.slice("prints", 1, SIGNED).alias("sign")), alike, alike_prints)
    return links_of(keyed, signs, texts_of, width, (3 * simhash.PRINTS + BANDS) // 8, most_shared, most_together)


def groups(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, best, root: distinct (fp, best) with the component that the edges put each set in."""
    roots = written(components(edges), "roots")
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))


def texts_by_set(named: DataFrame, distinct: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """fp, __text for a table of fps: the text of each set's best row; named: __k1, __k2, __text, distinct: fp, best."""

    def texts_of(fps: DataFrame) -> DataFrame:
        asked = distinct.join(fps, "fp", "left_semi").select("fp", F.col("best.__k1").alias("__k1"), F.col("best.__k2").alias("__k2"))
        return named.select("__k1", "__k2", "__text").join(asked, ["__k1", "__k2"]).groupBy("fp").agg(F.first("__text").alias("__text"))

    return texts_of


def one_of_each(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", most_shared: int = MOST_SHARED, most_together: int = MOST_TOGETHER) -> DataFrame:
    """docs, all their columns, with one row of each component of near duplicates: that of the smallest id (null ids last).

    Texts without words, null ones included, are copies of one another. Of rows alike in id and text one stays, any of them. Column
    names may be of any kind; an empty table gives an empty one.
    """
    with scratch():
        named = named_rows(docs, id_col, text_col)
        rows = written(_signed(named.select(F.struct("__id", "__k1", "__k2").alias("__id"), "__text"), width).select("fp", "prints", "least", "keys", "__id.*"), "prints")
        best = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "__k1", "__k2")).alias("best")
        distinct = written(rows.groupBy("fp").agg(best, *(F.first(c).alias(c) for c in ("prints", "least", "keys"))), "distinct")

        rooted = groups(distinct, links(distinct.select("fp", "prints", "least", "keys"), texts_by_set(named, distinct), width, most_shared, most_together))
        first = rooted.groupBy("root").agg(F.min("best").alias("first"))
        stay = rooted.select("fp", "root").join(first, "root").select("fp", F.col("first.__k1").alias("s1"), F.col("first.__k2").alias("s2"))
        return one_row_each(named, rows.select("fp", "__k1", "__k2"), stay)
