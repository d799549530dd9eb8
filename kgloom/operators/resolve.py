"""Entity resolution: similarity join, clusters that are cliques, canonical names."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.vectors import dot
from kgloom.operators.components import components
from kgloom.session import cut, scratch, written

#: A block of the similarity join holds vectors of so many bytes as doubles, and where tasks would be few, so many vectors at least.
BLOCK_BYTES, BLOCK_LEAST = 32 << 20, 2048
#: Products that a task holds at a time.
CELLS = 1 << 22
#: Pivots of the similarity join at most; all of them go to every task.
MOST_PIVOTS = 256
#: Angles are compared with this much to spare.
SLACK = 1e-6


@dataclass
class Plan:
    """How a similarity join is dealt: cells by pivots, or a single cell without."""

    pivots: np.ndarray | None
    #: By cell: home vectors, visiting vectors, blocks of each.
    homes: list[int]
    visitors: list[int]
    blocks: list[tuple[int, int]]
    radius: np.ndarray | None
    reach: float

    @property
    def products(self) -> int:
        """Products of two vectors that the join makes, about."""
        return sum(h * (h + 1) // 2 + h * v for h, v in zip(self.homes, self.visitors))

    @property
    def copies(self) -> int:
        """Vectors that the join shuffles."""
        return sum(h * (b + v) + n * b for h, n, (b, v) in zip(self.homes, self.visitors, self.blocks))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _visits(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray | None = None, reach: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell, angle to its pivot, which later cells each vector visits).

    A vector within reach of some vector of a cell is at most reach and the cell's radius away from its pivot; and, as that other one is not nearer to this
    one's pivot than to its own, at most twice the reach farther from that pivot than from its own.
    """
    angle = np.arccos(np.clip(_unit(x) @ pivots.T, -1, 1))
    home = angle.argmin(1)
    own = angle[np.arange(len(x)), home]
    if radius is None:
        return home, own, np.zeros((0, 0), bool)
    near = (angle <= radius + reach + SLACK) & (angle - own[:, None] <= 2 * reach + SLACK) & (np.arange(len(pivots)) > home[:, None])
    return home, own, near


def _measured(vectors: DataFrame) -> tuple[int, int, float]:
    """How many vectors, the longest one's length, and the largest square of a vector."""
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return tuple(vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1)), F.coalesce(F.max(squares), F.lit(0.0))).first())


def _most(size: int) -> int:
    """Vectors of so many numbers that a block holds."""
    return max(1, BLOCK_BYTES // (8 * size))


def _blocks(vectors: DataFrame, measured: tuple[int, int, float] | None = None) -> int:
    """As few blocks without pivots as their size allows, but enough for some pairs of blocks a core."""
    n, size, _ = measured or _measured(vectors)
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(n / _most(size)), min(math.ceil(n / BLOCK_LEAST), math.ceil(math.sqrt(2 * tasks))))


def plan(vectors: DataFrame, threshold: float, blocks: int | None = None, most_pivots: int = MOST_PIVOTS) -> Plan:
    """How :func:`similar_pairs` deals (id, vector): by pivots where that takes fewer products than all pairs, and no more copies of vectors."""
    own = vectors.select("id", "vector").dropna()
    n, size, square = measured = _measured(own)
    most = _most(size)
    plain = blocks or _blocks(own, measured)
    whole = Plan(None, [n], [0], [(plain, 0)], None, math.pi)
    cosine = threshold / square if square else 1.0
    m = min(most_pivots, 2 * math.isqrt(n))
    if blocks or m < 2 or cosine <= 0:
        return whole
    reach = math.acos(min(1.0, cosine))
    pivots = _unit(np.array([r.vector for r in own.orderBy(F.xxhash64("id")).limit(m).select("vector").collect()], np.float64))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, angle, _ = _visits(_matrix(batch.column(0)), pivots)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(angle)], ["cell", "angle"])

    found = own.select("vector").mapInArrow(homes, "cell bigint, angle double").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()
    count, radius = [0] * m, np.full(m, -10.0)  # nothing is near an empty cell
    for cell, k, r in found:
        count[cell], radius[cell] = k, r

    def visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m, np.int64)
        for batch in batches:
            total += _visits(_matrix(batch.column(0)), pivots, radius, reach)[2].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(total)], ["cell", "n"])

    met = [0] * m
    for cell, k in own.select("vector").mapInArrow(visitors, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        met[cell] = k
    dealt = [(max(1, math.ceil(h / most)), math.ceil(v / most)) for h, v in zip(count, met)]
    cells = Plan(pivots, count, met, dealt, radius, reach)
    return cells if cells.products < whole.products and cells.copies <= max(whole.copies, 2 * n) else whole


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _dealt(own: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """id, vector, cell, own (its block), visits (how many blocks it meets, from the first): a row for each cell that a vector is in."""
    if plan.pivots is None:
        n = plan.blocks[0][0]
        return own.select("id", "vector", F.lit(0).cast("bigint").alias("cell"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("own"), F.lit(n).alias("meets"))
    pivots, radius, reach = plan.pivots, plan.radius, plan.reach
    home_blocks, more = (np.array(x, np.int64) for x in zip(*plan.blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, _, near = _visits(_matrix(batch.column("vector")), pivots, radius, reach)
            who, cell = np.nonzero(near)
            rows, cells = np.concatenate([np.arange(len(home)), who]), np.concatenate([home, cell])
            hashes = batch.column("h").to_numpy(zero_copy_only=False)[rows]
            at_home = np.arange(len(rows)) < len(home)
            block = np.where(at_home, hashes % home_blocks[cells], home_blocks[cells] + hashes % np.maximum(1, more[cells]))
            meets = np.where(at_home, home_blocks[cells] + more[cells], home_blocks[cells])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), batch.column("vector").take(pa.array(rows)), pa.array(cells), pa.array(block.astype(np.int32)), pa.array(meets.astype(np.int32))], ["id", "vector", "cell", "own", "meets"])

    vector = own.schema["vector"].dataType.simpleString()
    hashed = own.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h"))
    return hashed.mapInArrow(run, f"id {kind}, vector {vector}, cell bigint, own int, meets int")


def similar_pairs(vectors: DataFrame, threshold: float, blocks: int | None = None, dealt: Plan | None = None) -> DataFrame:
    """A < b, sim for all pairs of (id, vector) whose unit vectors have a dot product of at least threshold.

    Exact. A sample of vectors (the ``MOST_PIVOTS`` whose ids hash lowest, or twice the root of their number) are pivots; each vector is at home in the cell of its
    nearest pivot and visits those later cells that can hold a vector within the threshold's angle of it, by the triangle inequality. A cell is cut into
    blocks of bounded bytes, and each pair of its blocks is a matrix product in one task, made in strips. Where pivots spare nothing, as for low
    thresholds, there is one cell. Rows with a null id or vector are left out. blocks: takes so many blocks and no pivots.
    """
    own = vectors.select("id", "vector").dropna()
    kind = own.schema["id"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        left, right = _sides(rows, i, j)
        names, theirs, out = left["id"].to_numpy(), right["id"].to_numpy(), [pd.DataFrame({"a": [], "b": [], "sim": []})]
        for r, c, s in _strips(left, right, threshold):
            a, b = names[r], theirs[c]
            keep = a < b if i == j else a != b
            a, b, s = a[keep], b[keep], s[keep]
            swap = a > b
            out.append(pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "sim": s}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return _keyed(own, dealt or plan(vectors, threshold, blocks), kind).groupBy("cell", "i", "j").applyInPandas(run, f"a {kind}, b {kind}, sim double")


def _keyed(own: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """id, vector, own (its block), cell, i, j: a row for each pair of a cell's blocks that a vector takes part in."""
    other = _dealt(own, plan, kind).select("id", "vector", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other"))
    return other.select("id", "vector", "cell", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _sides(rows: pd.DataFrame, i: int, j: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    return tuple(rows[rows["own"] == k].sort_values("id") for k in (i, j))


def _strips(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places on the left, places on the right, products) of at least threshold, strip by strip of the left."""
    if not len(left) or not len(right):
        return
    x, y = np.stack(left["vector"].to_numpy()).astype(np.float64), np.stack(right["vector"].to_numpy()).astype(np.float64)
    step = max(1, CELLS // len(y))
    for at in range(0, len(x), step):
        sims = x[at : at + step] @ y.T
        r, c = np.nonzero(sims >= threshold)
        yield at + r, c, sims[r, c]


#: What a block tells of a vector's neighbourhood: how many neighbours, and the upper and lower halves of two sums of their hashes.
_HOOD = ("n", "u1", "l1", "u2", "l2")


def hoods(vectors: DataFrame, thresholds: Sequence[float], blocks: int | None = None) -> DataFrame:
    """level (the threshold's place), id, n, u1, l1, u2, l2: how many neighbours of each threshold an id has, and sums of their hashes, for ids that have some.

    Ids must not repeat. No pair is a row: a block adds up what each of its vectors meets, so what is shuffled is a row for each vector and block it meets.
    """
    own, low = vectors.select("id", "vector").dropna(), min(thresholds)
    kind = own.schema["id"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        sides = _sides(rows, i, j)
        hashes = [[side[h].to_numpy(np.int64).view(np.uint64) for h in ("h1", "h2")] for side in sides]
        total = [[[np.zeros(len(side), np.uint64) for _ in range(3)] for side in sides] for _ in thresholds]
        for r, c, s in _strips(*sides, low):
            if i == j:
                r, c, s = (v[r < c] for v in (r, c, s))
            for t, level in zip(thresholds, total):
                near = s >= t
                ends = (r[near], c[near])
                for k, (n, *sums) in enumerate(level):
                    n += np.bincount(ends[k], minlength=len(n)).astype(np.uint64)
                    for own_sum, h in zip(sums, hashes[1 - k]):
                        np.add.at(own_sum, ends[k], h[ends[1 - k]])  # modulo 2^64
        out = []
        for at, level in enumerate(total):
            for side, (n, *sums) in zip(sides, level):
                some = n > 0
                halves = [half[some].astype(np.int64) for own_sum in sums for half in (own_sum >> np.uint64(32), own_sum & np.uint64(0xFFFFFFFF))]
                out.append(pd.DataFrame({"level": at, "id": side["id"].to_numpy()[some], **dict(zip(_HOOD, (n[some].astype(np.int64), *halves)))}))
        return pd.concat(out, ignore_index=True)

    keyed = _keyed(own, plan(vectors, low, blocks), kind).select("*", F.xxhash64("id").alias("h1"), F.xxhash64(F.lit("hood"), "id").alias("h2"))
    parts = keyed.groupBy("cell", "i", "j").applyInPandas(run, f"level int, id {kind}, " + ", ".join(f"{c} bigint" for c in _HOOD))
    return parts.groupBy("level", "id").agg(*(F.sum(c).alias(c) for c in _HOOD))


def cliques(vectors: DataFrame, thresholds: Sequence[float], blocks: int | None = None) -> DataFrame:
    """M3: level (the threshold's place), cluster (sorted ids): the components of similar vectors whose members are all similar; a row a cluster.

    Ids of one closed neighbourhood are all near each other, and are a whole component if the neighbourhood is as large as they are many. So :func:`hoods`
    are grouped by their size and 128 bits of hash, and neither pairs nor components are made. An id with several vectors is near what any of them is
    near, which sums cannot tell: such tables go by pairs.
    """
    own = vectors.select("id", "vector").dropna().distinct()
    if not own.groupBy("id").count().where("count > 1").isEmpty():
        pairs = cut(similar_pairs(own, min(thresholds), blocks))
        every = [clusters(pairs.where(F.col("sim") >= t)).select(F.lit(at).alias("level"), "cluster").where(F.col("id") == F.col("cluster")[0]) for at, t in enumerate(thresholds)]
        return reduce(DataFrame.union, every)
    mask, whole = F.lit(0xFFFFFFFF), F.lit(1 << 32)
    closed = ["level", "n"]
    for u, l, h in (("u1", "l1", F.xxhash64("id")), ("u2", "l2", F.xxhash64(F.lit("hood"), "id"))):
        lower = F.col(l) + h.bitwiseAND(mask)
        closed += [F.pmod(F.col(u) + F.shiftrightunsigned(h, 32) + F.shiftright(lower, 32), whole).alias(u), lower.bitwiseAND(mask).alias(l)]
    groups = hoods(own, thresholds, blocks).select(*closed, "id").groupBy("level", *_HOOD).agg(F.count("*").alias("__n"), F.array_sort(F.collect_list("id")).alias("cluster"))
    return groups.where("__n = n + 1").select("level", "cluster")


def merge_forest(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """M3: a, b, sim of the links by which single linkage merges, at most one fewer than ids: a maximum spanning forest of the pairs (a, b, sim).

    The components of its links of sim >= t are those of all such pairs, for any t, so one forest gives every cut. Each round takes the best link of
    every tree (ties by a and b) and keeps the best link between two trees only (Boruvka), so trees halve at least; tables are written, none is gathered.
    """
    first = F.max_by(F.struct("a", "b", "sim"), F.struct("sim", F.struct("a", "b"))).alias("e")
    live = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    with scratch():
        live = written(live.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "sim"), "live")
        parts = []
        for _ in range(most_rounds):
            ends = live.select(F.col("x").alias("t"), "a", "b", "sim", "x", "y").union(live.select("y", "a", "b", "sim", "x", "y"))
            best = ends.groupBy("t").agg(F.max_by(F.struct("a", "b", "sim", "x", "y"), F.struct("sim", "a", "b")).alias("e"))
            chosen = written(best.select("e.*").distinct(), "chosen", keep=True)
            if chosen.isEmpty():
                break
            parts.append(chosen.select("a", "b", "sim"))
            roots = written(components(chosen.select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")
            for side in ("x", "y"):
                to = roots.select(F.col("node").alias(side), F.col("root").alias("__r"))
                live = live.join(to, side, "left").withColumn(side, F.coalesce("__r", side)).drop("__r")
            live = live.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "a", "b", "sim")
            live = written(live.groupBy("x", "y").agg(first).select("x", "y", "e.*"), "live")
        else:
            raise RuntimeError(f"the forest did not settle in {most_rounds} rounds")
        out = pairs.select("a", "b", F.col("sim").cast("double").alias("sim")).where("false")
        for part in parts:
            out = out.union(part)
        return written(out, "forest", keep=True)


def cut_at(forest: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """M3: id, cluster (its sorted members) at one threshold: components of the forest's links whose members are all similar; others are alone and not told.

    All members are similar if the component of n has n * (n - 1) / 2 pairs of the threshold.
    """
    with scratch():
        roots = written(components(forest.where(F.col("sim") >= threshold).select("a", "b")), "roots", keep=True)
    inside = pairs.where(F.col("sim") >= threshold).join(roots, pairs["a"] == roots["node"]).groupBy("root").agg(F.count("*").alias("m"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    whole = sizes.join(inside, "root").where("2 * m = n * (n - 1)").select("root")
    members = roots.join(whole, "root").groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("cluster"))
    return members.select(F.explode("cluster").alias("id"), "cluster")


def clusters(pairs: DataFrame) -> DataFrame:
    """M3: id, cluster (the sorted members) of every id in a component of pairs (a, b) that is a clique; others are alone.

    No iteration: a component is a clique exactly if all its members have the same closed neighbourhood. Neighbourhoods are compared by
    their size and 128 bits of hash, so that an edge carries three numbers; only the members of cliques are gathered.
    """
    near = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    hashes = lambda c: (F.xxhash64(c), F.xxhash64(F.lit("hood"), c))
    h1, h2 = hashes(F.col("b"))
    hoods = near.groupBy("a").agg(F.count("*").alias("n"), F.bit_xor(h1).alias("h1"), F.bit_xor(h2).alias("h2"))
    g1, g2 = hashes(F.col("a"))
    hoods = hoods.select("a", F.struct("n", F.col("h1").bitwiseXOR(g1).alias("h1"), F.col("h2").bitwiseXOR(g2).alias("h2")).alias("hood"))
    other = hoods.select(F.col("a").alias("b"), F.col("hood").alias("other"))
    same = near.join(hoods, "a").join(other, "b").groupBy("a").agg(F.bool_and(F.col("hood") == F.col("other")).alias("same")).where("same")
    return near.join(same, "a", "left_semi").groupBy("a").agg(F.collect_list("b").alias("n")).select(F.col("a").alias("id"), F.array_sort(F.array_append("n", F.col("a"))).alias("cluster"))


def canonical_names(entities: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entity, canonical, sim; the shortest name of the cluster, then the first; sim to it, 1 for itself.

    found and pairs have entity names as ids.
    """
    name = F.array_min(F.transform("cluster", lambda e: F.struct(F.length(e).alias("n"), e.alias("e"))))["e"]
    own = entities.join(found.select(F.col("id").alias("entity"), name.alias("c")), "entity", "left").select("entity", F.coalesce("c", "entity").alias("canonical"))
    sims = pairs.select(F.col("a").alias("entity"), F.col("b").alias("canonical"), "sim").union(pairs.select("b", "a", "sim"))
    return own.join(sims, ["entity", "canonical"], "left").select("entity", "canonical", F.when(F.col("entity") == F.col("canonical"), 1.0).otherwise(F.col("sim")).alias("sim"))


def resolved_names(entities: DataFrame, vectors: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """What :func:`canonical_names` gives, from the vectors (id, vector) themselves: no table of pairs is made, and sim is told of merged names only.

    Of an entity with several vectors sim is the largest.
    """
    name = F.array_min(F.transform("cluster", lambda e: F.struct(F.length(e).alias("n"), e.alias("e"))))["e"]
    merged = cliques(vectors, [threshold], blocks).select("cluster", name.alias("canonical")).select(F.explode("cluster").alias("entity"), "canonical").where("entity <> canonical")
    side = lambda c, v: vectors.dropna().select(F.col("id").alias(c), F.col("vector").alias(v))
    sims = merged.join(side("entity", "__x"), "entity").join(side("canonical", "__y"), "canonical").groupBy("entity", "canonical").agg(F.max(dot(F.col("__x"), F.col("__y"))).alias("sim"))
    own = entities.join(sims, "entity", "left")
    return own.select("entity", F.coalesce("canonical", "entity").alias("canonical"), F.when(F.col("canonical").isNull(), 1.0).otherwise(F.col("sim")).alias("sim"))


def merge_log(names: DataFrame) -> DataFrame:
    """Canonical, n_members, members (name, sim; sorted) of merged clusters, largest first."""
    members = F.array_sort(F.collect_list(F.when(F.col("entity") != F.col("canonical"), F.struct(F.col("entity").alias("name"), F.round("sim", 4).alias("sim")))))
    return names.groupBy("canonical").agg(F.count("*").alias("n_members"), members.alias("members")).where("n_members > 1").orderBy(F.desc("n_members"), "canonical")


def merge_counts(names: DataFrame, threshold: float) -> DataFrame:
    """S21's header, one row."""
    sizes = names.groupBy("canonical").agg(F.count("*").alias("n"))
    return sizes.agg(F.lit(threshold).alias("threshold"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_entities"), F.count("*").alias("n_canonical"), F.count_if(F.col("n") > 1).alias("n_merged"), F.count_if(F.col("n") == 1).alias("n_single"))
