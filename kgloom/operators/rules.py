"""Rules of the schema: symmetry, mutual exclusion, transitivity, type constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a missing type in a reason (fixed value).
UNTYPED = "未标注"


def symmetric_violations(triples: DataFrame, symmetric: DataFrame) -> DataFrame:
    """Distinct (head, relation, tail) of a symmetric relation (column relation) whose inverse is missing."""
    own = triples.join(symmetric.select("relation"), "relation", "left_semi").select("head", "relation", "tail").distinct()
    inverse = own.select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"))
    return own.join(inverse, ["head", "relation", "tail"], "left_anti")


def complete_symmetric(triples: DataFrame, symmetric: DataFrame) -> DataFrame:
    """Adds the missing inverses, with the source of the first triple that lacks one."""
    own = triples.join(symmetric.select("relation"), "relation", "left_semi")
    first = own.groupBy("head", "relation", "tail").agg(F.min_by(F.struct("source", "ord"), "ord").alias("f"))
    inverse = first.select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"))
    added = first.join(inverse, ["head", "relation", "tail"], "left_anti").select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"), "f.source", F.lit("symmetric_completion").alias("method"), "f.ord")
    return triples.unionByName(added, allowMissingColumns=True)


def mutex_violations(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Head, tail, r1, r2 for each declared direction (columns r1, r2) of which a head and tail have both."""
    own = triples.select("head", "tail", "relation").distinct()
    one = own.join(pairs, F.col("relation") == F.col("r1")).select("head", "tail", "r1", "r2")
    return one.join(own.withColumnRenamed("relation", "r2"), ["head", "tail", "r2"]).select("head", "tail", "r1", "r2")


def resolve_mutex(triples: DataFrame, pairs: DataFrame, preferred: str = "normalized") -> DataFrame:
    """Where a head and tail have a conflicting pair, one triple stays: of the preferred method first, then of the smallest relation.

    Conflicts are order-aware: (r1, r2) counts if a triple of r1 comes before one of r2. Conflict-free groups pass unchanged. Only triples of relations that
    exclude some other are aggregated, to the first and last place of each relation of a head and tail; the catalog of pairs is one packed row.
    """
    sides = pairs.select(F.explode(F.array("r1", "r2")).alias("relation")).distinct()
    spans = triples.join(F.broadcast(sides), "relation", "left_semi").groupBy("head", "tail", "relation").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    own = spans.groupBy("head", "tail").agg(F.collect_list(F.struct("relation", "lo", "hi")).alias("own")).where(F.size("own") > 1)
    packed = pairs.where("r1 is not null and r2 is not null").agg(F.collect_set(F.struct("r1", "r2")).alias("pairs"))
    meets = lambda p: F.exists("own", lambda x: (x["relation"] == p["r1"]) & F.exists("own", lambda y: (y["relation"] == p["r2"]) & (x["lo"] < y["hi"])))
    bad = own.crossJoin(F.broadcast(packed)).where(F.exists("pairs", meets)).select("head", "tail")
    rank = F.struct(F.when(F.col("method") == preferred, 0).otherwise(1), "relation", "ord")
    rest = [c for c in triples.columns if c not in ("head", "tail")]
    kept = triples.join(bad, ["head", "tail"], "left_semi").groupBy("head", "tail").agg(F.min_by(F.struct(*rest), rank).alias("k")).select("head", "tail", *(F.col(f"k.`{c}`").alias(c) for c in rest))
    return triples.join(bad, ["head", "tail"], "left_anti").select(*triples.columns).unionByName(kept)


#: Edges of one side of a middle that meet in one task.
HUB = 1024


def _paths(edges: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """(relation, a, b, c for all paths a-b-c; relation, a, c for all edges). A middle's edges are dealt into blocks of about hub, and each pair of blocks is a key of the join."""
    own = edges.select("relation", "head", "tail").distinct()
    ends = own.select("relation", F.col("tail").alias("b"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(own.select("relation", "head", F.lit(0), F.lit(1)))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / hub)).cast("bigint")
    middles = ends.groupBy("relation", "b").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).where("n_in > 0 and n_out > 0").select("relation", "b", blocks("n_in").alias("ins"), blocks("n_out").alias("outs"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = own.select("relation", F.col("head").alias("a"), F.col("tail").alias("b")).join(middles, ["relation", "b"])
    left = left.select("relation", "a", "b", F.pmod(F.xxhash64("a"), F.col("ins")).alias("i"), every("outs").alias("o"))
    right = own.select("relation", F.col("head").alias("b"), F.col("tail").alias("c")).join(middles, ["relation", "b"])
    right = right.select("relation", "b", "c", F.pmod(F.xxhash64("c"), F.col("outs")).alias("o"), every("ins").alias("i"))
    return left.join(right, ["relation", "b", "i", "o"]), own.select("relation", F.col("head").alias("a"), F.col("tail").alias("c"))


def transitive_gaps(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """Relation, a, b, c for each path a-b-c of one relation without an edge a-c; edges are distinct (head, relation, tail).

    Every path through a hub is a row, but no task makes those of more than hub x hub edges for one key.
    """
    paths, closed = _paths(edges, hub)
    return paths.join(closed, ["relation", "a", "c"], "left_anti").select("relation", "a", "b", "c")


def gap_counts(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """Relation, a, c, n: how many paths lead from a to c where no edge does. Paths are added up where they arise, so only ends are shuffled."""
    paths, closed = _paths(edges, hub)
    return paths.groupBy("relation", "a", "c").agg(F.count("*").alias("n")).join(closed, ["relation", "a", "c"], "left_anti")


def substring_keys(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inner, g; outer, g) for J9: one gram of each name, and all of its grams (as hashes) whose lengths are powers of 2.

    The one gram is as long as half the name at least, and of those the one that the fewest names hold: a beginning that many names have in common is
    no key as long as something else tells them apart.
    """
    own = names.select("entity").where(F.length("entity") > 0).distinct()
    n = F.length("entity")
    grams = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(size, F.substring(F.col("entity"), i, size)))
    sizes = F.transform(F.sequence(F.lit(0), F.floor(F.log2(n.cast("double"))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    # log2 may be a hair too low or high: what does not fit goes
    fitting = F.filter(sizes, lambda size: size <= n)
    every = own.select("entity", F.explode(F.array_distinct(F.flatten(F.transform(fitting, grams)))).alias("g"))
    half = own.select("entity", F.explode(F.array_distinct(grams(F.array_max(fitting)))).alias("g"))
    often = every.groupBy("g").agg(F.count("*").alias("__n"))
    rarest = half.join(often, "g").groupBy("entity").agg(F.min_by("g", F.struct("__n", "g")).alias("g"))
    return rarest.select(F.col("entity").alias("inner"), "g"), every.select(F.col("entity").alias("outer"), "g")


def substring_pairs(names: DataFrame) -> DataFrame:
    """entity_1 < entity_2 of which one holds the other.

    No pairs are tried: the shorter one's rarest gram of half its length must occur in the longer one, so names meet on it, and candidates are verified.
    """
    short, long = substring_keys(names)
    met = short.join(long, "g").where((F.length("inner") < F.length("outer")) & F.contains("outer", "inner"))
    return met.select(F.least("inner", "outer").alias("entity_1"), F.greatest("inner", "outer").alias("entity_2"))


def with_types(triples: DataFrame, types: DataFrame) -> DataFrame:
    """head_type, head_type_score, tail_type, tail_type_score from (entity, type, score); null where there is none."""
    out = triples
    for side in ("head", "tail"):
        own = types.select(F.col("entity").alias(side), F.col("type").alias(f"{side}_type"), F.col("score").alias(f"{side}_type_score"))
        out = out.drop(f"{side}_type", f"{side}_type_score").join(own, side, "left")
    return out


def _allowed(types: str, allowed: str) -> Column:
    """An untyped end, an unknown relation and an empty list of types all allow."""
    none = F.col(types).isNull() | (F.col(types) == "")
    return none | F.col(allowed).isNull() | (F.size(allowed) <= 0) | F.array_contains(F.col(allowed), F.col(types))


def check_types(typed: DataFrame, relations: DataFrame) -> DataFrame:
    """Typed triples with ok, by the head_types and tail_types of the relation's catalog row."""
    catalog = relations.select(F.col("name").alias("relation"), F.col("head_types").alias("__h"), F.col("tail_types").alias("__t"))
    joined = typed.join(catalog, "relation", "left")
    return joined.withColumn("ok", _allowed("head_type", "__h") & _allowed("tail_type", "__t")).select(*typed.columns, "ok")


def rejection_reasons(checked: DataFrame, k: int | None = 30) -> DataFrame:
    """Reason, n of the triples that are not ok, most frequent first, ties by reason."""
    kind = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNTYPED))
    reason = F.concat(F.col("relation"), F.lit(": head="), kind("head_type"), F.lit(", tail="), kind("tail_type"))
    out = checked.where(~F.col("ok")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "reason").limit(k) if k else out
