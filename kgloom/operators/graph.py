"""The property graph and its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import relation_label
from kgloom.operators.triples import entities

#: Bins of connectivity (fixed values).
BINS = ("0", "1-5", "6-10", "11-20", "20+")


def nodes(triples: DataFrame) -> DataFrame:
    """S17."""
    return entities(triples).withColumnRenamed("entity", "name")


def edges(triples: DataFrame) -> DataFrame:
    """Src, rel_type, dst with source and method of the first that names the edge."""
    own = triples.select(F.col("head").alias("src"), relation_label(F.col("relation")).alias("rel_type"), F.col("tail").alias("dst"), "source", "method", "ord")
    return own.groupBy("src", "rel_type", "dst").agg(F.min_by(F.struct("source", "method"), "ord").alias("f")).select("src", "rel_type", "dst", "f.source", "f.method")


def connectivity(triples: DataFrame) -> DataFrame:
    """Entity, degree: distinct neighbours, itself included where it has a loop."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("head").alias("e"), F.col("tail").alias("n")), F.struct(F.col("tail").alias("e"), F.col("head").alias("n")))).alias("x"))
    return ends.select("x.e", "x.n").distinct().groupBy(F.col("e").alias("entity")).agg(F.count("*").alias("degree"))


def connectivity_stats(triples: DataFrame) -> DataFrame:
    """One row; zeros for an empty graph. An entity always has a neighbour, so none is isolated."""
    d = F.col("degree")
    z = lambda c: F.coalesce(c, F.lit(0))
    return connectivity(triples).agg(F.count("*").alias("total_entities"), F.count_if(d == 0).alias("isolated_entities"), F.coalesce(F.try_divide(F.count_if(d == 0), F.count("*")), F.lit(0.0)).alias("isolated_rate"), F.coalesce(F.avg(d), F.lit(0.0)).alias("avg_connectivity"), z(F.max(d)).alias("max_connectivity"), z(F.min(d)).alias("min_connectivity"))


def bin_of(degree: Column) -> Column:
    return F.when(degree == 0, BINS[0]).when(degree <= 5, BINS[1]).when(degree <= 10, BINS[2]).when(degree <= 20, BINS[3]).otherwise(BINS[4])


def connectivity_bins(triples: DataFrame) -> DataFrame:
    """Bin, n, with zeros for bins that nothing is in."""
    counts = connectivity(triples).agg(*(F.count_if(bin_of(F.col("degree")) == b).alias(f"b{i}") for i, b in enumerate(BINS)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(b).alias("bin"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BINS)))))


def mentions(triples: DataFrame) -> DataFrame:
    """Entity, n, first_ord: the mentions of each entity, two a triple."""
    return triples.select("ord", F.explode(F.array("head", "tail")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def mention_stats(triples: DataFrame) -> DataFrame:
    """One row."""
    return mentions(triples).agg(F.count("*").alias("total_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_mentions"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_mentions_per_entity"))


def source_mentions(triples: DataFrame) -> DataFrame:
    """Source, n_triples: the triples of each source, repeated ones included."""
    return triples.where("source is not null").groupBy("source").agg(F.count("*").alias("n_triples"))


def top_entities(triples: DataFrame, k: int = 10) -> DataFrame:
    """Ties by first sight, then by name."""
    return mentions(triples).orderBy(F.desc("n"), "first_ord", "entity").limit(k)


def density(triples: DataFrame) -> DataFrame:
    """A16, A11 on raw names: one row."""
    n, r = F.col("entity_count").cast("double"), F.col("relation_count")
    counts = triples.agg(F.count("*").alias("relation_count")).crossJoin(entities(triples).agg(F.count("*").alias("entity_count")))
    most = F.when(F.col("entity_count") > 1, n * (n - 1)).otherwise(0.0)
    return counts.select("entity_count", "relation_count", most.cast("bigint").alias("max_possible_relations"), F.coalesce(F.try_divide(r, most), F.lit(0.0)).alias("density"), F.coalesce(F.try_divide(n, r), F.lit(0.0)).alias("entity_relation_ratio"))
