"""Curation of truth sets: difference, union, referential clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = ("head", "relation", "tail")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """U1."""
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks."""
    return a.subtract(b.select(*a.columns))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.union(b.select(*a.columns)).distinct()


def unused(catalog: DataFrame, used: DataFrame) -> DataFrame:
    """Names of the catalog that used (relation) lacks."""
    return catalog.select(F.col("name").alias("relation")).distinct().join(used.select("relation"), "relation", "left_anti")


def referential(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): relations whose ends are both entities, repeated ones included, and the entities that they use."""
    names = entities.select("entity").distinct()
    kept = relations
    for side in ("head", "tail"):
        kept = kept.join(names.withColumnRenamed("entity", side), side, "left_semi")
    kept = kept.select(*relations.columns)
    return names.join(kept.select(F.explode(F.array("head", "tail")).alias("entity")), "entity", "left_semi"), kept


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """T4, T5: code-point order."""
    return rows.orderBy(*(by or FACT))


def first_seen(triples: DataFrame) -> DataFrame:
    """Entity, first_ord, first_side in the order in which entities come up, heads before tails."""
    ends = triples.select("ord", F.posexplode(F.array("head", "tail")).alias("side", "entity"))
    seen = ends.groupBy("entity").agg(F.min(F.struct("ord", "side")).alias("s"))
    return seen.select("entity", F.col("s.ord").alias("first_ord"), F.col("s.side").alias("first_side"))


def graph_document(triples: DataFrame) -> DataFrame:
    """G9's sink: one row with entities in the order of first sight and relations as they come; for documents, not corpora."""
    names = first_seen(triples).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "first_side", "entity"))), lambda s: s["entity"]).alias("entities"))
    facts = triples.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *FACT))), lambda s: F.struct(*(s[c].alias(c) for c in FACT))).alias("relations"))
    return names.crossJoin(facts)
