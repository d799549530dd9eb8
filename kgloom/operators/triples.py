"""Triples: keyed dedup in which the first wins, mapping to canonical names, filters by schema, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.rx import strip

KEY = ("head", "relation", "tail")
#: Stands where a relation is missing (fixed value).
UNKNOWN = "未知"


def dedup(triples: DataFrame, *keys: str) -> DataFrame:
    """Of the triples of a key, the one with the smallest ord; one partial and one final aggregation."""
    keys = keys or KEY
    rest = [c for c in triples.columns if c not in keys]
    first = triples.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("__first"))
    return first.select(*(c if c in keys else F.col(f"__first.`{c}`").alias(c) for c in triples.columns))


def trimmed(triples: DataFrame) -> DataFrame:
    """P19."""
    return triples.withColumns({c: strip(F.col(c)) for c in KEY})


def with_defaults(triples: DataFrame) -> DataFrame:
    """P29: "" for missing texts, 0 for missing scores."""
    texts, scores = ("source", "method", "head_type", "tail_type"), ("head_type_score", "tail_type_score")
    out = {c: F.coalesce(c, F.lit("")) for c in texts if c in triples.columns} | {c: F.coalesce(c, F.lit(0.0)) for c in scores if c in triples.columns}
    return triples.withColumns(out)


def entities(triples: DataFrame) -> DataFrame:
    """Distinct heads and tails, from one scan."""
    return triples.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


def mapped(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Heads and tails by (entity, canonical); what the mapping lacks maps to itself."""
    out = triples
    for side in ("head", "tail"):
        own = mapping.select(F.col("entity").alias(side), F.col("canonical").alias("__to"))
        out = out.join(own, side, "left").withColumn(side, F.coalesce("__to", side)).drop("__to")
    return out.select(*triples.columns)


def in_schema(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations is a catalog; one row a relation name."""
    return triples.join(relations.select(F.col("name").alias("relation")), "relation", "left_semi").select(*triples.columns)


def schema_violations(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """A null relation violates, too."""
    return triples.join(relations.select(F.col("name").alias("relation")), "relation", "left_anti").select(*triples.columns)


def rejected_relations(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """Names that the schema lacks."""
    return schema_violations(triples, relations).select("relation").distinct()


def relation_histogram(triples: DataFrame, k: int | None = None) -> DataFrame:
    """Relation, n; the k most frequent, ties by name."""
    out = triples.groupBy(F.coalesce("relation", F.lit(UNKNOWN)).alias("relation")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "relation").limit(k) if k else out


def source_counts(unique: DataFrame) -> DataFrame:
    """Unique triples of each source, credited to the first."""
    return unique.groupBy("source").agg(F.count("*").alias("n_triples"))


def sizes(triples: DataFrame) -> DataFrame:
    """A3: exact counts, one row."""
    names = entities(triples).agg(F.count("entity").alias("n_entities"))
    return triples.agg(F.count("*").alias("n_triples"), F.count_distinct("relation").alias("n_relations")).crossJoin(names)


def examples(rows: DataFrame, k: int = 5, by: Column | str = "ord") -> DataFrame:
    """W9."""
    return rows.orderBy(by).limit(k)
