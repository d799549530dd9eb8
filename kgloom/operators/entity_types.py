"""Entity types from prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.vectors import dot

#: Rows of a prototype catalog at most: with vectors of 1,024 numbers 80 MB, which is what an executor gets.
MOST_PROTOTYPES = 10_000


def prototypes(catalog: DataFrame) -> DataFrame:
    """type_idx, type, text: for each type its name, name and description (80 characters), and examples.

    catalog has name, description, examples and idx, the type's place.
    """
    told = F.when(F.coalesce("description", F.lit("")) != "", F.array(F.concat("name", F.lit(": "), F.substring("description", 1, 80)))).otherwise(F.array().cast("array<string>"))
    return catalog.select(F.col("idx").alias("type_idx"), F.col("name").alias("type"), F.explode(F.concat(F.array("name"), told, F.coalesce("examples", F.array().cast("array<string>")))).alias("text"))


def type_scores(entities: DataFrame, protos: DataFrame) -> DataFrame:
    """Entity, type_idx, type, score: the best prototype of each type, at least 0.

    protos (type_idx, type, vector) is a catalog: a few hundred rows, packed into one row that every entity meets. Scores are made within an
    entity's row, so nothing is shuffled. A catalog of more than MOST_PROTOTYPES rows is no catalog and raises. Entities are distinct.
    """
    n = protos.count()
    if n > MOST_PROTOTYPES:
        raise ValueError(f"{n} prototypes; at most {MOST_PROTOTYPES} can be sent to every executor")
    own = protos.groupBy("type_idx", "type").agg(F.collect_list("vector").alias("vectors"))
    packed = own.agg(F.array_sort(F.collect_list(F.struct("type_idx", "type", "vectors"))).alias("__types"))
    best = lambda t: F.array_max(F.transform(t["vectors"], lambda v: dot(F.col("vector"), v)))
    scored = F.transform("__types", lambda t: F.struct(t["type_idx"].alias("type_idx"), t["type"].alias("type"), F.greatest(best(t), F.lit(0.0)).alias("score")))
    return entities.crossJoin(F.broadcast(packed)).select("entity", F.inline(scored))


def best_types(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Entity, type, score of the best type, the first of equals, if it reaches the threshold."""
    best = scores.groupBy("entity").agg(F.max_by(F.struct("type", "score"), F.struct("score", -F.col("type_idx"))).alias("b"))
    return best.select("entity", "b.type", "b.score").where(F.col("score") >= threshold)


def untyped(scores: DataFrame, threshold: float = 0.5, k: int = 20) -> DataFrame:
    """The k entities below the threshold that come nearest to it."""
    return scores.groupBy("entity").agg(F.max("score").alias("score")).where(F.col("score") < threshold).orderBy(F.desc("score"), "entity").limit(k)


def type_histogram(types: DataFrame) -> DataFrame:
    """A5."""
    return types.groupBy("type").agg(F.count("*").alias("n"))
