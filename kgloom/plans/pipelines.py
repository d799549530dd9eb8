"""Composites: clean, extract, normalise, postprocess, evaluate (P15, M4, M5, M7, M8, A21, Entry 1 to 5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.operators import entity_types, extract, metrics, resolve, rules, segment, triples as T
from kgloom.session import cut
from kgloom.sources import io


def cleaned(docs: DataFrame, with_tables: bool = True, with_images: bool = True) -> DataFrame:
    """doc_id, text, reduction (percent saved, null for an empty document)."""
    own = docs.select("doc_id", F.length("text").alias("__n"), X.before_tables(F.col("text")).alias("__t"))
    text = F.col("__t")
    if with_tables:  # only texts with a table go to Python; the steps before are a projection of their own, so that they run once
        own = own.withColumn("__held", X.tables(F.when(F.contains("__t", F.lit("<table")), text)))
        text = F.coalesce("__held", text)
    out = own.select("doc_id", "__n", X.after_tables(text, with_images).alias("text"))
    return out.select("doc_id", "text", X.reduction(F.col("__n"), F.length("text")).alias("reduction"))


def preprocess(spark: SparkSession, source: str, target: str, split_chapters: bool = False, sentence_mode: bool = False, with_tables: bool = True, with_images: bool = True) -> int:
    """Cleans a folder's Markdown files and writes as many files under their own names, or a file for each chapter, or one of sentences for each; the number of documents.

    A folder that is not there raises.
    """
    n, docs = io.markdown_count(spark, source), io.markdown(spark, source)
    clean = cleaned(docs, with_tables, with_images)
    if split_chapters:
        files = segment.chapter_files(segment.chapters(clean))
    elif sentence_mode:
        files = segment.sentence_files(clean)
    else:
        files = clean.select(F.concat("doc_id", F.lit(".md")).alias("file"), "text")
    io.write_files(files, target)
    return n


def extracted(docs: DataFrame, relations: DataFrame, model: Callable[[], extract.Extractor], max_chars: int = 150, terminators: str = X.SENTENCE_ENDS, method: str = extract.METHOD) -> DataFrame:
    """Chunks to triples, the first of equal ones, with source (the document), method and ord.

    ord is (file, chunk_no, batch_no, item_no): files come in the order of their names, and facts of one answer in its own order. A triple is
    credited to the first file that has it. The smallest ord of each triple needs no sort.
    """
    chunks = segment.chunks(docs, max_chars, terminators)
    found = extract.extract(chunks, extract.schema_batches(relations), model)
    file = F.concat("doc_id", F.lit(".md")) if docs.schema["doc_id"].dataType.simpleString() == "string" else F.col("doc_id")
    place = F.struct(file.alias("file"), "chunk_no", "batch_no", "item_no")
    first = found.groupBy("head", "relation", "tail").agg(F.min(F.struct(place.alias("ord"), "doc_id")).alias("f"))
    return first.select("head", "relation", "tail", F.col("f.doc_id").cast("string").alias("source"), F.lit(method).alias("method"), "f.ord")


def normalized(triples: DataFrame, vectors: DataFrame, threshold: float = 0.93, relations: DataFrame | None = None, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M4: (triples, names): names resolved by the vectors (id, vector) of the entities, then the relation filter, then dedup.

    The filter comes after resolution: triples of other relations still contribute entities.
    """
    own = T.trimmed(triples)
    names = cut(resolve.resolved_names(T.entities(own), vectors, threshold, blocks))
    out = T.mapped(own, names)
    if relations is not None:
        out = T.in_schema(out, relations)
    return T.dedup(out).withColumn("method", F.lit("normalized")), names


def typed(entities: DataFrame, protos: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M5: entity, type, score from vectors of entities and prototypes."""
    return entity_types.best_types(entity_types.type_scores(entities, protos), threshold)


def postprocessed(triples: DataFrame, relations: DataFrame, types: DataFrame | None = None, check: bool = True, complete: bool = True, resolve_mutex: bool = True) -> DataFrame:
    """M8: types annotated, types checked (only where some entity has one), symmetric triples completed, conflicts resolved, in this order."""
    out = triples
    if types is not None:
        out = rules.with_types(out, types)
        if check and not types.isEmpty():
            out = rules.check_types(out, relations).where("ok").drop("ok")
    if complete:
        out = rules.complete_symmetric(cut(out), metrics.symmetric_of(relations))
    if resolve_mutex:
        out = rules.resolve_mutex(cut(out), metrics.mutex_of(relations))
    return T.with_defaults(out)


def evaluated(docs: DataFrame, relations: DataFrame, gold_entities: DataFrame, gold: DataFrame, model: Callable[[], extract.Extractor], encoder: Callable[[], extract.Encoder], threshold: float = 0.93) -> DataFrame:
    """A21, Entry 2: documents all the way to the metrics document."""
    raw = cut(extracted(docs, relations, model))
    vectors = cut(extract.encode(T.entities(T.trimmed(raw)).withColumnRenamed("entity", "id"), encoder, "id"))
    own, _ = normalized(raw, vectors, threshold, relations)
    return metrics.evaluation(cut(postprocessed(own, relations)), gold_entities, gold, relations)
