"""Readers and writers (S1-S4, S6-S10, S12-S17, S20): Spark's own, so any store that Spark reads will do."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom import schemas
from kgloom.operators import graph
from kgloom.operators.metrics import label_of

UNDEFINED = chr(0xFFFD)
SUFFIX = ".md"
#: Bytes of files in a batch, about, and names in one at most.
READ_BYTES, LISTED = 8 << 20, 10_000
#: Files that are worth a task of their own, beyond a task a core; there are never more tasks than shuffle partitions.
TASK_FILES = 512


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, length of the PDF files in a folder, sorted; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "length").orderBy("path")


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped, a line that is no JSON fails the job, no file gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """S3, S4."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def decoded(content: Column) -> Column:
    """Bytes as text: what is no UTF-8 is left out, every line ends in a line feed."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit(UNDEFINED), F.lit(""))
    return F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), F.lit(r"\.[^.]*$"), F.lit(""))


def markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id (the file's stem), path, text of the Markdown files of folders or of one file; a missing path raises.

    Tasks list the folders, one a folder, and read the files that the paths deal to them, so the driver holds no list of files and no task is made for a
    few of them. Paths that pyarrow.fs does not open, and patterns, are left to Spark's reader, which lists in the driver.
    Empty files give no rows. Rows come in no order; whoever credits facts to files (pipelines.extracted) orders by the files' names.
    """
    names = _names(spark, paths)
    if names is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(list(paths))
    else:
        store, listed = names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, size = [], 0
                for path, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    with store.open_input_file(own) as file:
                        held.append((path, file.read()))
                    size += len(held[-1][1])
                    if size >= READ_BYTES:
                        yield _batch(held, "path", "content")
                        held, size = [], 0
                if held:
                    yield _batch(held, "path", "content")

        tasks = max(spark.sparkContext.defaultParallelism, listed.count() // TASK_FILES)
        files = listed.repartition(min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(run, "path string, content binary")
    return files.select(stem(F.col("path")).alias("doc_id"), "path", decoded(F.col("content")).alias("text"))


def markdown_count(spark: SparkSession, *paths: str) -> int:
    """How many rows markdown has just now; no file is opened."""
    names = _names(spark, paths)
    return (markdown(spark, *paths) if names is None else names[1]).count()


def _names(spark: SparkSession, paths: tuple[str, ...]) -> tuple[fs.FileSystem, DataFrame] | None:
    """The store of the paths and their Markdown files (path as Spark shows it, own as the store does), listed by tasks; None if only Spark's reader will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    placed = [_placed(*hadoop, p) for p in paths]
    if not all(placed) or any(not x[0].equals(placed[0][0]) for x in placed):
        return None
    store = placed[0][0]
    for path, info in zip(paths, store.get_file_info([x[1] for x in placed])):
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{path} does not exist")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shown, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if store.get_file_info(root).type == fs.FileType.File:
                    shown, infos = shown.rpartition("/")[0], [store.get_file_info(root)]
                else:
                    infos = store.get_file_info(fs.FileSelector(root))
                shown = shown.rstrip("/")
                for k in range(0, len(infos), LISTED):
                    own = [(f"{shown}/{i.base_name}", i.path) for i in infos[k : k + LISTED] if i.type == fs.FileType.File and i.size and i.base_name.endswith(SUFFIX) and not _hidden(i.base_name)]
                    if own:
                        yield _batch(own, "path", "own")

    folders = spark.createDataFrame([(shown, root) for _, root, shown in placed], "path string, own string")
    return store, folders.mapInArrow(run, "path string, own string")


def _placed(hadoop_path, configuration, path: str) -> tuple[fs.FileSystem, str, str] | None:
    """Store, the path there and as Spark shows it."""
    if any(c in path for c in "*?[{\\"):
        return None
    p = hadoop_path(path)
    p = p.getFileSystem(configuration).makeQualified(p)
    try:
        return *_opened(p.toUri().getPath() if p.toUri().getScheme() == "file" else p.toString()), p.toString()
    except (pa.ArrowException, OSError):
        return None


def _hidden(name: str) -> bool:
    """As Spark's readers have it."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names)


def write_documents(docs: DataFrame, path: str) -> None:
    """Parquet (doc_id, text)."""
    docs.select("doc_id", "text").write.mode("overwrite").parquet(path)


def write_files(rows: DataFrame, folder: str, parts: int = 0) -> int:
    """A file of UTF-8 text for each row (file, text) under its own name; how many were written.

    Tasks write under names of their attempt and move what is complete, so a repeated task leaves no half file. Of rows of one name one is left.
    Folders are any that pyarrow.fs opens, one that all executors share. parts: the files are dealt by their names over so many subfolders (part_folders),
    for one folder of millions is slow to write, and one task lists it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                within = f"{root}/{zlib.crc32(str(name).encode()) % parts}" if parts else root
                own = f"{within}/.{name}.{attempt}"
                with fs.open_output_stream(own) as out:
                    out.write((text or "").encode("utf-8", "surrogatepass"))
                fs.move(own, f"{within}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    fs, root = _opened(folder)
    for own in (root, *part_folders(root, parts)):
        fs.create_dir(own, recursive=True)
    return rows.select("file", "text").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def part_folders(folder: str, parts: int) -> list[str]:
    return [f"{folder}/{k}" for k in range(parts)]


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def without_done(sources: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What has not been produced yet."""
    return sources.join(done.select(*keys), list(keys), "left_anti")


def relation_types(spark: SparkSession, path: str) -> DataFrame:
    """The relation catalog, which must be a list; absent fields get their defaults; idx is a relation's place."""
    return _catalog(spark, path, schemas.RELATION_TYPE).select("idx", "name", F.coalesce("description", F.lit("")).alias("description"), *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("head_types", "tail_types")), F.coalesce("is_symmetric", F.lit(False)).alias("is_symmetric"), F.coalesce("mutex_with", F.array().cast("array<string>")).alias("mutex_with"))


def entity_types(spark: SparkSession, path: str) -> DataFrame:
    """S14."""
    return _catalog(spark, path, schemas.ENTITY_TYPE).select("idx", "name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def _catalog(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    whole = spark.read.option("wholetext", "true").text(path)
    if whole.where(~F.rlike("value", F.lit(r"\A\s*\["))).limit(1).count():
        raise ValueError(f"{path} is no list")
    return whole.select(F.posexplode(F.from_json("value", T.ArrayType(schema))).alias("idx", "r")).select("idx", "r.*")


def truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a truth set; entities may be names or objects with a name."""
    plain = T.StructType([T.StructField("entities", T.ArrayType(T.StringType())), schemas.TRUTH["relations"]])
    read = spark.read.option("multiLine", "true").schema(plain).json(path)
    name = F.coalesce(F.get_json_object("e", "$.name"), F.col("e"))
    return read.select(F.explode("entities").alias("e")).select(name.alias("entity")), read.select(F.inline("relations"))


def annotations(spark: SparkSession, path: str, entities: bool) -> DataFrame:
    """Annotated rows; is_correct is true, false or null."""
    read = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    read = read.toDF(*(c.lstrip("﻿").strip() for c in read.columns))
    label = next(c for c in read.columns if c.startswith("is_correct"))
    keys = ("entity",) if entities else ("head", "relation", "tail")
    return read.select(*keys, label_of(F.col(f"`{label}`")).alias("is_correct"), *(["comment"] if "comment" in read.columns else [F.lit(None).cast("string").alias("comment")]))


def write_graph(triples: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, anew; no triples is an error."""
    if triples.isEmpty():
        raise ValueError("there are no triples to load")
    graph.nodes(triples).write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges(triples).write.mode("overwrite").parquet(f"{path}/edges")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON document."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
