"""A property graph that grows load by load (S17): what is there stays as it is, what is new is added.

Each load writes new nodes and edges into a folder of its own and then a manifest that lists the folders of all loads. Manifests are numbered, and one of a
number that is there cannot be made, so of two loads at once one fails and says so; folders that no manifest lists are never read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from kgloom.operators import graph

NODES = "name string"
EDGES = "src string, rel_type string, dst string, source string, method string"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def loads(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number of the last manifest, folders of its loads in their order); 0 and none where nothing has been loaded."""
    jvm, root, fs = _hadoop(spark, path)
    if not fs.exists(root):
        return 0, []
    numbers = [int(m[1]) for f in fs.listStatus(root) if (m := re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName()))]
    if not numbers:
        return 0, []
    with_text = spark.read.option("wholetext", "true").text(f"{path}/manifest-{max(numbers):08d}.json").first()[0]
    return max(numbers), json.loads(with_text)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all loads."""
    _, folders = loads(spark, path)
    own = lambda kind, schema: spark.read.schema(schema).parquet(*(f"{path}/{f}/{kind}" for f in folders)) if folders else spark.createDataFrame([], schema)
    return own("nodes", NODES), own("edges", EDGES)


def merge_graph(triples: DataFrame, path: str) -> int:
    """Adds the nodes and edges of triples that the graph lacks, and tells the number of the new manifest; an edge that is there keeps its source and method.

    Loading triples twice, or in two parts, gives the graph of one load of both, where an edge has the source of the first load that named it, and within a load
    that of the first triple. No triples is an error, as for a load anew.
    """
    spark = triples.sparkSession
    if triples.isEmpty():
        raise ValueError("there are no triples to load")
    number, folders = loads(spark, path)
    nodes, edges = read_graph(spark, path)
    own = f"load-{uuid.uuid4().hex}"
    graph.nodes(triples).join(nodes, "name", "left_anti").write.parquet(f"{path}/{own}/nodes")
    named = ["src", "rel_type", "dst"]
    graph.edges(triples).join(edges.select(*named), named, "left_anti").select(*(c.split()[0] for c in EDGES.split(", "))).write.parquet(f"{path}/{own}/edges")
    _publish(spark, path, number + 1, [*folders, own])
    return number + 1


def _publish(spark: SparkSession, path: str, number: int, folders: list[str]) -> None:
    """The manifest under its number, whole or not at all; one that is there raises."""
    jvm, aside, fs = _hadoop(spark, f"{path}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(folders).encode()))
    finally:
        out.close()
    to = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{number:08d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(aside).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(to), options)
    except Exception as e:
        fs.delete(aside, False)
        raise RuntimeError(f"another load has made manifest {number} of {path}") from e
