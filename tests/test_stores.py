"""Answers that are asked once, graphs that grow, first wins as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import triples as T
from kgloom.sources import answers, graphs
from kgloom.streaming import streams

TRIPLE = "head string, relation string, tail string, source string, method string, ord bigint"


def test_answers_are_asked_once(spark, tmp_path):
    class Model:  # in the function, so that workers need not import this module
        def __call__(self, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("service")
            return [f"<{p}>" for p in prompts]

    store = str(tmp_path / "store")
    table = lambda own: spark.createDataFrame([(i, p) for i, p in enumerate(own)], "i int, prompt string")
    first = table(["a", "b", "a", None, ""])
    assert answers.ask(first, Model, store, "m") == 3 and answers.ask(first, Model, store, "m") == 0
    assert {(r.i, r.answer) for r in answers.answered(first, store, "m").collect()} == {(0, "<a>"), (1, "<b>"), (2, "<a>"), (3, None), (4, "<>")}
    assert answers.ask(table(["a", "c"]), Model, store, "m") == 1  # one changed
    assert answers.ask(table(["a"]), Model, store, "other") == 1  # another model
    many = table([f"p{i}" for i in range(40)] + ["bad"]).coalesce(1)
    with pytest.raises(Exception, match="service"):
        answers.ask(many, Model, store, "m", size=1, kept_every=5)
    kept = 40 - answers.unasked(many.where("prompt <> 'bad'"), store, "m").count()
    assert answers.ask(many.where("prompt <> 'bad'"), Model, store, "m") == 40 - kept  # what the failed run had is not asked again
    assert answers.unasked(first.where("false"), store, "m").count() == 0


def test_graph_grows(spark, tmp_path):
    path = str(tmp_path / "g")
    one = spark.createDataFrame([("a", "r `x", "b", "s1", "m", 2), ("a", "r x", "b", "s0", "m", 1)], TRIPLE)
    two = spark.createDataFrame([("a", "r x", "b", "late", "m", 0), ("b", "r x", "c", "s2", "m", 3)], TRIPLE)
    assert graphs.merge_graph(one, path) == 1 and graphs.merge_graph(two, path) == 2 and graphs.merge_graph(two, path) == 3
    nodes, edges = graphs.read_graph(spark, path)
    assert sorted(r.name for r in nodes.collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, edges.collect())) == [("a", "r_x", "b", "s0", "m"), ("b", "r_x", "c", "s2", "m")]
    with pytest.raises(RuntimeError, match="another load"):
        graphs._publish(spark, path, 3, [])
    assert graphs.loads(spark, path)[0] == 3
    with pytest.raises(ValueError, match="no triples"):
        graphs.merge_graph(one.where("false"), path)
    assert graphs.read_graph(spark, str(tmp_path / "none"))[1].count() == 0


def test_first_wins_as_a_stream(spark, tmp_path):
    """In whatever order triples arrive, the settled stream is what dedup gives."""
    rnd = random.Random(4)
    own = [(f"h{rnd.randrange(5)}", "r", f"t{rnd.randrange(3)}", f"s{i}", "m", i) for i in range(120)]
    rnd.shuffle(own)
    schema = TRIPLE + ", time timestamp"
    for k in range(3):
        spark.createDataFrame(own[40 * k : 40 * k + 40], TRIPLE).withColumn("time", F.timestamp_seconds(F.lit(1_700_000_000 + k))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    told = streams.stream_first(read, "time").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert told.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out"))
    want = T.dedup(spark.createDataFrame(own, TRIPLE))
    columns = ["head", "relation", "tail", "source", "method", "ord"]
    assert sorted(map(tuple, streams.settled(out).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert out.count() < len(own)
