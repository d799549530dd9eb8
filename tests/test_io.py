import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom import schemas
from kgloom.operators import extract
from kgloom.sources import io, pages, parsing
from kgloom.streaming import streams

RAW = schemas.RAW_TRIPLE


def test_jsonl(spark, tmp_path):
    assert io.jsonl(spark, str(tmp_path / "none"), RAW).count() == 0
    rows = [("头", "r", "t", "s", None)]
    io.write_jsonl(spark.createDataFrame(rows, RAW), str(tmp_path / "a" / "x"))
    assert [tuple(r) for r in io.jsonl(spark, str(tmp_path / "a" / "x"), RAW).collect()] == rows
    (tmp_path / "bad").write_text('{"head": "a"}\n\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.jsonl(spark, str(tmp_path / "bad"), RAW).collect()


def test_markdown(spark, tmp_path):
    (tmp_path / "文 a.md").write_bytes("x\r\ny\rz".encode() + b"\xff!")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "c.pdf").write_text("pdf")
    assert [(r.doc_id, r.text) for r in io.markdown(spark, str(tmp_path)).collect()] == [("文 a", "x\ny\nz!")]
    assert io.pdf_files(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="(?i)not.exist"):
        io.markdown(spark, str(tmp_path / "missing.md")).collect()


def test_markdown_many_files(spark, tmp_path):
    """Tasks are as many as the shuffle's partitions, not one for some 30 files; subfolders hold each name once."""
    rows = spark.range(600).selectExpr("concat(id % 500, '.md') as file", "if(id % 500 = 7, '', concat('x', id % 500)) as text")
    want = {(str(k), f"x{k}") for k in range(500) if k != 7}  # an empty file gives no row
    assert io.write_files(rows, str(tmp_path / "flat")) == io.write_files(rows, str(tmp_path / "dealt"), 8) == 600
    flat, dealt = [str(tmp_path / "flat")], io.part_folders(str(tmp_path / "dealt"), 8)
    assert sorted(p.name for p in (tmp_path / "dealt").glob("*/*")) == sorted(p.name for p in (tmp_path / "flat").iterdir()) and len(list((tmp_path / "dealt").iterdir())) == 8
    for folders in (flat, dealt):
        read = io.markdown(spark, *folders)
        assert read.rdd.getNumPartitions() == 4
        got = [(r.doc_id, r.text) for r in read.collect()]
        assert len(got) == len(want) == io.markdown_count(spark, *folders) and set(got) == want


def test_markdown_like_sparks_reader(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    for name, content in {"文 a.md": "x\r\ny", "b.tar.md": "b", "_h.md": "h", "_k=1.md": "k", ".d.md": "d", "e.MD": "e", "f.txt": "f", "g.md": "", "sub/s.md": "s"}.items():
        (tmp_path / name).write_bytes(content.encode())
    (tmp_path / "bad.md").write_bytes(b"\xff")
    asked = [str(tmp_path)], [f"{tmp_path}/"], [f"file://{tmp_path}"], [str(tmp_path / "文 a.md")], [str(tmp_path / "f.txt")], [str(tmp_path), str(tmp_path / "sub")], [f"{tmp_path}/*.md"], [f"{tmp_path}/[bs]*"]
    rows = lambda: [sorted(tuple(r) for r in io.markdown(spark, *paths).collect()) for paths in asked]
    own, counts = rows(), [io.markdown_count(spark, *paths) for paths in asked]
    monkeypatch.setattr(io, "_names", lambda *_: None)
    assert own == rows() and counts == [len(x) for x in own] and [r[0] for r in own[0]] == ["_k=1", "b.tar", "bad", "文 a"]
    monkeypatch.undo()
    (tmp_path / "large.md").write_text("y" * 300)
    monkeypatch.setattr(io, "READ_BYTES", 1)  # a batch for each file
    assert len(io.markdown(spark, str(tmp_path)).collect()) == 5


def test_catalogs_and_truth(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "a", "is_symmetric": True}, {"name": "b", "mutex_with": ["a"]}]))
    got = io.relation_types(spark, str(tmp_path / "r.json")).orderBy("idx").collect()
    assert [(r.name, r.is_symmetric, r.mutex_with, r.description) for r in got] == [("a", True, [], ""), ("b", False, ["a"], "")]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="no list"):
        io.relation_types(spark, str(tmp_path / "bad.json"))
    (tmp_path / "t.json").write_text(json.dumps({"entities": ["x", {"name": "y"}], "relations": [{"head": "x", "relation": "r", "tail": "y"}]}))
    e, r = io.truth(spark, str(tmp_path / "t.json"))
    assert sorted(x.entity for x in e.collect()) == ["x", "y"] and tuple(r.first()) == ("x", "r", "y")


def test_annotations(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿entity,is_correct(1/0),comment\na,1,\nb,0.0,类型\nc,,\n", encoding="utf-8")
    assert [(r.entity, r.is_correct) for r in io.annotations(spark, str(tmp_path / "a.csv"), True).collect()] == [("a", True), ("b", False), ("c", None)]


def test_graph_sink(spark, tmp_path):
    facts = spark.createDataFrame([("a", "r `x", "b", "s1", "m", 2), ("a", "r x", "b", "s0", "m", 1)], schemas.TRIPLE)
    io.write_graph(facts, str(tmp_path / "g"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "g/edges")).collect()] == [("a", "r_x", "b", "s0", "m")]
    with pytest.raises(ValueError, match="no triples"):
        io.write_graph(facts.where("false"), str(tmp_path / "g"))


def test_parse(spark):
    class Failing:  # in the function, so that workers need not import this module
        def __call__(self, content):
            if "bad" in content:
                raise RuntimeError("service")
            return parsing.HtmlPages()(content)

    pages = spark.createDataFrame([(1, "<h1>T</h1><p>a&amp;b</p><script>x</script>"), (2, "bad"), (3, "done")], "doc_id int, content string")
    got = {r.doc_id: r for r in parsing.parse(pages, Failing, pages.where("doc_id = 3")).collect()}
    assert got[1].text == "# T\na&b\n\n" and got[2].text is None and "service" in got[2].error and 3 not in got
    joined = parsing.joined_pages(spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], schemas.PAGE))
    assert joined.first().text == "a\n\nb\n\n"


def test_page_source(spark, tmp_path):
    pages.register(spark)
    source, done = tmp_path / "in", tmp_path / "done"
    source.mkdir(), done.mkdir()
    (source / "文 a.pdf").write_bytes("one\ftwo".encode())
    (source / "b.PDF").write_bytes(b"\xff")
    (source / "c.pdf").write_bytes(b"")
    (source / "d.txt").write_bytes(b"no")
    read = spark.read.format(pages.FORMAT).option("parser", "kgloom.sources.parsing:PlainPages").option("done", str(done))
    got = {r.doc_id: r for r in read.load(str(source)).collect()}
    assert got["文 a"].text == "one\n\ntwo\n\n" and got["文 a"].path.endswith("文 a.pdf") and got["文 a"].error is None
    assert got["b"].text is None and "UnicodeDecodeError" in got["b"].error and got["c"].text == "\n\n" and len(got) == 3
    each = read.option("rows", "pages").option("bytes", "1").load(str(source))
    assert each.rdd.getNumPartitions() == 2  # of 1 and 0 bytes, and of 7
    assert {(r.doc_id, r.page_no, r.text) for r in each.collect()} == {("文 a", 0, "one"), ("文 a", 1, "two"), ("b", 0, None), ("c", 0, "")}
    (done / "文 a.md").write_text("x", encoding="utf-8")
    assert {r.doc_id for r in each.collect()} == {"b", "c"}  # looked for when the partitions are read
    for folder, option in ((tmp_path / "none", {}), (done, {}), (source, {"rows": "lines"})):
        with pytest.raises(Exception, match="none|no files|rows must"):
            read.options(**option).load(str(folder)).collect()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("d", "一二三。四五六。")], "doc_id string, text string").write.parquet(src)
    for _ in range(2):  # the second finds nothing new
        streams.process_new(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"), 4).awaitTermination(120)
    assert sorted(r.chunk for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["一二三。", "四五六。"]


def test_encoder(spark):
    got = extract.encode(spark.createDataFrame([("ab",), (None,)], "text string"), extract.GramEncoder).select(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("n")).collect()
    assert sorted(round(r.n, 3) for r in got) == [0.0, 1.0]


def test_pooled_encoder(spark):
    """Padding and what is cut off count for nothing, against a loop."""
    table = np.random.default_rng(3).normal(size=(128, 5)).astype(np.float32)
    asked = []

    def model(ids, mask):
        asked.append(ids.shape)
        assert ids.shape == mask.shape and not (ids * (1 - mask)).any()
        return table[ids] + (1 - mask[:, :, None]) * 1e6  # what stands at padding must not be read

    tokenize = lambda texts: [[ord(c) % 128 for c in t] for t in texts]
    own = extract.PooledEncoder(tokenize, model, most=6, before=(1,), after=(2,))
    texts = ["abcdefgh", "x", "", "abcdZZZZ"]
    got = own(texts)
    for t, v in zip(texts, got):
        mean = table[[1, *(ord(c) for c in t[:4]), 2]].mean(0)
        assert np.allclose(v, mean / np.linalg.norm(mean), atol=1e-6)
    assert np.allclose(got[0], got[3]) and asked == [(4, 6)]
    assert not extract.PooledEncoder(tokenize, model)(["", ""]).any() and extract.PooledEncoder(tokenize, model)([]).shape == (0, 5)
    assert np.allclose(extract.PooledEncoder(tokenize, model, unit=False)(["a"])[0], table[97])
    with pytest.raises(ValueError, match="no token"):
        extract.PooledEncoder(tokenize, model, most=2, before=(1,), after=(2,))
    assert list(extract._calls(["aa", "b", "cccc", "d", "e"], 2, 3)) == [["aa", "b"], ["cccc"], ["d", "e"]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    far = {r.text: r.vector for r in extract.encode(rows, lambda: extract.PooledEncoder(tokenize, lambda ids, mask: table[ids], 6, (1,), (2,)), size=3, chars=8).collect()}
    assert all(np.allclose(far[t], v, atol=1e-6) for t, v in zip(texts, got))


def test_preprocess_writes_files(spark, tmp_path):
    from kgloom.plans import pipelines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "文 a.md").write_text("# 第1章 t/x\nbody one is here。next sentence\n", encoding="utf-8")
    (tmp_path / "in" / "b.md").write_text("x", encoding="utf-8")
    assert pipelines.preprocess(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 2
    assert {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "out").iterdir()} == {"文 a.md": "# 第1章 t/x\nbody one is here。next sentence\n", "b.md": "x"}
    assert pipelines.preprocess(spark, str(tmp_path / "in"), str(tmp_path / "c"), split_chapters=True) == 2
    assert {p.name for p in (tmp_path / "c").iterdir()} == {"文 a_chapter01_第1章_tx.md", "b_chapter01_全文.md"}
    pipelines.preprocess(spark, str(tmp_path / "in"), str(tmp_path / "s"), sentence_mode=True)
    assert (tmp_path / "s" / "文 a_sentences.txt").read_text(encoding="utf-8") == "# 第1章 t/x\nbody one is here\nnext sentence"
    with pytest.raises(Exception, match="(?i)not.exist"):
        pipelines.preprocess(spark, str(tmp_path / "none"), str(tmp_path / "x"))
