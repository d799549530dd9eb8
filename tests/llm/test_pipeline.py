import random

import pandas as pd

import corpus_pipeline
from conftest_llm import same_rest
from test_dedup import removed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n, seen = docs.columns, docs.count(), docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(out.columns)
    assert set(out.doc_id) <= set(texts) and 0.5 * n < out.doc_id.nunique() < n
    # of exact copies in a stage's input one stays, and no text goes whole; a host's boilerplate may part copies before that
    near = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, SF).select("doc_id").collect()}
    copies = pd.Series(texts).groupby(pd.Series(texts)).apply(lambda g: len(set(g.index) & near))
    assert copies.max() == 1 and near <= set(texts)
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    kept = corpus_pipeline.STAGES[1][1](spark, seen, SF)
    assert kept.columns == columns and kept.where("n_chars <> length(text)").count() == 0


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Columns of clashing names, nulls, empty texts and repeated rows go through every stage; an empty table stays one."""
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, odd, SF)
        assert same_rest(out, odd), name
        assert stage(spark, none, SF).count() == 0, name
        assert out.where("n_chars <> length(text)").count() == 0, name
    spark.createDataFrame([(100 + i, i % 2) for i in range(10)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert same_rest(corpus_pipeline.drop_toxic(spark, odd, str(tmp_path)), odd)
    assert corpus_pipeline.pack(spark, odd, SF).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_stages_like_loops(spark):
    """Planted boilerplate and passages, each stage's own input against a loop."""
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(12)) for _ in range(4)] + (["all rights reserved"] if i % 2 else []) + ([passage] if i % 7 == 0 else [])
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", f"host{i % 2}", 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs, SF).collect()}
    pages, often = {"host0": 30, "host1": 30}, {}
    for _, text, _, host, _ in rows:
        for line in set(text.split("\n")):
            often[host, line] = often.get((host, line), 0) + 1
    keep = lambda host, line: not (often[host, line] >= 3 and often[host, line] > 0.03 * pages[host])
    assert got == {i: "\n".join(x for x in text.split("\n") if keep(host, x)) for i, text, _, host, _ in rows}
    own = corpus_pipeline.drop_repeats(spark, docs, SF).collect()
    want = {r[0]: (r[1] - r[2], r[4]) for r in removed([(i, text) for i, text, *_ in rows])}
    import hashlib

    assert {r.doc_id: (r.n_chars, hashlib.sha256(r.text.encode()).hexdigest()) for r in own} == want
