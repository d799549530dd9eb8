import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from kgloom.llm import importance


def features(text, runs):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    return words, [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def expected(docs, target, percent=10, runs=1, least=20):
    """doc_id, n_features, weight, score, rank, by the statement of the task."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for to, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            to.update(map(bucket, features(text, runs)[1]))
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * all_s) / ((s[b] + 1) * all_t)))
    rows = []
    for i, text in docs:
        words, own = features(text, runs)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        if i is None:
            rows.append([i, len(own), weight, None, None, False])
            continue
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    eligible = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["Émile", "ÀB", "x_y", "don't", "中文", "A1", "\x00", "..."]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "\n", ", ", "-"]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(900)] + [(900, None), (901, ""), (None, text(40))]
    return docs, [text(30).replace("w1", "w2") for _ in range(20)]


@pytest.mark.parametrize("runs, percent, rows", [(1, 10, 1 << 17), (1, 37, 16), (3, 100, 50), (2, 0, 5)])
def test_like_the_statement(spark, corpus, runs, percent, rows):
    docs, target = corpus
    own = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert shown(importance.importance_ranks(own, aim, percent, runs, range_rows=rows)) == expected(docs, target, percent, runs)


@pytest.mark.parametrize("rows", [7, 64])
def test_ties_beyond_a_range_go_by_id(spark, rows):
    """One score of most rows is divided by ids; ranks are exact, and no range merges much more than its rows."""
    scores = [(i, 20, 30, 5, 1000 if i % 10 else 1000 + i) for i in range(1, 1001)]
    table = importance.written(spark.createDataFrame(scores, "__id bigint, n_features bigint, n_words bigint, weight bigint, score bigint").repartition(5), "scores", keep=True)
    got = {r["__id"]: r["rank"] for r in importance.drawn(table, 60, range_rows=rows).collect()}
    order = sorted(scores, key=lambda r: (-r[4], r[0]))
    assert got == {r[0]: k + 1 if k < 600 else None for k, r in enumerate(order)}
    ranges = importance._ranges(table, rows)
    assert max(len(r.ids) for r in ranges.collect()) >= 900 // rows // 2


def test_runs_of_several_files_in_a_partition(spark):
    """Files of sorted runs that Spark reads one after the other are each a run of their own."""
    scores = [(i, 20, 30, 5, i * 37 % 101) for i in range(1, 301)]
    table = spark.createDataFrame(scores, "__id bigint, n_features bigint, n_words bigint, weight bigint, score bigint").repartition(5)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = {r["__id"]: r["rank"] for r in importance.drawn(table, 50).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    order = sorted(scores, key=lambda r: (-r[4], r[0]))
    assert got == {r[0]: k + 1 if k < 150 else None for k, r in enumerate(order)}


def test_tournament_like_sorting():
    rnd = random.Random(1)
    for k in (1, 2, 3, 5, 8, 33):
        runs = [sorted((rnd.randrange(20), rnd.randrange(5)) for _ in range(rnd.randrange(30))) for _ in range(k)]
        got = list(importance.Tournament(runs))
        assert [runs[w][i] for w, i in got] == sorted(x for r in runs for x in r)
        assert len(set(got)) == len(got) == sum(map(len, runs))


def test_odd_rows(odd, none, corpus):
    aim = odd.sparkSession.createDataFrame([("thing1 thing2 same",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert shown(importance.importance_ranks(odd, aim, 100)) == expected(rows, ["thing1 thing2 same"], 100)
    assert importance.importance_ranks(none, aim).count() == 0
    assert importance.importance_ranks(odd, aim.where("false")).count() == odd.count()
    got = importance.resampled(odd, aim, 100, rank_col="the rank")
    assert got.columns == [*odd.columns, "the rank"] and sorted((r.doc_id, r["the rank"]) for r in got.collect()) == sorted((i, k) for i, _, _, _, k in expected(rows, ["thing1 thing2 same"], 100) if k)


def test_no_capital_beyond_ascii_is_made_small():
    own = importance.Features(10000, 1)
    got, sizes, words = own.of(["É A a É".encode(), None, b""])
    assert got.tolist() == [zlib.crc32(w.encode()) % 10000 for w in ("É", "a", "a", "É")] and sizes.tolist() == words.tolist() == [4, 0, 0]
