import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import same_rest
from kgloom.llm import common, minhash, near_duplicates


def shingles(text):
    words = near_duplicates_words(text)
    return {tuple(words[k : k + 2]) for k in range(max(1, len(words) - 1))} if words else set()


def near_duplicates_words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def expected(rows):
    """doc_id, n_shingles, component_id, kept by brute force; ids are distinct."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in root:
        was = dict(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if was == root:
            break
    return sorted((i, len(sets[i]), root[i], root[i] == i) for i in sets)


def edits(rnd, originals, copies, most):
    words = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    texts = [words(rnd.randint(1, 90)) for _ in range(originals)]
    for _ in range(copies):
        t = list(rnd.choice(texts))
        for _ in range(rnd.randint(1, most)):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(5000)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def read(spark, path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("most, together", [(24, 4096), (24, 1), (2, 1)])
def test_like_brute_force(spark, tmp_path, monkeypatch, most, together):
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    rnd = random.Random(5)
    texts = edits(rnd, 60, 140, 3) + ["", None, "  \n", "One", "one", "ONE ", "É x", "é x", "a b c a b c", "A b c"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = minhash.minhash_groups(read(spark, f"{tmp_path}/d", rows), most_shared=most, most_together=together)
    assert sorted(map(tuple, got.collect())) == expected(rows)


def template(rnd, n, share, size=60):
    """n texts of one template that keep each of its words at a probability, so that two of them are alike, but few near."""
    base = [f"t{k}" for k in range(size)]
    return [" ".join(w if rnd.random() < share else f"x{rnd.randrange(10**6)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("share, most, together", [(0.9, 24, 4096), (0.9, 24, 20), (0.95, 8, 20)])
def test_templates_like_brute_force(spark, tmp_path, share, most, together):
    """Texts that share keys and are refused by most of their kind: every pair that may be near is decided."""
    rnd = random.Random(11)
    texts = template(rnd, 150, share) + edits(rnd, 10, 20, 2)
    rows = list(enumerate(texts))
    got = minhash.minhash_groups(read(spark, f"{tmp_path}/d", rows), most_shared=most, most_together=together)
    assert sorted(map(tuple, got.collect())) == expected(rows)


def test_packed_bits_and_estimate(spark):
    """The estimate is the share of agreeing minima, corrected, and close to the similarity of the sets."""
    rnd = np.random.default_rng(3)
    every = rnd.integers(0, 1 << 64, 1300, np.uint64)
    rows, want = [], []
    for both in (1000, 700, 300, 0):
        x, y = every[:1000], np.concatenate([every[:both], rnd.integers(0, 1 << 64, 1000 - both, np.uint64)])
        a, b = minhash.minima(x, minhash.MINIMA), minhash.minima(y, minhash.MINIMA)
        mask = (1 << minhash.BITS) - 1
        agree = float(np.mean((a & mask) == (b & mask)))
        want.append(((agree - 0.25) / 0.75, both / (2000 - both)))
        rows.append((minhash.packed(a).view(np.int64).tolist(), minhash.packed(b).view(np.int64).tolist()))
    df = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>")
    words = [[np.array([r[k]], np.int64).view(np.uint64) for r in rows] for k in (0, 1)]
    assert [bool(minhash.alike(a, b)[0, 0]) for a, b in zip(*words)] == [w[0] >= minhash.LEAST for w in want]
    got = [r[0] for r in df.select(minhash.similarity(F.col("x"), F.col("y"))).collect()]
    assert got == pytest.approx([w[0] for w in want]) and all(abs(w[0] - w[1]) < 0.2 for w in want)


def test_estimate_refuses_no_near_pair():
    """Of 2,000 pairs of a similarity of just 0.8, none is estimated below the limit."""
    rnd = np.random.default_rng(4)
    mask = (1 << minhash.BITS) - 1
    for _ in range(2000):
        own = rnd.integers(0, 1 << 64, 100, np.uint64)
        a, b = minhash.minima(own[:90], minhash.MINIMA), minhash.minima(own[10:], minhash.MINIMA)
        assert (np.mean((a & mask) == (b & mask)) - 0.25) / 0.75 >= minhash.LEAST


@pytest.mark.parametrize("n, edits, together", [(2000, 2, 4096), (2000, 12, 4096), (2000, 2, 100)])
def test_near_copies_make_fewer_than_two_pairs_a_set(spark, tmp_path, monkeypatch, n, edits, together):
    """A group of n near copies of one text is joined by about n candidates a step, not by as many as its keys allow."""
    rnd = random.Random(9)
    base = [f"t{k}" for k in range(80)]
    texts = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randint(1, edits)):
            t[rnd.randrange(80)] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(t))
    counts = {}
    real = near_duplicates.written

    def counted(df, name, keep=False):
        out = real(df, name, keep)
        counts.setdefault(name, []).append(out)
        counts[name][-1] = out.count()
        return out

    monkeypatch.setattr(near_duplicates, "written", counted)
    rows = list(enumerate(texts))
    got = minhash.minhash_groups(read(spark, f"{tmp_path}/d", rows), most_together=together).collect()
    assert {r.component_id for r in got} == {0} if edits == 2 else sorted(map(tuple, got)) == expected(rows)
    assert all(sum(counts.get(name, [])) < 2 * n for name in ("pairs", "links", "near")), {k: v for k, v in counts.items() if k in ("pairs", "links", "near", "blocks")}


def test_odd_rows(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd")
    docs = spark.read.parquet(f"{tmp_path}/odd")
    got = minhash.minhash_groups(docs)
    by_id = {r.doc_id: tuple(r)[1:] for r in got.collect() if r.doc_id is not None}
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    assert got.count() == odd.count() and by_id == {i: (n, c, k) for i, n, c, k in expected(list(texts.items()))}
    assert [(r.n_shingles, r.component_id, r.kept) for r in got.where("doc_id is null").collect()] == [(1, None, None)]
    assert minhash.minhash_groups(none).count() == 0
    left = minhash.one_of_each(docs)
    assert same_rest(left, odd) and sorted(str(r.doc_id) for r in left.collect()) == sorted(["None", "1", "3", "5", "4", "7", "2"])
    assert minhash.one_of_each(none).count() == 0
    common.discard()
