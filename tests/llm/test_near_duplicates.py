import random

import numpy as np
import pytest

import corpus_pipeline
from conftest_llm import same_rest
from kgloom.llm import common, near_duplicates, simhash


def jaccard(a, b):
    cut = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} if t.split() else set()
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def kept(rows):
    """Brute force: the smallest id of each component."""
    root = {i: i for i, _ in rows}
    near = [(a, b) for a, t in rows for b, u in rows if a < b and jaccard(t, u) >= 0.8]
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    return sorted(set(root.values()))


@pytest.fixture(scope="module")
def edited():
    """Texts of their own, copies with 1 to 4 words replaced, a passage that many texts hold, and texts without words."""
    rnd = random.Random(3)
    words = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    texts, passage = [words(rnd.randint(3, 120)) for _ in range(30)], words(30)
    for _ in range(60):
        t = list(rnd.choice(texts))
        for _ in range(rnd.randint(1, 4)):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(5000)}"
        texts.append(t)
    texts += [passage + words(rnd.randint(5, 60)) for _ in range(30)] + [[], [], texts[0]]
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.fixture
def read(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/d")
        return spark.read.parquet(f"{tmp_path}/d")

    return run


@pytest.mark.parametrize("most, together", [(24, 4096), (24, 1), (2, 1)])
def test_kept_like_brute_force(read, edited, monkeypatch, most, together):
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    got = near_duplicates.one_of_each(read(edited), most_shared=most, most_together=together)  # 2: most keys go by blocks; 1: nothing is compared all with all
    assert sorted(r.doc_id for r in got.collect()) == kept(edited)


def test_stage_takes_edited_copies(spark, read, edited):
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, read(edited), "").collect()) == kept(edited)


def test_tree_of_near(edited):
    sets = [s for s in (near_duplicates.shingles(t) for _, t in edited) if len(s)]
    assert all(len(np.intersect1d(sets[a], sets[b])) * 5 >= 4 * len(np.union1d(sets[a], sets[b])) for a, b in near_duplicates.tree_of_near(sets))


@pytest.fixture(scope="module")
def pairs():
    """100 texts and a copy of each whose last words, at most as many as leave a similarity of 0.8, are others."""
    rnd = random.Random(6)
    texts = [[f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(40, 300))] for _ in range(100)]
    cut = [rnd.randint(1, (len(t) - 4) // 9) for t in texts]
    texts += [t[:-m] + [f"e{rnd.randrange(5000)}" for _ in range(m)] for t, m in zip(texts, cut)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def found(spark, edited, prints, keys):
    """Links among the distinct sets of edited with the keys of their fingerprints or bands alone, and the near pairs by brute force."""
    texts = {}
    for _, t in edited:
        texts.setdefault(near_duplicates.shingles(t).tobytes(), t)
    own = [(i + 1, t, near_duplicates.shingles(t)) for i, t in enumerate(t for t in texts.values() if t)]
    rows = [(i, simhash.set_prints(s).view(np.int64).tolist() if prints else [], near_duplicates.band_keys(s).tolist() if keys else []) for i, _, s in own]
    docs = spark.createDataFrame([(i, t) for i, t, _ in own], "fp bigint, __text string")
    with common.scratch():
        got = near_duplicates.links(spark.createDataFrame(rows, "fp bigint, prints array<bigint>, keys array<bigint>"), lambda fps: docs.join(fps, "fp", "left_semi")).collect()
    return {(min(r), max(r)) for r in got}, {(a, b) for a, t, _ in own for b, u, _ in own if a < b and jaccard(t, u) >= 0.8}


def joined(links, pairs):
    """The pairs that chains of links join."""
    root = {i: i for p in pairs | links for i in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {(a, b) for a, b in pairs if root[a] == root[b]}


def test_golay_keys_bring_near_sets_together(spark, pairs):
    """Without any band, SimHash fingerprints find nine tenths at least of the near pairs, and nothing else."""
    links, near = found(spark, pairs, prints=True, keys=False)
    assert len(near) == 100 and links <= near and len(joined(links, near)) >= 0.9 * len(near)


def signed(spark, texts):
    rows = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "__id bigint, __text string")
    return near_duplicates._signed(rows, near_duplicates.WIDTH)


def test_golay_keys_and_minima_bring_all_near_sets_together(spark, pairs):
    """The keys that the stage takes find every near pair without any band, and nothing else."""
    own = common.written(signed(spark, [t for _, t in pairs]), "signed", keep=True)
    fps = {r["__id"]: r.fp for r in own.collect()}
    docs = spark.createDataFrame([(fps[i + 1], t) for i, t in pairs], "fp bigint, __text string")
    with common.scratch():
        bare = own.selectExpr("fp", "prints", "least", "array_except(keys, keys) keys")
        got = {(min(r), max(r)) for r in near_duplicates.links(bare, lambda ids: docs.join(ids, "fp", "left_semi")).collect()}
    common.discard(own)
    near = {tuple(sorted((fps[a + 1], fps[b + 1]))) for a, t in pairs for b, u in pairs if a < b and jaccard(t, u) >= 0.8}
    assert len(near) == 100 and got <= near and joined(got, near) == near


def test_sets_apart_share_no_key(spark):
    """Sets without a common shingle do not meet by chance, which 24 bits of a key let them do with the square of their number."""
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(rnd.randint(20, 60))) for _ in range(6000)]
    keys = near_duplicates._coded(signed(spark, texts))
    assert keys.count() == 6000 * 3 * simhash.PRINTS
    assert keys.groupBy("key").count().where("count > 1").count() == 0


def test_bands_take_what_fingerprints_leave(spark, pairs):
    links, near = found(spark, pairs, prints=False, keys=True)
    assert links <= near and joined(links, near) == near


def test_set_prints():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 8193):
        own = rnd.integers(0, 1 << 64, n, np.uint64)
        got = simhash.set_prints(own)
        assert len(set(got.tolist())) == simhash.PRINTS
        assert int(got[0]) == sum(1 << bit for bit in range(64) if 2 * int(((own >> np.uint64(bit)) & np.uint64(1)).sum()) > n)
    assert len(simhash.set_prints(own[:0])) == 0


def test_code_keys():
    """A key holds the numbers of the print and of the segment, and the codewords within 3 bits of that segment and of the next."""
    prints = np.random.default_rng(5).integers(0, 1 << 64, (20, simhash.PRINTS), np.uint64)
    keys = simhash.code_keys(prints)
    assert keys.shape == (20, simhash.PRINTS, 3)
    codewords = {}
    for high in range(1 << 12):
        word = high << 11
        for bit in range(22, 10, -1):
            word ^= simhash.GENERATOR << (bit - 11) if word >> bit & 1 else 0
        codewords[high] = high << 11 | word
    for i in range(20):
        for k in range(simhash.PRINTS):
            words = [int(prints[i, k]) >> at & (1 << bits) - 1 for at, bits in simhash.SEGMENTS]
            for s in range(3):
                key = int(keys[i, k, s])
                assert key >> 24 == 3 * k + s
                assert (codewords[key >> 12 & 4095] ^ words[s]).bit_count() <= 3 and (codewords[key & 4095] ^ words[(s + 1) % 3]).bit_count() <= 3


def test_odd_rows(odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd")
    docs = odd.sparkSession.read.parquet(f"{tmp_path}/odd")
    got = near_duplicates.one_of_each(docs)
    assert same_rest(got, odd) and sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == [1, 2, 4, 7]  # 9 is 4 without its last word
    assert near_duplicates.one_of_each(none).count() == 0


def test_no_exact_copies_end_to_end(spark):
    """Of texts alike in the given table one at most is left at the end."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    left = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").collect()}
    assert len({docs[i] for i in left}) == len(left)
