import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import same_rest
from kgloom.llm import fingerprints, graph, line_dedup, simhash, suffix_dedup


def removed(rows, length=50):
    """Brute force: (id, text) to id, text: what is left, number of runs."""
    rows = sorted(((1 << 63 if i is None else i), (t or "").encode()) for i, t in rows)
    out = []
    for i, b in rows:
        seen = {x[k : k + length] for j, x in rows if j < i for k in range(len(x) - length + 1)}
        on = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                on[k : k + length] = b"\1" * length
        spans = sum(on[k] and not (k and on[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(on), spans, hashlib.sha256(bytes(x for x, y in zip(b, on) if not y)).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rnd.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(shared) if rnd.random() < 0.4 else " ".join(word() for _ in range(20)) for _ in range(rnd.randint(0, 4))]
        rows.append((i * 3, " ".join(parts)))
    return rows + [(200, "ab" * 80), (201, "ab" * 60), (202, "x" + "ab" * 30), (None, shared[0]), (None, shared[0]), (10, None), (11, rows[5][1]), (11, rows[5][1])]


@pytest.mark.parametrize("most", [suffix_dedup.MOST_SEGMENTS, 1])
def test_repeats_like_brute_force(spark, passages, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", most)  # 1: all shared hashes go string by string
    got = suffix_dedup.removed_spans(spark.createDataFrame(passages, "doc_id bigint, text string")).collect()
    assert sorted((1 << 63 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == removed(passages)


def test_expansion_of_a_block():
    rnd = np.random.default_rng(3)
    length, width = 12, 20
    for n in (0, 1, 60):
        segments = rnd.integers(0, 2, (n, width)).astype(np.uint8)
        windows, groups, ids = rnd.integers(1, width - length + 2, n), np.sort(rnd.integers(0, 3, n)), rnd.integers(0, 9, n)
        by = {}
        for i in range(n):
            for k in range(windows[i]):
                by.setdefault((groups[i], bytes(segments[i, k : k + length])), []).append((i, k))
        want = {(i, k, min(ids[j] for j, _ in own)) for own in by.values() if len({ids[j] for j, _ in own}) > 1 for i, k in own}
        assert set(zip(*(x.tolist() for x in suffix_dedup.expanded(segments, windows, groups, ids, length)))) == want


def test_windows_name_the_same_place_everywhere():
    rnd = random.Random(4)
    shared = bytes(rnd.choice(b"abcd ") for _ in range(200))
    h = []
    for k in range(6):
        text = bytes(rnd.choice(b"abcd ") for _ in range(40 * k)) + shared + bytes(rnd.choice(b"abcd ") for _ in range(9))
        own = suffix_dedup.Windows([(0, 0, text)])
        none = np.zeros(0, np.int64)
        mark, first, number = own.segments((none, none, none))
        assert number.sum() == len(text) - 49
        by = {int(f) + j: int(m) for m, f, c in zip(mark, first, number) for j in range(c)}
        h.append([by[40 * k + j] for j in range(151)])
        at, size, _ = own.chunks()
        assert at[0] == 0 and (at + size)[-1] == len(text) - 49 and (at[1:] == (at + size)[:-1]).all()
    assert all(x == h[0] for x in h)


def test_repeats_in_long_texts(spark):
    """Longer than the parts in which texts are worked on."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    base = " ".join(rnd.choice(words) for _ in range(60_000))
    assert len(base) > suffix_dedup.TEXT_BYTES + 10_000
    rows = [(1, base), (2, base[:70_000] + "x" + base[70_000:]), (3, "a" * 9_000), (4, "b" + "a" * 7_000 + base[90_000:91_100]), (0, base[100_000:300_000])]
    got = suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == removed(rows)


def test_length_is_checked(none):
    with pytest.raises(ValueError):
        suffix_dedup.removed_spans(none, length=8)


def test_repeats_on_odd_rows(odd, none):
    kept = suffix_dedup.without_repeats(odd)
    assert same_rest(kept, odd) and kept.count() == odd.count()
    assert {r.doc_id: r.text for r in kept.collect()}[5] is None
    assert suffix_dedup.removed_spans(none).count() == 0


def simhash_model(text, width=3):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_model(nodes, linked):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a in nodes:
            for b in nodes:
                if linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash_rows(odd, none):
    rows = simhash.simhash_groups(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    assert all(int(r.fingerprint, 16) == simhash_model(texts[r.doc_id]) for r in rows)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[5] == by[1] == by[3] == 1 and by[7] == 7 and by[None] is None
    kept = simhash.one_of_each(odd)
    assert same_rest(kept, odd) and sorted(str(r.doc_id) for r in kept.collect()).count("7") <= 1
    assert simhash.simhash_groups(none).count() == simhash.one_of_each(none).count() == 0


def test_keys_meet():
    rnd = random.Random(5)
    for _ in range(300):
        a = b = rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 2)):
            b ^= 1 << rnd.randrange(64)
        who, keys = simhash.keys_of(np.array([a, b], np.uint64))
        assert set(keys[who == 0]) & set(keys[who == 1])


@pytest.mark.parametrize("most", [24, 2])
def test_links_join_all_that_are_near(spark, most):
    rnd = random.Random(6)
    prints = {rnd.getrandbits(64) for _ in range(30)}
    for _ in range(90):
        p = rnd.choice(sorted(prints))
        for _ in range(rnd.randint(1, 3)):
            p ^= 1 << rnd.randrange(64)
        prints.add(p)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    found = graph.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), most)).collect()
    near = lambda a, b: a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    want = {n: r for n, r in components_model(signed, near).items() if any(near(n, m) for m in signed)}
    assert {r.node: r.root for r in found} == want


def test_line_dedup(spark, odd, none):
    rows = [(i, "h" if i < 10 else None, f"menu\nown {i}\n\nmenu" if i % 2 else f"own {i}") for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(docs, ratio=0.4, counts=("n_lines", "n_dropped")).collect()}
    assert got[1] == ("own 1\n", 2) and got[0] == ("own 0", 0) and got[11] == ("menu\nown 11\n\nmenu", 0)
    out = line_dedup.drop_boilerplate(odd)
    assert same_rest(out, odd) and out.count() == odd.count()
    assert out.where("doc_id = 5").first().text is None and line_dedup.drop_boilerplate(none).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_boilerplate(odd, counts=("n_lines", "__n_dropped"))


def test_many_lines(spark):
    """Work grows with the lines, not with lines times what goes: one page of 60,000 lines, half of them boilerplate."""
    lines = [f"often {i}" if i % 2 else f"own {i}" for i in range(60_000)]
    rows = [(0, "h", "\n".join(lines)), *((i, "h", "\n".join(lines[1::2])) for i in (1, 2))]
    began = time.time()
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, source string, text string"), ratio=0.9).collect()}
    assert got[0] == "\n".join(lines[::2]) and got[1] == "" and time.time() - began < 30


def test_fingerprints(spark, odd, none):
    rows = [(4, "a b\nc d\ne"), (2, "c d\n\ne\na b"), (9, "z" * 50), (11, None), (12, "")]
    got = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[2].fingerprint == got[4].fingerprint != got[9].fingerprint and got[11].fingerprint == got[12].fingerprint == "0" * 512
    assert got[2].near_next == 1 and got[11].near_next == 1 and got[4].near_next < 0.5
    assert fingerprints.neighbour_fingerprints(odd).count() == odd.count() and fingerprints.neighbour_fingerprints(none).count() == 0


def test_fingerprints_add_and_subtract(spark):
    texts = spark.createDataFrame([(1, "one\ntwo"), (2, "three"), (3, "three\ntwo\none"), (4, "two\none")], "k int, t string")
    lanes = {r.k: r.lanes for r in fingerprints.lane_sums(texts, ["k"], "t").collect()}
    df = spark.createDataFrame([(lanes[1], lanes[2], lanes[3], lanes[4])], "a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    r = df.select(fingerprints.plus(F.col("a"), F.col("b")).alias("sum"), fingerprints.minus(F.col("c"), F.col("b")).alias("rest"), fingerprints.likeness(F.col("a"), F.col("d")).alias("same")).first()
    assert r.sum == lanes[3] and r.rest == lanes[4] and r.same == 1


def lanes_model(text):
    """The 64 lanes of a text, by the hash's own library."""
    import struct

    import xxhash

    def h(*values):
        seed = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i" if -(1 << 31) <= v < 1 << 31 and not isinstance(v, np.int64) else "<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
        return seed

    out = [0] * 64
    for p in filter(None, text.split("\n")):
        for at, e in enumerate([p, *(p[k : k + 16] for k in range(0, len(p), 16))]):
            a, b = (np.array([x], np.uint64).view(np.int64)[0] for x in (h(e, at), h("h2", at, e)))
            for j in range(16):
                w = h(a, j, b)
                for i in range(4):
                    out[4 * j + i] += (w >> 16 * i & 0xFFFF) - 32768
    return [x % (1 << 32) for x in out]


def test_lanes_and_likeness_by_other_code(spark):
    rnd = random.Random(11)
    texts = ["\n".join("".join(rnd.choice("abcdé中 ") for _ in range(rnd.randint(0, 50))) for _ in range(rnd.randint(0, 6))) for _ in range(20)] + ["", "\n\n", "x" * 16, "x" * 17]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    lanes = {r.k: r.lanes for r in fingerprints.lane_sums(rows, ["k"], "t").collect()}
    assert lanes == {k: lanes_model(t) for k, t in enumerate(texts)}
    centred = lambda v: np.array([x - (1 << 32) if x >= 1 << 31 else x for x in v], float)
    pairs = [(a, b) for a in range(6) for b in range(6)]
    df = spark.createDataFrame([(a, b, lanes[a], lanes[b]) for a, b in pairs], "i int, j int, a array<bigint>, b array<bigint>")
    for r in df.select("i", "j", fingerprints.likeness(F.col("a"), F.col("b")).alias("s")).collect():
        x, y = centred(lanes[r.i]), centred(lanes[r.j])
        d = centred([(p - q) % (1 << 32) for p, q in zip(lanes[r.i], lanes[r.j])])
        both = (x * x).sum() + (y * y).sum()
        assert r.s == pytest.approx(min(1.0, max(0.0, 1 - (d * d).sum() / both)) if both else 1.0)


def test_scratch_tables_go(spark, odd):
    """What operators write for themselves is deleted; what their results read stays until they are read."""
    import os

    from kgloom.llm import common, near_duplicates

    folder = common.shared_folder(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(folder))
    for f, left in ((near_duplicates.one_of_each, 1), (simhash.one_of_each, 1), (line_dedup.drop_boilerplate, 1), (suffix_dedup.without_repeats, 1), (fingerprints.neighbour_fingerprints, 1), (simhash.simhash_groups, 2)):
        assert f(odd).count() > 0
        now = set(os.listdir(folder))
        assert len(now - before) == left, (f.__name__, now - before)
        before = now
