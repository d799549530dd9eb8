import base64
import hashlib
import io
import struct

import pytest

from kgloom.llm import quality_rules, toxicity, warc


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark):
    pages = [(3, "http://a/", "same"), (1, "http://b/\n", "same"), (2, None, None), (4, "u", ""), (5, "u", "é" * 3000), (6, "u", "own")] + [(10 + i, "u", f"<html>page {i} of many</html>" * 20) for i in range(80)]
    got = {r.page_id: r for r in warc.warc_round_trip(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        assert (got[i].payload_digest, got[i].payload_bytes) == (sha(html or ""), len((html or "").encode()))
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {3: 1, 4: 2}
    odd = spark.createDataFrame([(None, None, "x", 1), (None, None, "x", 1), (7, "u", "x", 2), (7, "u", "x", 2)], "page_id bigint, url string, html string, __payload int").drop("__payload")
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.warc_round_trip(odd).collect()) == [("7", "response", None)] * 2 + [("None", "revisit", 7)] * 2
    assert warc.warc_round_trip(odd.where("false")).count() == 0


def archive(n=70):
    out = io.BytesIO()
    pages = [f"<p>paragraph {i} and more of the like</p>".encode() * 8 for i in range(n)]
    w = warc.Writer(out, pages)
    for i, p in enumerate(pages):
        w.write(warc._page_record(i, "http://x/", p, None))
    return out.getvalue(), pages


def test_reader_checks():
    data, pages = archive()
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME  # the dictionary comes first
    assert [r.payload for r in warc.read_records(io.BytesIO(data), chunk=7)] == pages
    for bad in (data[:-3], data + b"junk", data[:9] + b"\0" * 20 + data[29:], data[8 + struct.unpack("<I", data[4:8])[0] :]):
        with pytest.raises((warc.WarcError, Exception)):
            list(warc.read_records(io.BytesIO(bad)))
    good = warc._page_record(1, "u", b"abc", None)
    for old, new in ((b"WARC/1.1", b"WARX/1.1"), (b"Content-Length: ", b"Content-Length: 9"), (b"abc", b"abd"), (b"WARC-Type", b"WARC-Tipe")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(good.replace(old, new))


def test_measures():
    m = quality_rules.measure("a b c a b c\n\na b c a b c\nx #$ y")
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines) == (15, 16, 2, 1)
    assert quality_rules.measure("a b c d").n_repeat_words == 0 and m.n_repeat_words == 12
    assert quality_rules.measure(None).base_failed and quality_rules.measure("a\u3000b c").n_words == 2


def test_order_changes_nothing(spark, odd, none):
    rules = quality_rules.RULES
    assert quality_rules.ordered({"slow": (1.0, 0.5), "fast": (0.1, 0.4), "never": (0.01, 0.0)}) == ["fast", "slow", "never"]
    text = "good words stand here and there in this text of ours " * 3
    varied = " ".join(f"word{i} thing{i * 7}" for i in range(60))
    docs = spark.createDataFrame([(1, varied), (2, varied.replace("w", "# w")), (3, text), (4, "9 8 7 " * 3 + " ".join(map(str, range(100, 200))))], "doc_id int, text string")
    runs = [{r.doc_id: r.kept for r in quality_rules.quality_rules(docs, rules=dict(x)).collect()} for x in (rules.items(), list(rules.items())[::-1])]
    assert runs[0] == runs[1] == {1: True, 2: False, 3: False, 4: False}
    assert quality_rules.quality_rules(odd).count() == odd.count() and quality_rules.quality_rules(none).count() == 0


def test_toxicity(spark, odd, none):
    rows = [(i, (f"you idiot number{i % 13} women" if i % 4 == 0 else f"a friendly number{i % 13} of {'women' if i % 3 else 'men'}")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    assert all(scored[i].predicted == int(i % 4 == 0) for i, _ in rows)
    assert model.score("we met two women") == pytest.approx(model.score("we met two men"), abs=0.02)
    assert toxicity.toxicity_scores(odd, model).count() == odd.count()
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.toxicity_scores(none, model).count() == 0
    assert toxicity.train(docs, labels.where("false")).score("x") < 0.01


def test_swaps_are_penalised():
    rows = [(1, [0, 2]), (0, [1])] * 40 + [(1, [2]), (0, [])] * 40
    free, held = (toxicity.fit(rows, 3, [((0,), (1,), 1.0)], penalty=p)[0] for p in (0.0, 50.0))
    assert free[0] > held[0] + 0.1 and abs(held[0] - held[1]) < 0.1 and held[2] > 1


def test_sentences_are_swapped_one_by_one():
    chosen = {f: i for i, f in enumerate(("=women", "=men", "=girls", "=idiot"))}
    got = toxicity.differences("women came. men came, the idiot said! nobody else\nwomen and men came.", chosen)
    assert got == {((0,), (1,)): 1, ((1,), (2,)): 1, ((0,), (2,)): 1}
    pairs = toxicity.weighted_pairs(got, chosen, 0.9)
    assert sum(p[2] for p in pairs) == pytest.approx(1) and sum(p[2] for p in toxicity.weighted_pairs({}, chosen, 0.9)) == pytest.approx(1)
    assert "~字你" in toxicity.features_of("很长的字你好") and "~zy" in toxicity.features_of("x" * 40 + "zy")


@pytest.fixture(scope="module")
def biased(spark):
    """Insults, four in ten of them in words of their own, that mostly name one group; and neutral mentions of groups."""
    import random

    rnd = random.Random(12)
    group = lambda p: "muslims" if rnd.random() < p else rnd.choice(["christians", "jews", "hindus", "buddhists"])
    rows = []
    for i in range(3000):
        toxic = i % 3 == 0
        insult = rnd.choice(["idiot", "scum", "trash"]) if rnd.random() < 0.6 else "".join(rnd.choice("bcdfgklmnprstvz") for _ in range(8))
        own = f"we met {group(0.9)} in town, {insult}." if toxic else f"we met {group(0.1) if i % 3 == 1 else 'friends'} in town."
        rows.append((i, f"some words of no weight {rnd.choice('abcdefgh') * 3}. {own}", int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_neutral_mentions_are_no_false_positives(spark, biased):
    docs, labels = biased.select("doc_id", "text"), biased.select("doc_id", "toxic")
    mention = ["we met muslims in town.", "many muslims live here.", "muslims and jews met."]
    plain = ["we met people in town.", "many people live here.", "people met."]
    rise = {}
    for p in (0.0, 200.0):
        model = toxicity.train(docs, labels.where(~toxicity.held_out()), penalty=p)
        rise[p] = sum(model.score(a) - model.score(b) for a, b in zip(mention, plain)) / 3
        if p:
            held = {r.doc_id: r for r in toxicity.toxicity_scores(docs.where(toxicity.held_out()), model).collect()}
            truth = {r.doc_id: r.toxic for r in labels.collect()}
            named = [i for i in held if truth[i] == 1]
            caught = sum(held[i].predicted for i in named) / len(named)
            wrong = sum(r.predicted for i, r in held.items() if truth[i] == 0)
            assert caught > 0.5 and wrong == 0
    assert rise[0.0] > 0.3 and rise[200.0] < 0.1 * rise[0.0]


def test_held_out_labels(spark):
    """Held-out rows of labels: at least 0.95 of what is predicted toxic is, and 0.8 of what is toxic is found (measured: 85 of 86, and 85 of 97)."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    own = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where(toxicity.held_out())
    n = {(r.predicted, r.toxic): r["count"] for r in own.groupBy("predicted", "toxic").count().collect()}
    right = n.get((1, 1), 0)
    assert right >= 0.95 * (right + n.get((1, 0), 0)) and right >= 0.8 * (right + n.get((0, 1), 0)) and right > 3
