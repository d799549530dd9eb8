import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.operators import curate, entity_types, extract, graph, metrics, resolve, rules, triples as T
from kgloom.plans import pipelines, queries, reports
from kgloom.session import cut

TRIPLE = "head string, relation string, tail string, source string, method string, ord bigint"
RELATION = "idx int, name string, description string, head_types array<string>, tail_types array<string>, is_symmetric boolean, mutex_with array<string>"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("a", "sym", "b"), ("b", "sym", "a"), ("a", "sym", "c"), ("d", "sym", "d"), ("a", "up", "b"), ("a", "down", "b"), ("a", "up", "b"), ("x", "off", "y"), ("b", "up", "c")]
    return spark.createDataFrame([(*r, f"s{i}", "normalized" if i % 2 else "raw", i) for i, r in enumerate(rows)], TRIPLE)


@pytest.fixture(scope="module")
def schema(spark):
    return spark.createDataFrame([(0, "sym", "", ["T"], [], True, []), (1, "up", "d", [], [], False, ["down"]), (2, "down", "", [], ["U"], False, ["up"])], RELATION)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_first_wins_and_idempotent(facts):
    once = T.dedup(facts)
    assert [r.ord for r in once.where("relation = 'up' and head = 'a'").collect()] == [4]
    assert rows(T.dedup(once)) == rows(once)


def test_symmetry(facts, schema):
    sym = metrics.symmetric_of(schema)
    assert rows(rules.symmetric_violations(facts, sym)) == [("a", "sym", "c")]
    done = rules.complete_symmetric(facts, sym)
    assert rows(done.where("method = 'symmetric_completion'")) == [("c", "sym", "a", "s2", "symmetric_completion", 2)]
    assert rules.symmetric_violations(done, sym).isEmpty()


def test_mutex(facts, schema):
    pairs = metrics.mutex_of(schema)
    assert rules.mutex_violations(facts, pairs).count() == 2  # each declared direction
    left = rules.resolve_mutex(facts, pairs).where("head = 'a' and tail = 'b'")
    assert rows(left) == [("a", "down", "b", "s5", "normalized", 5)]  # the innocent sym goes, too
    one_sided = pairs.where("r1 = 'down'")
    assert rules.resolve_mutex(facts.where("ord <> 6"), one_sided).count() == 8  # up comes first: no conflict seen
    assert rules.resolve_mutex(facts, one_sided).where("head = 'a' and tail = 'b'").count() == 1


def test_transitive_and_substrings(spark, facts):
    assert rows(rules.transitive_gaps(facts.where("relation = 'up'"))) == [("up", "a", "b", "c")]
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(150)})
    got = rows(rules.substring_pairs(spark.createDataFrame([(n,) for n in names], "entity string")))
    assert got == sorted(((a, b) for a, b in itertools.combinations(names, 2) if a in b or b in a), key=str)


def test_types(facts, schema, spark):
    types = spark.createDataFrame([("a", "U", 0.9), ("b", "T", 0.8)], "entity string, type string, score double")
    checked = rules.check_types(rules.with_types(facts, types), schema)
    assert [r.ord for r in checked.where("not ok").orderBy("ord").collect()] == [0, 2, 5]
    assert rules.rejection_reasons(checked).first().reason == "down: head=U, tail=T"
    assert {r.head_type for r in T.with_defaults(rules.with_types(facts, types)).where("head = 'x'").collect()} == {""}


def clique_model(ids, linked):
    seen, out = set(), {}
    for i in ids:
        if i in seen:
            continue
        comp, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in comp and linked(x, y):
                    comp.add(y)
                    todo.append(y)
        seen |= comp
        if len(comp) > 1 and all(linked(x, y) for x, y in itertools.combinations(comp, 2)):
            out |= {x: sorted(comp) for x in comp}
    return out


def test_clusters_like_union_find(spark):
    rnd = random.Random(9)
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(55)} | {(70, 71), (71, 72), (70, 72), (80, 81), (81, 82)}
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a int, b int, sim double")
    got = {r.id: r.cluster for r in resolve.clusters(pairs).collect()}
    assert got == clique_model(range(90), lambda x, y: (min(x, y), max(x, y)) in edges)


def test_blocks_find_all_pairs(spark):
    rnd = random.Random(2)
    vs = []
    for i in range(40):
        v = [rnd.gauss(0, 1) for _ in range(4)]
        n = sum(x * x for x in v) ** 0.5
        vs.append((i, [x / n for x in v]))
    df = spark.createDataFrame(vs, "id int, vector array<double>")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(vs, 2) if sum(p * q for p, q in zip(x, y)) >= 0.6}
    for blocks in (1, 3):
        assert {(r.a, r.b) for r in resolve.similar_pairs(df, 0.6, blocks).collect()} == want
    assert resolve.similar_pairs(df.where("id < 0"), 0.6).isEmpty()


def test_canonical_names(spark):
    pairs = spark.createDataFrame([("ab", "b", 0.95), ("a", "ab", 0.94), ("a", "b", 0.96)], "a string, b string, sim double")
    names = resolve.canonical_names(spark.createDataFrame([("a",), ("ab",), ("b",), ("z",)], "entity string"), resolve.clusters(pairs), pairs)
    assert rows(names.select("entity", "canonical")) == [("a", "a"), ("ab", "a"), ("b", "a"), ("z", "z")]
    header, log = resolve.merge_counts(names, 0.93).first(), resolve.merge_log(names)
    assert (header.n_entities, header.n_canonical, header.n_merged) == (4, 2, 1)
    assert "【a】 (共 3 个)" in reports.normalization_log(header, log)


def test_best_type_ties_and_floor(spark):
    protos = spark.createDataFrame([(0, "A", [1.0, 0.0]), (1, "B", [1.0, 0.0]), (2, "C", [-1.0, 0.0])], "type_idx int, type string, vector array<double>")
    scores = entity_types.type_scores(spark.createDataFrame([("p", [1.0, 0.0]), ("n", [0.0, 1.0])], "entity string, vector array<double>"), protos)
    assert rows(entity_types.best_types(scores, 0.5)) == [("p", "A", 1.0)]
    assert rows(entity_types.best_types(scores, 0.0)) == [("n", "A", 0.0), ("p", "A", 1.0)]
    assert rows(entity_types.untyped(scores, 0.5)) == [("n", 0.0)]
    catalog = spark.createDataFrame([(0, "A", "d" * 100, ["x"]), (1, "B", "", None)], "idx int, name string, description string, examples array<string>")
    assert rows(entity_types.prototypes(catalog)) == [(0, "A", "A"), (0, "A", "A: " + "d" * 80), (0, "A", "x"), (1, "B", "B")]


def test_metrics_of_nothing(spark, facts, schema):
    none = facts.where("false")
    gold_e = spark.createDataFrame([], "entity string")
    m = metrics.evaluation(none, gold_e, none, schema).first()
    assert m.accuracy.entity.f1 == 0 and m.completeness.avg_connectivity == 0 and m.consistency_score == 100
    full = metrics.evaluation(facts, T.entities(facts), facts, schema)
    m = full.first()
    assert m.accuracy.relation.f1 == 1 and m.consistency.schema_violations == 1 and m.accuracy_score == pytest.approx(100)
    report = reports.evaluation_report(full)
    assert "准确性得分:   100.00" in report and report.startswith("=" * 80)
    assert {r.bin: r.n for r in graph.connectivity_bins(none).collect()} == dict.fromkeys(graph.BINS, 0)
    assert graph.density(none).first().density == 0


def test_annotations_and_advice(spark):
    df = spark.createDataFrame([("1.0", ""), ("0", "类型 wrong"), (" 0.0 ", "BOUNDARY 关系"), ("?", "x"), ("0", None)], "v string, comment string")
    own = df.select(metrics.label_of(F.col("v")).alias("is_correct"), "comment")
    assert {r.error: r.n for r in metrics.error_types(own).collect()} == {"边界错误": 1, "类型错误": 1, "幻觉": 0, "其他": 1}
    assert metrics.annotated(own).first().precision == 0.2 and metrics.annotated(own, 2).first().recall == 0.5
    say = lambda *v: spark.range(1).select(metrics.suggestions(*(F.lit(x) for x in v)).alias("s")).first().s
    assert say(90.0, 0, 0, 1.0, 0.0) == ["整体表现良好，继续保持！"]
    assert len(say(60.0, 51, 2, 0.25, 0.4)) == 5 and "25.0%" in say(60.0, 0, 0, 0.25, 0.0)[1]


def test_curation(spark, facts):
    names = spark.createDataFrame([("a",), ("b",), ("q",)], "entity string")
    e, r = curate.referential(names, facts.select(*curate.FACT))
    assert rows(e) == [("a",), ("b",)] and r.count() == 5
    doc = curate.graph_document(facts).first()
    assert doc.entities[:3] == ["a", "b", "c"] and len(doc.relations) == 9


def test_responses_and_prompts(spark):
    answers = [
        'x {"r": [{"subject": 1, "object": null}, {"subject": "", "object": "b"}, 3], "q": 5} y',
        '{"r": [], "r": [{"subject": "a", "object": true}]}',
        '{"r": [{"subject": " é\\n", "object": "\\u4e2d"}, [], {"object": "b"}], "": [{"subject": "a", "object": "b"}], "s": [{"subject": {"k": 1}, "object": "o"}]}',
        "no", "{bad", None, "[1]", "{}", '{"r": {"subject": "a", "object": "b"}}',
    ]
    got = spark.createDataFrame(list(enumerate(answers)), "i int, t string").select("i", extract.parsed(F.col("t")).alias("p")).collect()
    found = {r.i: [tuple(x) for x in r.p or ()] for r in got}
    assert found[0] == [("1", "r", "None")] and found[1] == [("a", "r", "True")] and found[2] == [("é", "r", "中"), ('{"k":1}', "s", "o")]
    assert not any(found[i] for i in range(3, 9))
    assert '"input": "t"' in extract.build_prompt({"r": "d"}, "t")


def test_extraction_pipeline(spark):
    docs = spark.createDataFrame([("d1", "甲 uses 乙。甲 uses 乙。丙 near 丁"), ("d2", "甲 uses 乙"), ("d3", "")], "doc_id string, text string")
    rel = spark.createDataFrame([(i, n, "", [], [], n == "near", []) for i, n in enumerate(["r0", "r1", "r2", "r3", "uses", "near"])], RELATION)
    assert extract.schema_batches(rel).count() == 2
    raw = cut(pipelines.extracted(docs, rel, extract.PatternExtractor))
    assert {r[:3] for r in rows(raw.select("head", "relation", "tail"))} == {("丙", "near", "丁"), ("甲", "uses", "乙")}
    assert raw.count() == 2 and raw.where("source = 'd1'").count() == 2
    vectors = cut(extract.encode(T.entities(raw).withColumnRenamed("entity", "id"), extract.GramEncoder, "id"))
    own, names = pipelines.normalized(raw, vectors, 0.93, rel)
    assert names.count() == 4 and own.count() == 2
    assert pipelines.postprocessed(own, rel).count() == 3
    gold = raw.select(*curate.FACT)
    m = pipelines.evaluated(docs, rel, T.entities(raw), gold, extract.PatternExtractor, extract.GramEncoder).first()
    assert m.accuracy.entity.recall == 1 and m.consistency.symmetric_violations == 0


def test_first_file_and_order_in_an_answer(spark):
    """A fact is credited to the first file by name, and facts of one answer that exclude each other do not both stay."""
    rel = spark.createDataFrame([(0, "likes", "", [], [], False, ["hates"]), (1, "hates", "", [], [], False, [])], RELATION)
    docs = spark.createDataFrame([(d, "A likes B。") for d in ("z", "a0", "d1", "a0-b")] + [("y", "C x。A hates B。")], "doc_id string, text string")
    raw = cut(pipelines.extracted(docs, rel, extract.PatternExtractor))
    assert {(r.relation, r.source) for r in raw.collect()} == {("likes", "a0-b"), ("hates", "y")}  # a0-b.md comes before a0.md
    one = spark.createDataFrame([("d", "A likes B。 C x。A hates B。")], "doc_id string, text string")
    raw = cut(pipelines.extracted(one, rel, extract.PatternExtractor))
    assert raw.count() == 2
    assert [r.relation for r in rules.resolve_mutex(raw, metrics.mutex_of(rel)).collect()] == ["hates"]
    many = spark.createDataFrame([(i, f"r{i}", "", [], [], False, []) for i in range(300)], RELATION)
    raw = pipelines.extracted(spark.createDataFrame([("d", "a r0 b。a r299 b")], "doc_id string, text string"), many, extract.PatternExtractor)
    assert max(r.ord.batch_no for r in raw.collect()) == 74


def test_nulls_among_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0]), (None, [1.0, 0.0])], "id int, vector array<double>")
    assert rows(resolve.similar_pairs(df, 0.5).select("a", "b")) == [(1, 3)]


def test_report_of_relations(spark, facts, schema):
    r = metrics.relation_report(facts.where("relation <> 'down'"), schema, 2).first()
    assert r.unused == ["down"] and [tuple(x) for x in r.distribution] == [("off", 1), ("sym", 4), ("up", 3)] and [x.relation for x in r.top] == ["sym", "up"]
    assert metrics.relation_report(facts.where("false"), schema).first().distribution == []


def test_catalog_of_prototypes_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(entity_types, "MOST_PROTOTYPES", 1)
    protos = spark.createDataFrame([(0, "A", [1.0]), (1, "B", [1.0])], "type_idx int, type string, vector array<double>")
    with pytest.raises(ValueError):
        entity_types.type_scores(spark.createDataFrame([("p", [1.0])], "entity string, vector array<double>"), protos)


def test_similar_pairs_in_strips(spark, monkeypatch):
    """Blocks and strips of any size give the pairs of the whole product; no vectors give no pairs."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(v @ v.T, 1) >= 0.8))}
    for blocks, cells in ((None, 1 << 22), (None, 700), (5, 1), (5, 100)):
        monkeypatch.setattr(resolve, "CELLS", cells)
        got = [(r.a, r.b) for r in resolve.similar_pairs(rows, 0.8, blocks).collect()]
        assert len(got) == len(want) and set(got) == want
    monkeypatch.setattr(resolve, "BLOCK_LEAST", 100)
    assert resolve._blocks(rows) == 3 and resolve._blocks(rows.where("false")) == 1
    assert resolve.similar_pairs(rows.where("false"), 0.8).count() == 0


def test_substrings_without_a_hot_beginning(spark):
    """Names of one long beginning: candidates stay within a small factor of the pairs."""
    names = [f"the common beginning of names {i} x{i * 7 % 1000}" for i in range(1500)] + [f"beginning of names {i}" for i in range(40)] + ["x", "é", "名", "名字"]
    df = spark.createDataFrame([(n,) for n in names], "entity string")
    want = sorted((min(a, b), max(a, b)) for a in set(names) for b in set(names) if len(a) < len(b) and a in b)
    assert rows(rules.substring_pairs(df)) == want
    short, long = rules.substring_keys(df)
    assert short.join(long, "g").count() <= 3 * len(want) + 2 * len(names)


@pytest.mark.parametrize("hub", [3, 1024])
def test_gaps_through_a_hub(spark, hub):
    edges = [(f"a{i}", "r", "hub") for i in range(20)] + [("hub", "r", f"c{i}") for i in range(15)] + [("a0", "r", "c0"), ("a1", "r", "m"), ("m", "r", "c1"), ("m", "q", "c2"), ("a0", "r", "c0")]
    df = spark.createDataFrame(edges, "head string, relation string, tail string")
    have = set(edges)
    want = sorted({(r, a, b, c) for a, r, b in have for b2, r2, c in have if b == b2 and r == r2 and (a, r, c) not in have}, key=str)
    assert rows(rules.transitive_gaps(df, hub)) == want
    counts = {}
    for r, a, _, c in want:
        counts[r, a, c] = counts.get((r, a, c), 0) + 1
    assert rows(rules.gap_counts(df, hub)) == sorted(((*k, n) for k, n in counts.items()), key=str)


@pytest.fixture(scope="module")
def clustered(spark):
    """Unit vectors in tight groups of one to six, one group a third of all."""
    rnd = np.random.default_rng(2)
    centers = rnd.normal(size=(120, 24))
    of = np.concatenate([np.zeros(150, int), rnd.integers(0, 120, 300)])
    x = centers[of] + 0.12 * rnd.normal(size=(450, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")


@pytest.mark.parametrize("threshold", [0.93, 0.6])
def test_pivots_keep_every_pair(spark, clustered, monkeypatch, threshold):
    x, df = clustered
    monkeypatch.setattr(resolve, "BLOCK_BYTES", 8 * 24 * 40)  # cells are cut
    sims = x @ x.T
    want = sorted((i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if sims[i, j] >= threshold)
    got = resolve.similar_pairs(df, threshold).collect()
    assert sorted((r.a, r.b) for r in got) == want and all(abs(r.sim - sims[r.a, r.b]) < 1e-9 for r in got)
    dealt = resolve.plan(df, threshold)
    if threshold > 0.9:
        assert dealt.pivots is not None and dealt.products < 0.4 * len(x) * (len(x) + 1) / 2
    assert sorted((r.a, r.b) for r in resolve.similar_pairs(df, threshold, blocks=3).collect()) == want


def test_one_forest_gives_every_cut(spark, clustered):
    x, df = clustered
    pairs = cut(resolve.similar_pairs(df, 0.5))
    forest = resolve.merge_forest(pairs)
    links = forest.collect()
    assert len({(r.a, r.b) for r in links}) == len(links)
    for t in (0.5, 0.7, 0.85, 0.9):
        whole = rows(resolve.clusters(pairs.where(F.col("sim") >= t)))
        assert rows(resolve.cut_at(forest, pairs, t)) == whole
    root = {i: i for i in range(len(x))}
    find = lambda i: i if root[i] == i else find(root[i])
    for r in links:
        assert find(r.a) != find(r.b)  # no cycle
        root[find(r.a)] = find(r.b)
    assert resolve.merge_forest(pairs.where("false")).count() == 0


def test_evaluation_in_one_pass_like_its_parts(spark, facts, schema):
    odd = facts.union(spark.createDataFrame([(None, "sym", "x", "s", "m", 90), ("x", None, "y", "s", "m", 91), (" A", "up", "b", "s", "m", 92)], TRIPLE))
    gold = facts.where("ord % 2 = 0")
    names = T.entities(gold)
    got = metrics.evaluation(odd, names, gold, schema).first()
    assert got.accuracy.entity == metrics.accuracy(odd, names, gold).first().entity and got.accuracy.relation == metrics.accuracy(odd, names, gold).first().relation
    assert got.consistency == metrics.consistency(odd, schema).select(F.struct("*").alias("c")).first().c
    assert got.completeness.asDict() == pytest.approx(metrics.completeness(odd, names, gold.select("relation")).first().asDict())


def test_consistency_checks(spark):
    facts = spark.createDataFrame([("a", "对比", "ab", 1), ("a", "包含", "b", 2), ("b", "包含", "c", 3), ("a", "优化", "b", 4), ("a", "降低", "b", 5), ("x", "y", "z", 6), ("x", "y", "z", 7)], "head string, relation string, tail string, ord int")
    names = lambda *own: spark.createDataFrame([(n,) for n in own], "relation string")
    catalog = names("对比", "包含", "优化", "降低").withColumnRenamed("relation", "name")
    pairs = spark.createDataFrame([("优化", "降低"), ("提高", "降低")], "r1 string, r2 string")
    checks = metrics.consistency_checks(facts, catalog, names("对比"), names("包含"), pairs, 1)
    got = {r.kind: (r.n, r.examples) for r in checks.collect()}
    assert got == {"entity_synonyms": (2, ["a - ab"]), "symmetric_violations": (1, ["a - 对比 - ab"]), "transitive_missing": (1, ["包含 - a - b - c"]), "relation_conflicts": (1, ["a - 优化 - 降低 - b"]), "schema_violations": (2, ["x - y - z"])}
    none = {r.kind: (r.n, r.examples) for r in metrics.consistency_checks(facts.where("false"), catalog, names("对比"), names("包含"), pairs).collect()}
    assert none == {kind: (0, []) for kind in metrics.CHECKS}
    lines = reports.checks_report(checks).split("\n")
    assert [x for x in lines if x.startswith("【")] == [f"【{kind}】" for kind in metrics.CHECKS] and "  a - 优化 - 降低 - b" in lines


def test_cliques_without_pairs(spark, clustered):
    """Every threshold's clusters from sums over neighbourhoods: those of the pairs, with a row for each vector and block it meets at most."""
    x, df = clustered
    pairs, levels = cut(resolve.similar_pairs(df, 0.5)), (0.5, 0.7, 0.85, 0.9)
    for blocks in (None, 3):
        got = resolve.cliques(df, levels, blocks).collect()
        for at, t in enumerate(levels):
            assert sorted(list(r.cluster) for r in got if r.level == at) == sorted({tuple(r.cluster): r.cluster for r in resolve.clusters(pairs.where(F.col("sim") >= t)).collect()}.values())
    assert resolve.cliques(df.where("false"), levels).count() == 0
    twice = df.where("id < 60").union(df.where("id < 9")).union(spark.createDataFrame([(200, x[0].tolist()), (200, x[300].tolist())], df.schema))
    links = resolve.similar_pairs(twice.distinct(), 0.7)
    assert sorted(r.cluster for r in resolve.cliques(twice, [0.7]).collect()) == sorted({tuple(r.cluster): r.cluster for r in resolve.clusters(links).collect()}.values())
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)], "id bigint, vector array<double>")
    parts = resolve.hoods(same, [0.9], 3).collect()
    assert {r.n for r in parts} == {299} and len(parts) == 300


def test_names_from_vectors_like_those_from_pairs(spark, clustered):
    _, df = clustered
    own = df.select(F.concat(F.lit("e"), "id").alias("id"), "vector")
    names = own.select(F.col("id").alias("entity")).union(spark.createDataFrame([("none",)], "entity string"))
    pairs = cut(resolve.similar_pairs(own, 0.85))
    told = lambda d: rows(d.select("entity", "canonical", F.round("sim", 9)))
    assert told(resolve.resolved_names(names, own, 0.85)) == told(resolve.canonical_names(names, resolve.clusters(pairs), pairs))


def test_chunks_are_asked_once(spark, tmp_path, monkeypatch):
    """Conflicts read the facts several times, but each prompt is asked once."""
    log = str(tmp_path / "asked")

    class Counting(extract.PatternExtractor):
        def __call__(self, prompts):
            with open(log, "a") as out:
                out.write("x" * len(prompts))
            return super().__call__(prompts)

    texts = ["a the b. " + "x" * 300, "a of b", None, "c de d {", "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(extract, "PatternExtractor", Counting)
    got = rows(queries.end_to_end_mutex(spark, str(tmp_path)))
    assert got == [("a", "of", "b", "1"), ("c", "de", "d", "3")]
    with open(log) as f:
        assert len(f.read()) == 2 * 6  # two batches; the first text has three chunks
