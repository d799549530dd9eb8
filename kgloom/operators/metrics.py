"""Accuracy, consistency and completeness of triples, and their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import entity_name
from kgloom.functions.rx import strip
from kgloom.operators import curate, graph, rules, triples as T
from kgloom.session import cut

#: Errors by what an annotator's comment holds, in order, and what is left (fixed values).
ERRORS = (("边界错误", ("边界", "boundary")), ("类型错误", ("类型", "type", "关系")), ("幻觉", ("幻觉", "hallucination", "不存在")))
OTHER_ERROR = "其他"
WEIGHTS = {"accuracy": 0.5, "consistency": 0.2, "completeness": 0.3}


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def names(triples: DataFrame) -> DataFrame:
    """Distinct normalised entity names of head and tail."""
    return triples.select(F.explode(F.array(entity_name(F.col("head")), entity_name(F.col("tail")))).alias("entity")).distinct()


def facts(triples: DataFrame) -> DataFrame:
    """A9's key: names normalised, the relation as it is."""
    return triples.select(entity_name(F.col("head")).alias("head"), "relation", entity_name(F.col("tail")).alias("tail")).distinct()


def prf(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: correct, predicted, gold, precision, recall, f1 of two sets of rows with the same columns; one shuffle of each."""
    side = lambda df, n: df.distinct().select(*df.columns, F.lit(n == 1).alias("p"), F.lit(n == 2).alias("g"))
    both = side(predicted, 1).union(side(gold.select(*predicted.columns), 2)).groupBy(*predicted.columns).agg(F.bool_or("p").alias("p"), F.bool_or("g").alias("g"))
    counts = both.agg(F.count_if(F.col("p") & F.col("g")).alias("correct"), F.count_if("p").alias("predicted"), F.count_if("g").alias("gold"))
    p, r = ratio(F.col("correct"), F.col("predicted")), ratio(F.col("correct"), F.col("gold"))
    return counts.select("correct", "predicted", "gold", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def coverage(predicted: DataFrame, gold_entities: DataFrame, gold_relations: DataFrame) -> DataFrame:
    """A10: entity_coverage, relation_coverage: shares of the truth's entities and relation types that are predicted."""
    e = prf(names(predicted), gold_entities.select(entity_name(F.col("entity")).alias("entity"))).select(F.col("recall").alias("entity_coverage"))
    r = prf(predicted.select("relation"), gold_relations.select("relation")).select(F.col("recall").alias("relation_coverage"))
    return e.crossJoin(r)


def accuracy(predicted: DataFrame, gold_entities: DataFrame, gold: DataFrame) -> DataFrame:
    """Structs entity and relation, one row."""
    e = prf(names(predicted), gold_entities.select(entity_name(F.col("entity")).alias("entity"))).select(F.struct("*").alias("entity"))
    return e.crossJoin(prf(facts(predicted), facts(gold)).select(F.struct("*").alias("relation")))


def symmetric_of(relations: DataFrame) -> DataFrame:
    return relations.where("is_symmetric").select(F.col("name").alias("relation"))


def mutex_of(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("name").alias("r1"), F.explode("mutex_with").alias("r2"))


def consistency(predicted: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of violations of schema (rows), symmetry (pairs) and mutual exclusion (declared directions), one row."""
    count = lambda df, c: df.agg(F.count("*").alias(c))
    out = count(T.schema_violations(predicted, relations), "schema_violations").crossJoin(count(rules.symmetric_violations(predicted, symmetric_of(relations)), "symmetric_violations"))
    return out.crossJoin(count(rules.mutex_violations(predicted, mutex_of(relations)), "mutex_violations")).crossJoin(count(predicted, "n_triples"))


#: The checks of consistency, in their order.
CHECKS = ("entity_synonyms", "symmetric_violations", "transitive_missing", "relation_conflicts", "schema_violations")


def consistency_checks(triples: DataFrame, relations: DataFrame, symmetric: DataFrame, transitive: DataFrame, conflicts: DataFrame, k: int = 10) -> DataFrame:
    """Kind, n, examples for each of ``CHECKS``: how many were found, and the k least of them as text, parts joined by " - ".

    symmetric and transitive name relations (column relation), conflicts pairs of them (r1, r2). Synonyms are entities of which one's name holds the other;
    a fact off the schema counts as often as it is there. What is found is written once, counted with partial sums, and ranked with k rows a task. A kind of which
    there is none has n = 0 and no examples.
    """
    of_kind = triples.join(F.broadcast(transitive.select("relation").distinct()), "relation", "left_semi")
    found = (
        (rules.substring_pairs(T.entities(triples)), ("entity_1", "entity_2")),
        (rules.symmetric_violations(triples, symmetric), ("head", "relation", "tail")),
        (rules.transitive_gaps(of_kind), ("relation", "a", "b", "c")),
        (rules.mutex_violations(triples, conflicts), ("head", "r1", "r2", "tail")),
        (T.schema_violations(triples, relations), ("head", "relation", "tail")),
    )
    told = cut(reduce(DataFrame.union, (df.select(F.lit(kind).alias("kind"), F.concat_ws(" - ", *columns).alias("example")) for kind, (df, columns) in zip(CHECKS, found))))
    first = told.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("example"))).where(F.col("nth") <= k)
    examples = first.groupBy("kind").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    kinds = triples.sparkSession.createDataFrame([(c,) for c in CHECKS], "kind string")
    out = kinds.join(told.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").join(examples, "kind", "left")
    return out.select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def completeness(predicted: DataFrame, gold_entities: DataFrame, gold_relations: DataFrame) -> DataFrame:
    """Normalised names are counted, raw names are connected; one row."""
    counts = names(predicted).agg(F.count("*").alias("entity_count")).crossJoin(predicted.agg(F.count("*").alias("relation_count")))
    shape = graph.connectivity_stats(predicted).select(F.col("isolated_entities").alias("isolated_entities_count"), "avg_connectivity")
    out = coverage(predicted, gold_entities, gold_relations).crossJoin(counts).crossJoin(shape)
    return out.select("entity_coverage", "relation_coverage", "entity_count", "relation_count", ratio(F.col("entity_count"), F.col("relation_count")).alias("entity_relation_ratio"), "isolated_entities_count", ratio(F.col("isolated_entities_count"), F.col("entity_count")).alias("isolated_entities_rate"), "avg_connectivity")


def scores(entity_f1: Column, relation_f1: Column, violations: Column, n_triples: Column, entity_coverage: Column, relation_coverage: Column, isolated_rate: Column) -> dict[str, Column]:
    """Accuracy, consistency, completeness and total, 0 to 100."""
    acc = (0.4 * entity_f1 + 0.6 * relation_f1) * 100
    cons = F.greatest(F.lit(0.0), (1 - ratio(violations, n_triples)) * 100)
    comp = (0.4 * entity_coverage + 0.4 * relation_coverage + 0.2 * (1 - isolated_rate)) * 100
    return {"accuracy_score": acc, "consistency_score": cons, "completeness_score": comp, "total_score": WEIGHTS["accuracy"] * acc + WEIGHTS["consistency"] * cons + WEIGHTS["completeness"] * comp}


def _tagged(predicted: DataFrame, gold_entities: DataFrame, gold: DataFrame, relations: DataFrame) -> DataFrame:
    """tag, a, r, b, bits: what the metrics count, as keys with flags.

    n: a name, f: a fact, t: a relation (bits: 1 predicted, 2 true); e: a raw name, d: a raw name and a neighbour; s: a symmetric fact, its ends in order (bits: 1
    and 2 the two directions); m: a head and tail and a pair of relations that exclude each other (bits: 1 and 2 the two); c and v: a row, and one off the schema, keyed by
    its relation. The catalog is packed into one row.
    """
    none = F.lit(None).cast("string")
    key = lambda tag, a=none, r=none, b=none, bits=1: F.struct(F.lit(tag).alias("tag"), a.alias("a"), r.alias("r"), b.alias("b"), F.lit(bits).alias("bits"))
    h, r, t = F.col("head"), F.col("relation"), F.col("tail")

    def both(side: int) -> list[Column]:
        return [key("f", entity_name(h), r, entity_name(t), side), key("t", none, r, none, side)]

    pairs = F.coalesce("mutex_with", F.array().cast("array<string>"))
    packed = relations.agg(F.collect_set("name").alias("__names"), F.collect_set(F.when(F.col("is_symmetric"), F.col("name"))).alias("__sym"), F.flatten(F.collect_list(F.transform(pairs, lambda x: F.struct(F.col("name").alias("r1"), x.alias("r2"))))).alias("__mutex"))
    ordered = (h <= t) | h.isNull() | t.isNull()
    symmetric = F.when(F.coalesce(F.array_contains("__sym", r), F.lit(False)), F.array(F.when(ordered, key("s", h, r, t)).otherwise(key("s", t, r, h, 2))))
    half = lambda p: F.array(
        F.when(r == p["r1"], key("m", h, F.concat_ws(chr(0), p["r1"], p["r2"]), t, 1)), F.when(r == p["r2"], key("m", h, F.concat_ws(chr(0), p["r1"], p["r2"]), t, 2))
    )
    mutex = F.when(h.isNotNull() & t.isNotNull() & r.isNotNull(), F.array_compact(F.flatten(F.transform(F.array_distinct("__mutex"), half))))
    off = F.when(~F.coalesce(F.array_contains("__names", r), F.lit(False)), F.array(key("v", none, r)))
    own = [key("n", entity_name(h)), key("n", entity_name(t)), *both(1), key("e", h), key("e", t), key("d", h, none, t), key("d", t, none, h), key("c", none, r)]
    empty = F.array().cast("array<struct<tag:string,a:string,r:string,b:string,bits:int>>")
    parts = [F.array(*own), *(F.coalesce(x, empty) for x in (symmetric, mutex, off))]
    told = predicted.select("head", "relation", "tail").crossJoin(F.broadcast(packed)).select(F.explode(F.concat(*parts)).alias("k"))
    true = gold.select("head", "relation", "tail").select(F.explode(F.array(*both(2))).alias("k"))
    named = gold_entities.select(key("n", entity_name(F.col("entity")), bits=2).alias("k"))
    return told.union(true).union(named).select("k.*")


def evaluation(predicted: DataFrame, gold_entities: DataFrame, gold: DataFrame, relations: DataFrame) -> DataFrame:
    """The metrics document of one row: structs accuracy, consistency, completeness, and the scores.

    Each table is read once: what is counted is tagged, grouped with its flags and added up, so there is one shuffle of partial groups.
    """
    keys = _tagged(predicted, gold_entities, gold, relations).groupBy("tag", "a", "r", "b").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("n"))
    tag, bits = F.col("tag"), F.col("bits")
    has = lambda t, bit: F.count_if((tag == t) & (bits.bitwiseAND(bit) != 0))
    each = lambda t: F.count_if((tag == t) & (bits == 3))
    rows = lambda t: F.coalesce(F.sum(F.when(tag == t, F.col("n"))), F.lit(0))
    # a fact with both ends alike is its own inverse; one with an end missing has none
    lacks = (tag == "s") & (bits != 3) & ((F.col("a") != F.col("b")) | F.col("a").isNull() | F.col("b").isNull())
    counts = keys.agg(
        *(c.alias(f"{t}_{name}") for t in "nft" for name, c in (("correct", each(t)), ("predicted", has(t, 1)), ("gold", has(t, 2)))),
        rows("v").alias("schema_violations"), F.count_if(lacks).alias("symmetric_violations"), each("m").alias("mutex_violations"), rows("c").alias("n_triples"), has("e", 1).alias("raw"), has("d", 1).alias("near"),
    )

    def prf_of(t: str) -> Column:
        c, p, g = (F.col(f"{t}_{name}") for name in ("correct", "predicted", "gold"))
        precision, recall = ratio(c, p), ratio(c, g)
        return F.struct(c.alias("correct"), p.alias("predicted"), g.alias("gold"), precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"))

    recall = lambda t: ratio(F.col(f"{t}_correct"), F.col(f"{t}_gold"))
    names_n, none = F.col("n_predicted"), F.lit(0).cast("bigint")
    shape = F.struct(
        recall("n").alias("entity_coverage"), recall("t").alias("relation_coverage"), names_n.alias("entity_count"), F.col("n_triples").alias("relation_count"), ratio(names_n, F.col("n_triples")).alias("entity_relation_ratio"),
        none.alias("isolated_entities_count"), ratio(none, names_n).alias("isolated_entities_rate"), ratio(F.col("near"), F.col("raw")).alias("avg_connectivity"),
    )
    out = counts.select(F.struct(prf_of("n").alias("entity"), prf_of("f").alias("relation")).alias("accuracy"), F.struct("schema_violations", "symmetric_violations", "mutex_violations", "n_triples").alias("consistency"), shape.alias("completeness"))
    c = F.col
    own = scores(c("accuracy.entity.f1"), c("accuracy.relation.f1"), c("consistency.schema_violations") + c("consistency.symmetric_violations") + c("consistency.mutex_violations"), c("consistency.n_triples"), c("completeness.entity_coverage"), c("completeness.relation_coverage"), c("completeness.isolated_entities_rate"))
    return out.select("*", *(v.alias(k) for k, v in own.items()))


def violation_examples(predicted: DataFrame, relations: DataFrame, k: int = 5) -> DataFrame:
    """Kind, head, relation, tail of the first k violations of each kind, in order of names."""
    first = lambda df, kind, rel: df.orderBy("head", rel, "tail").limit(k).select(F.lit(kind).alias("kind"), "head", F.col(rel).alias("relation"), "tail")
    mutex = rules.mutex_violations(predicted, mutex_of(relations)).withColumn("relation", F.concat_ws("/", "r1", "r2"))
    return first(T.schema_violations(predicted, relations), "schema", "relation").union(first(rules.symmetric_violations(predicted, symmetric_of(relations)), "symmetric", "relation")).union(first(mutex, "mutex", "relation"))


def relation_coverage(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """One row; used / all can exceed 1 with relations off the schema."""
    used = triples.agg(F.count_distinct("relation").alias("used_relations"))
    return relations.agg(F.count_distinct("name").alias("total_relations")).crossJoin(used).select("total_relations", "used_relations", ratio(F.col("used_relations"), F.col("total_relations")).alias("coverage_rate"))


def relation_report(triples: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """One row: relation_coverage's columns, unused (names of the schema that no triple has, sorted), distribution (relation and n, sorted by name) and top (the k most frequent).

    Its arrays are as long as the catalog and the relations in use, not as the triples.
    """
    counts = triples.where("relation is not null").groupBy("relation").agg(F.count("*").alias("n"))
    every = F.array_sort(F.collect_list(F.struct("relation", "n")))
    by_n = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "relation"))), 1, k), lambda x: F.struct(x["relation"].alias("relation"), (-x["m"]).alias("n")))
    shape = counts.agg(every.alias("distribution"), by_n.alias("top"))
    unused = curate.unused(relations, counts).agg(F.array_sort(F.collect_list("relation")).alias("unused"))
    return relation_coverage(triples, relations).crossJoin(unused).crossJoin(shape)


def label_of(value: Column) -> Column:
    """True for 1 and 1.0, false for 0 and 0.0, else null."""
    v = strip(value)
    return F.when(v.isin("1", "1.0"), True).when(v.isin("0", "0.0"), False)


def annotated(rows: DataFrame, gold: int | None = None) -> DataFrame:
    """Precision over all rows, unlabelled ones included; recall and f1 only where the number of true ones is given."""
    counts = rows.agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("total"))
    p = ratio(F.col("correct"), F.col("total"))
    r = ratio(F.col("correct"), F.lit(gold)) if gold is not None else F.lit(None).cast("double")
    return counts.select("correct", "total", p.alias("precision"), r.alias("recall"), (f1(p, r) if gold is not None else F.lit(None).cast("double")).alias("f1"))


def error_types(rows: DataFrame) -> DataFrame:
    """Error, n for wrong rows (is_correct false) by their comment, zeros included."""
    text = F.lower(F.coalesce("comment", F.lit("")))
    kind = F.lit(OTHER_ERROR)
    for name, words in reversed(ERRORS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        kind = F.when(hit, name).otherwise(kind)
    every = [*(name for name, _ in ERRORS), OTHER_ERROR]
    counts = rows.where(~F.col("is_correct")).agg(*(F.count_if(kind == name).alias(f"n{i}") for i, name in enumerate(every)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("error"), F.col(f"n{i}").alias("n")) for i, name in enumerate(every)))))


def weighted_score(relation_f1: Column, relation_precision: Column, violations: Column, relation_cov: Column, isolated_rate: Column, total_triples: int = 1000, weights: dict[str, float] | None = None) -> dict[str, Column]:
    """The other score; violations count against a fixed number of triples."""
    w = weights or WEIGHTS
    acc = F.coalesce(relation_f1, relation_precision, F.lit(0.0)) * 100
    cons = F.greatest(F.lit(0.0), (1 - violations / total_triples) * 100) if total_triples else F.lit(100.0)
    comp = (relation_cov * 0.6 + (1 - isolated_rate) * 0.4) * 100
    return {"accuracy": acc, "consistency": cons, "completeness": comp, "weighted": w["accuracy"] * acc + w["consistency"] * cons + w["completeness"] * comp}


def suggestions(accuracy_score: Column, synonyms: Column, schema_violations: Column, relation_cov: Column, isolated_rate: Column) -> Column:
    """An array of advice; one of praise where there is none. The sentences are fixed values, as are the limits."""
    percent = lambda c: F.format_string("%.1f%%", c * 100)
    told = F.array_compact(F.array(
        F.when(accuracy_score < 70, "准确率较低，建议：(1) 优化Schema定义，增加description；(2) 调整模型参数；(3) 增加训练数据"),
        F.when(synonyms > 50, "检测到大量可能的同义实体，建议进行实体融合和消歧处理"),
        F.when(schema_violations > 0, F.concat(F.lit("存在"), schema_violations.cast("string"), F.lit("个Schema违规，建议检查抽取逻辑"))),
        F.when(relation_cov < 0.5, F.concat(F.lit("关系覆盖率仅"), percent(relation_cov), F.lit("，建议增加文本数据或优化抽取策略"))),
        F.when(isolated_rate > 0.3, F.concat(F.lit("孤立实体比例达"), percent(isolated_rate), F.lit("，建议检查实体抽取的完整性"))),
    ))
    return F.when(F.size(told) == 0, F.array(F.lit("整体表现良好，继续保持！"))).otherwise(told)
