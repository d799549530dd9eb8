"""Text reports on one-row metrics (S18, S19, S21, S22). The wording of titles and lines is fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

from kgloom.operators.metrics import CHECKS

RULE, THIN = "=" * 80, "-" * 80


def _sections(title: str, sections: list[tuple[str, list[str]]]) -> str:
    out = [RULE, title, RULE, ""]
    for name, lines in sections:
        out += [f"【{name}】", THIN, *lines, ""]
    return "\n".join([*out, RULE, "评估完成", RULE, ""])


def _prf(name: str, r: Row) -> list[str]:
    return [f"{name}:", f"  精确率: {r['precision']:.2%}", f"  召回率: {r['recall']:.2%}", f"  F1:     {r['f1']:.2%}", f"  正确数: {r['correct']}/{r['predicted']}"]


def evaluation_report(metrics: DataFrame) -> str:
    """Of the one row of metrics.evaluation."""
    m = metrics.first()
    a, c, k = m["accuracy"], m["consistency"], m["completeness"]
    return _sections("综合评估报告", [
        ("一、总体评分", [f"准确性得分:   {m['accuracy_score']:.2f}", f"一致性得分:   {m['consistency_score']:.2f}", f"完整性得分:   {m['completeness_score']:.2f}", f"综合得分:     {m['total_score']:.2f}"]),
        ("二、准确性评估", [*_prf("实体评估", a["entity"]), "", *_prf("关系评估", a["relation"])]),
        ("三、一致性评估", [f"Schema违规数:     {c['schema_violations']}", f"对称性违规数:     {c['symmetric_violations']}", f"互斥性违规数:     {c['mutex_violations']}"]),
        ("四、完整性评估", [f"实体覆盖率:       {k['entity_coverage']:.2%}", f"关系覆盖率:       {k['relation_coverage']:.2%}", f"实体数量:         {k['entity_count']}", f"关系数量:         {k['relation_count']}", f"孤立实体比例:     {k['isolated_entities_rate']:.2%}", f"平均连接度:       {k['avg_connectivity']:.2f}"]),
    ])


def accuracy_report(counts: Row, errors: list[Row]) -> str:
    """Of metrics.annotated and metrics.error_types."""
    shown = lambda v: "-" if v is None else f"{v:.2%}"
    return _sections("准确性评估报告", [("准确率", [f"正确数: {counts['correct']}/{counts['total']}", f"精确率: {counts['precision']:.2%}", f"召回率: {shown(counts['recall'])}", f"F1: {shown(counts['f1'])}"]), ("错误类型", [f"{e['error']}: {e['n']}" for e in errors])])


def consistency_report(counts: dict[str, int], samples: dict[str, list[Row]]) -> str:
    """Counts by kind of violation and the first examples of each."""
    return _sections("一致性评估报告", [(kind, [f"数量: {n}", *("  " + " - ".join(map(str, r)) for r in samples.get(kind, ()))]) for kind, n in counts.items()])


def checks_report(checks: DataFrame) -> str:
    """Of metrics.consistency_checks, in the order of its kinds."""
    rows = {r["kind"]: r for r in checks.collect()}
    own = [rows[kind] for kind in CHECKS]
    return consistency_report({r["kind"]: r["n"] for r in own}, {r["kind"]: [(e,) for e in r["examples"]] for r in own})


def completeness_report(mentions: Row, top: list[Row], shape: Row, bins: list[Row], dense: Row) -> str:
    """Of graph.mention_stats, top_entities, connectivity_stats, connectivity_bins and density."""
    return _sections("完整性评估报告", [
        ("实体覆盖度", [f"实体总数: {mentions['total_entities']}", f"总提及次数: {mentions['total_mentions']}", f"平均提及次数: {mentions['avg_mentions_per_entity']:.2f}", *(f"  {r['entity']}: {r['n']}" for r in top)]),
        ("实体连接度", [f"孤立实体数: {shape['isolated_entities']} ({shape['isolated_rate']:.2%})", f"平均连接度: {shape['avg_connectivity']:.2f}", f"最大连接度: {shape['max_connectivity']}", f"最小连接度: {shape['min_connectivity']}", *(f"  {r['bin']}: {r['n']}" for r in bins)]),
        ("知识密度", [f"密度: {dense['density']:.6f}", f"实体-关系比: {dense['entity_relation_ratio']:.4f}"]),
    ])


def combined_report(scores: dict[str, float], advice: list[str]) -> str:
    """The scores of metrics.weighted_score and the advice of metrics.suggestions."""
    return _sections("综合质量评估报告", [("得分", [f"{k}: {v:.2f}" for k, v in scores.items()]), ("改进建议", [f"{i}. {s}" for i, s in enumerate(advice, 1)])])


def normalization_log(header: Row, merged: DataFrame) -> str:
    """Merged clusters, largest first, members with their similarity to the canonical name."""
    out = ["实体归一化日志", "=" * 60, f"阈值: {header['threshold']}", f"原始实体数: {header['n_entities']}", f"标准实体数: {header['n_canonical']}", f"发生合并的簇: {header['n_merged']} 个", f"未合并的实体: {header['n_single']} 个", ""]
    for r in merged.toLocalIterator():
        out += [f"标准名: 【{r['canonical']}】 (共 {r['n_members']} 个)", *(f"  ← {m['name']}  (sim={m['sim'] or 0.0:.4f})" for m in r["members"]), ""]
    return "\n".join(out)


def postprocess_log(relations: list[Row], types: list[Row], reasons: list[Row]) -> str:
    """Histograms of relations and types, and why triples were rejected."""
    return _sections("后处理日志", [("关系分布", [f"{r['relation']}: {r['n']}" for r in relations]), ("类型分布", [f"{r['type']}: {r['n']}" for r in types]), ("过滤原因", [f"{r['reason']}: {r['n']}" for r in reasons])])
