"""Quality rules as a short-circuit cascade.

Base measures are taken of every text. The other rules stand in a cascade: on a bounded sample each rule's cost (seconds a
text) and selectivity (texts it rejects) are estimated, and rules run in the order of rejections per cost, each only on
what the rules before it left. A text is kept if no rule rejects it, so the order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows on which cost and selectivity are estimated at most.
SAMPLE_ROWS = 256
#: What separates words (fixed values): space, and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass
class Measured:
    """A text and its base measures."""

    text: str
    words: list[bytes]
    lines: list[str]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def measure(text: str | None) -> Measured:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly SPACES
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return Measured(text, words, lines, len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that are found at least twice, the first finding included."""
    n = len(words)
    if n < 4:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(ids) >= n - 2 and len(ids) == n:
        return 0
    a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    size = len(ids)
    pair = np.unique(a[:-1] * size + a[1:], return_inverse=True)[1]  # exact: numbers, not hashes
    _, inverse, counts = np.unique(pair[:-1] * size + a[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    on = np.zeros(n, bool)
    for k in range(3):
        on[k : n - 2 + k] |= twice
    return int(on.sum())


#: Name: whether it rejects a text that passed the base. All are whole-number comparisons.
RULES: dict[str, Callable[[Measured], bool]] = {
    "symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words,
    "dup_lines": lambda m: 10 * m.n_dup_lines > 6 * len(m.lines),
    "alphabetic": lambda m: 10 * sum(any(c.isalpha() for c in w.decode("utf-8", "surrogatepass")) for w in m.words) < 7 * m.n_words,
    "bullets": lambda m: 10 * sum(x.lstrip(SPACES)[:1] in "-*•" for x in m.lines) > 9 * len(m.lines),
    "ellipsis": lambda m: 10 * sum(x.rstrip(SPACES).endswith(("...", "…")) for x in m.lines) > 3 * len(m.lines),
}


def estimate(docs: DataFrame, text_col: str = "text", rules: dict[str, Callable[[Measured], bool]] | None = None, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Each rule's seconds a text and share of texts rejected, on up to ``rows`` texts, measured on an executor.

    Every row is as likely to be taken: a share sized from the table's count, four times too many so that enough come, then a limit. So what
    reaches the task is a few times ``rows``, however many partitions there are.
    """
    rules = rules or RULES
    share = min(1.0, 4 * rows / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, n = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for batch in batches:
            texts = [m for t in batch.column(0).to_pylist() if not (m := measure(t)).base_failed]
            n += len(texts)
            for name, rule in rules.items():
                began = time.perf_counter()
                rejected[name] += sum(map(rule, texts))
                spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "s": list(spent.values()), "rejected": pa.array(list(rejected.values()), pa.int64()), "n": pa.array([n] * len(rules), pa.int64())})

    got = docs.select(F.col(f"`{text_col}`").cast("string")).sample(share, 42).limit(rows).mapInArrow(run, "rule string, s double, rejected bigint, n bigint").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("s", "rejected", "n"))).collect()
    found = {r["rule"]: (r["s"] / max(r["n"], 1), r["rejected"] / max(r["n"], 1)) for r in got}
    return {name: found.get(name, (0.0, 0.0)) for name in rules}


def ordered(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Names by rejection per cost, highest first; rules that rejected nothing by cost."""
    return sorted(estimates, key=lambda k: (-estimates[k][1] / max(estimates[k][0], 1e-9), estimates[k][0], k))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Callable[[Measured], bool]] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by of every row.

    rejected_by names the first rule of the cascade that rejected a text (base where the base failed, null where kept). A null
    or empty text has no words and fails the base. Repeated rows give repeated rows, a null id stays null, other columns are
    not read, and an empty table gives an empty one. Texts of any length are measured whole.
    """
    rules = rules or RULES
    order = ordered(estimate(docs, text_col, rules))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [(name, rules[name]) for name in order]
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                m = measure(t)
                by = "base" if m.base_failed else next((name for name, rule in cascade if rule(m)), None)
                rows.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, by is None, by))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["__id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    schema = f"__id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, rejected_by string"
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema).withColumnRenamed("__id", id_col)
