"""Toxicity: a linear classifier whose scores may not depend on which group a sentence names.

Features are words and how words begin (of scripts without spaces, and of very long words, short runs of letters everywhere), each once a text. Weights are
never negative, so clean text around an insult does not hide it and long texts are not diluted. Training minimises the log loss of labelled
texts, a ridge, and the mean squared change of the score over counterfactual pairs of sentences:

* of every labelled sentence that names a group, the sentence and itself with each term swapped for the next of its kind;
* of neutral mentions laid into labelled sentences, one for each term: a sentence with the term and with the next of its kind, and, for sentences labelled
  0, with the term and without it. A corpus that names few groups, or none, is regularised by these.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Labelled rows to learn from at most: those whose ids hash lowest.
TRAIN_ROWS = 20_000
#: Features kept: those that speak most for the label, by log-likelihood ratio.
FEATURES = 4096
#: A feature must be in so many training texts, and its log-likelihood ratio (half of G squared) must be so high, that chance does not explain it.
LEAST_TEXTS, LEAST_GAIN = 4, 10
RIDGE = 1e-4
SWAP_PENALTY = 1.0
#: Neutral mentions count as so many pairs for each pair found in a sentence, and as one pair in all where there is none.
MENTION_SHARE = 0.5
#: Words of more letters than this, and words in scripts without spaces, are seen as their runs of so many letters.
LONG_WORD, RUNS = 24, (2, 3, 4)
#: How many first letters of a word make a feature.
BEGINNINGS = (4, 5, 6)
CACHE_WORDS = 300_000
#: Terms that name groups, by kind; a term is swapped for the next of its kind (fixed values).
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("young", "old", "elderly"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, t in enumerate(kind)}

words_of = re.compile(r"[^\W\d_]+").findall
unspaced = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]").search
sentences_of = re.compile(r"(?<=[.!?])\s+|[\n。！？]+").split


def features_of(word: str) -> set[str]:
    """A word and its beginnings, or, where words are not told apart by spaces or are very long, its runs of letters at every place."""
    if len(word) > LONG_WORD or unspaced(word):
        return {"~" + word[i : i + n] for n in RUNS for i in range(len(word) - n + 1)}
    return {"=" + word, *(word[:n] for n in BEGINNINGS if len(word) > n)}


def swapped(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


def differences(text: str, chosen: dict[str, int]) -> Counter:
    """(features that go, features that come): how many sentences of a lower-case text change so when their terms are swapped."""
    out: Counter = Counter()
    for sentence in sentences_of(text):
        words = set(words_of(sentence))
        if words & SWAP.keys():
            a, b = ({chosen[f] for w in ws for f in features_of(w) if f in chosen} for ws in (words, swapped(words)))
            if a != b:
                out[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1
    return out


def mentions(chosen: dict[str, int], share_clean: float) -> list[tuple[tuple[int, ...], tuple[int, ...], float]]:
    """Pairs of neutral mentions, as (features that go, features that come, weight); the weights sum to 1.

    A mention changes a linear score by the features of its term alone, so one pair stands for all sentences that it is laid into.
    """
    ids = {t: {chosen[f] for f in features_of(t) if f in chosen} for t in SWAP}
    out = []
    for t, other in SWAP.items():
        out.append((tuple(sorted(ids[t] - ids[other])), tuple(sorted(ids[other] - ids[t])), 1 / (1 + share_clean) / len(SWAP)))
        out.append((tuple(sorted(ids[t])), (), share_clean / (1 + share_clean) / len(SWAP)))
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    #: Words that hold no feature, of two generations.
    neutral: set[str] = field(default_factory=set)
    older: set[str] = field(default_factory=set)

    def score(self, text: str | None) -> float:
        words = set(words_of((text or "").lower())) - self.neutral
        found: set[str] = set()
        for w in words:
            if w in self.older:
                self.neutral.add(w)
            elif hits := [f for f in features_of(w) if f in self.weights]:
                found.update(hits)
            else:
                self.neutral.add(w)
        if len(self.neutral) > CACHE_WORDS:
            self.older, self.neutral = self.neutral, set()
        z = self.bias + math.fsum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _counts(labelled: DataFrame) -> DataFrame:
    """feature, pos, neg: texts that hold it, summed over a batch before they go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos: Counter = Counter()
            neg: Counter = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (pos if label else neg).update({f for w in set(words_of(text.lower())) for f in features_of(w)})
            every = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([pos[f] for f in every], pa.int64()), pa.array([neg[f] for f in every], pa.int64())], ["feature", "pos", "neg"])

    return labelled.mapInArrow(run, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _rows(labelled: DataFrame, chosen: dict[str, int], most: int) -> list:
    """label, features, swaps of each of at most ``most`` texts: at most len(chosen) numbers, and each change of a sentence once with its number."""
    lists = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("gone", lists), ("come", lists), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, ids, swaps = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text.lower()
                label.append(y)
                ids.append(sorted({chosen[f] for w in set(words_of(text)) for f in features_of(w) if f in chosen}))
                swaps.append([{"gone": a, "come": b, "n": n} for (a, b), n in differences(text, chosen).items()])
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(ids, lists), pa.array(swaps, kind)], ["label", "ids", "swaps"])

    return labelled.mapInArrow(run, "label int, ids array<int>, swaps array<struct<gone:array<int>,come:array<int>,n:int>>").limit(most).collect()


def fit(rows: list[tuple[int, list[int]]], n: int, pairs: list[tuple[tuple[int, ...], tuple[int, ...], float]] = (), ridge: float = RIDGE, penalty: float = SWAP_PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights (none below 0) and bias, by projected gradient steps with a step size for each feature; pairs have weights that sum to 1."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -10.0
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([i for r in rows for i in r[1]], np.int64)
    signs = [(k, i, s) for k, (a, b, _) in enumerate(pairs) for ids, s in ((a, 1.0), (b, -1.0)) for i in ids]
    pk, pi, ps = (np.array(x) for x in zip(*signs)) if signs else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    pk, pi, weight = pk.astype(np.int64), pi.astype(np.int64), np.array([p[2] for p in pairs], float)
    w, b, sum_w, sum_b = np.zeros(n), 0.0, np.full(n, 1e-8), 1e-8
    for _ in range(steps):
        z = b + np.bincount(at, w[col], len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(col, e[at], n) + ridge * w
        if len(pk):
            change = weight * np.bincount(pk, ps * w[pi], len(pairs))
            g += penalty * np.bincount(pi, ps * change[pk], n)
        sum_w += g * g
        sum_b += e.sum() ** 2
        w = np.maximum(0, w - 0.5 * g / np.sqrt(sum_w))
        b -= 0.5 * e.sum() / math.sqrt(sum_b)
    return w, b


def weighted_pairs(swaps: Counter, chosen: dict[str, int], share_clean: float) -> list[tuple[tuple[int, ...], tuple[int, ...], float]]:
    """The pairs of sentences and of neutral mentions, with weights that sum to 1."""
    total = sum(swaps.values())
    share = MENTION_SHARE / (1 + MENTION_SHARE) if total else 1.0
    return [(a, b, (1 - share) * k / total) for (a, b), k in swaps.items()] + [(a, b, share * x) for a, b, x in mentions(chosen, share_clean)]


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", penalty: float = SWAP_PENALTY) -> Model:
    """A model of at most ``train_rows`` labelled ids and as many rows; rows with a null id, text or label are not learned from.

    Of several labels of an id the highest counts; each row of a repeated id is learned from. Without both labels every text gets the same score.
    """
    own = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna()
    own = own.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).dropna()
    labelled = texts.join(F.broadcast(own), "__id").select("__text", "__y")  # at most train_rows ids
    pos, neg = (F.col(c).cast("double") for c in ("pos", "neg"))
    totals = {r["y"]: r["n"] for r in labelled.groupBy(F.col("__y").alias("y")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return Model({}, math.log((n_pos + 0.5) / (n_neg + 0.5)) if n_pos + n_neg else -10.0)
    rate = n_pos / (n_pos + n_neg)
    gain = pos * F.log((pos + 0.01) / ((pos + neg) * rate)) + neg * F.log((neg + 0.01) / ((pos + neg) * (1 - rate)))
    best = _counts(labelled).where((pos + neg >= LEAST_TEXTS) & (pos > (pos + neg) * rate) & (gain >= LEAST_GAIN)).orderBy(F.desc(F.round(gain, 6)), "feature").limit(FEATURES)
    terms = sorted({f for t in SWAP for f in features_of(t)})
    chosen = {f: i for i, f in enumerate(dict.fromkeys([*(r["feature"] for r in best.select("feature").collect()), *terms]))}
    found = _rows(labelled, chosen, train_rows)
    swaps: Counter = Counter()
    for r in found:
        for s in r["swaps"]:
            swaps[tuple(s["gone"]), tuple(s["come"])] += s["n"]
    w, b = fit([(r["label"], list(r["ids"])) for r in found], len(chosen), weighted_pairs(swaps, chosen, 1 - rate), penalty=penalty)
    return Model({f: float(w[i]) for f, i in chosen.items() if w[i] > 1e-6}, float(b))


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row.

    A null text is scored as an empty one. Repeated rows give repeated rows, a null id stays null, other columns are not read,
    an empty table gives an empty one. Whole texts are scored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run = _scorer(model, 1, lambda batch, s: [batch.column(0), s, pa.compute.greater_equal(s, 0.5).cast(pa.int32())], ["__id", "score", "predicted"])
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"__id {kind}, score double, predicted int").withColumnRenamed("__id", id_col)


def _scorer(model: Model, text_at: int, out, names):
    import pyarrow.compute  # noqa: F401  (pa.compute)

    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        own = Model(weights, bias)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            scores = pa.array([own.score(t) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays(out(batch, scores), names)

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is never learned from: the CRC-32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns; rows of null or empty texts are judged by the bias alone."""
    text = docs.columns.index(text_col)
    run = _scorer(model, text, lambda batch, s: [*batch.columns, s], [*(f"c{i}" for i in range(len(docs.columns))), "__score"])
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = StructType([*plain.schema, StructField("__score", DoubleType())])
    return plain.mapInArrow(run, schema).where("__score < 0.5").drop("__score").toDF(*docs.columns)
