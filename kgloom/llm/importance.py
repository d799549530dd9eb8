"""Importance resampling of documents towards a target distribution of hashed word runs.

Counting: each task adds up its documents' buckets in one array and sends a row a bucket; corpus and target give a gain for each bucket, a table
of ``BUCKETS`` numbers, whatever the corpus. Scoring: a document's weight is the mean gain of its features, taken from that array, and its score
the weight plus Gumbel noise of its id, so that the highest scores are a sample without replacement in proportion to the exponents of the weights.

Drawing: the eligible rows of each partition are sorted (by Spark, which spills) into runs, whose slices are packed and exchanged by ranges of the
order. A histogram of the scores, which are whole numbers in a range that does not grow with the corpus, gives ranges of about ``RANGE_ROWS``
rows, and rows before each range. Each range is a task that merges its slices by a tournament tree and stops at the exact count of the draw; ranges
behind the last drawn rank are neither exchanged nor merged. A score that more rows share than a range holds is divided by ids.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import Cache, by_bytes, scratch, written

BUCKETS, RUN_WORDS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
RANGE_ROWS = 1 << 17
#: Distinct features whose buckets a task remembers, at most twice.
KNOWN = 1 << 17
#: Bytes that are of no word are white space, capitals small.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Features:
    """The buckets of texts' features: all runs of 1 to ``runs`` consecutive words, joined by a space; repeats count."""

    def __init__(self, buckets: int = BUCKETS, runs: int = RUN_WORDS) -> None:
        self.buckets, self.runs, self.known = buckets, runs, Cache(KNOWN)

    def of(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of all features, text after text; features of each text; words of each text)."""
        every, words = [], []
        for text in texts:
            own = text.translate(_WORDS).split() if text else []
            words.append(len(own))
            every.append(own + [b" ".join(own[i : i + k]) for k in range(2, self.runs + 1) for i in range(len(own) - k + 1)])
        for feature in self.known.unknown(every):
            self.known[feature] = zlib.crc32(feature) % self.buckets
        sizes = np.array([len(own) for own in every], np.int64)
        get = self.known.__getitem__
        got = np.fromiter((b for own in every for b in map(get, own)), np.int64, int(sizes.sum()))
        self.known.trim()
        return got, sizes, np.array(words, np.int64)


def _texts(docs: DataFrame, text_col: str) -> Column:
    return F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text")


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, runs: int = RUN_WORDS, text_col: str = "text") -> DataFrame:
    """bucket, n of the buckets that features of docs fall in; a task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, runs), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in by_bytes([t or b"" for t in texts]):
                total += np.bincount(features.of(texts[a:b])[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return docs.select(_texts(docs, text_col)).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths, from (bucket, n) of both; this many numbers come to the driver and no more."""
    s, t = [0] * buckets, [0] * buckets
    for to, counts in ((s, corpus), (t, target)):
        for bucket, n in counts.collect():
            to[bucket] = n
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]


def noise(key: str, seed: int = SEED) -> int:
    """Gumbel noise of a key, in thousandths, from the first 32 bits of the SHA-256 of ``seed:key``."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], runs: int = RUN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, n_features, n_words, weight, score of every row of docs; a null id has no score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, table = Features(len(gain), runs), np.array(gain, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in by_bytes([t or b"" for t in texts]):
                buckets, sizes, words = features.of(texts[a:b])
                sums = np.concatenate([[0], np.cumsum(table[buckets])])
                ends = np.cumsum(sizes)
                weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
                score = [None if i is None else int(w) + noise(str(i), seed) for i, w in zip(ids[a:b].to_pylist(), weight)]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(sizes), pa.array(words), pa.array(weight), pa.array(score, pa.int64())], ["__id", "n_features", "n_words", "weight", "score"])

    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("__id"), _texts(docs, text_col))
    return own.mapInArrow(run, "__id bigint, n_features bigint, n_words bigint, weight bigint, score bigint")


class Tournament:
    """A tree of losers over sorted runs of keys: the least head of all runs is at its top; taking it replays one path from leaf to top."""

    def __init__(self, runs: Sequence[Sequence[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [(0, *r[0]) if len(r) else (1,) for r in runs] + [(1,)] * (self.leaves - len(runs))
        winners = list(range(self.leaves))
        self.losers, level = [0] * self.leaves, self.leaves
        while level > 1:  # winners of a level's matches play on, losers stay where they lost
            level //= 2
            pairs = [(winners[2 * k], winners[2 * k + 1]) for k in range(level)]
            winners = [x if self.heads[x] <= self.heads[y] else y for x, y in pairs]
            self.losers[level : 2 * level] = [y if w == x else x for w, (x, y) in zip(winners, pairs)]
        self.winner = winners[0]

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) of all keys in order; of equal keys, that of the first run comes first."""
        heads, losers = self.heads, self.losers
        while heads[w := self.winner][0] == 0:
            at = self.at[w]
            yield w, at
            self.at[w] = at + 1
            heads[w] = (0, *self.runs[w][at + 1]) if at + 1 < len(self.runs[w]) else (1,)
            node = (w + self.leaves) // 2
            while node:
                other = losers[node]
                if (heads[other], other) < (heads[w], w):
                    losers[node], w = w, other
                node //= 2
            self.winner = w


#: What a slice of a run packs of each of its rows, the order's own columns first.
_PACKED = ("score", "__id", "n_features", "weight")


def _ranges(eligible: DataFrame, rows: int) -> DataFrame:
    """score, first (its first range), ids (bounds of ids that divide it into further ones; none but for a score of very many rows): higher scores first.

    Scores are whole numbers within bounds that no corpus moves (a gain's and the noise's), so this table has tens of thousands of rows at most.
    """
    counts = written(eligible.groupBy("score").agg(F.count("*").alias("n")), "histogram")
    many = counts.where(F.col("n") > rows).select("score", F.col("n").alias("__n"))
    parts = F.ceil(F.col("__n") / rows).cast("int")
    shares = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: i / parts)
    # each share's id by approximate percentiles of one grid, so that the percentages are a constant
    grid = [i / 1000 for i in range(1, 1000)]
    cuts = eligible.join(many, "score").groupBy("score").agg(F.percentile_approx("__id", grid, 10_000).alias("grid"), F.max("__n").alias("__n"))
    ids = cuts.where(parts > 1).select(F.col("score").alias("__s"), F.array_distinct(F.transform(shares, lambda x: F.element_at("grid", F.greatest(F.lit(1), F.round(x * 1000).cast("int"))))).alias("ids"))
    table = [(score, n, ids or []) for score, n, ids in counts.join(ids, F.col("score") == F.col("__s"), "left").select("score", "n", "ids").orderBy(F.desc("score")).collect()]
    out, at, filled = [], 0, 0
    for score, n, bounds in table:
        if filled and (bounds or filled + n > rows):
            at, filled = at + 1, 0
        out.append((score, at, bounds))
        at, filled = (at + len(bounds) + 1, 0) if bounds else (at, filled + n)
    return eligible.sparkSession.createDataFrame(out, "score bigint, first bigint, ids array<bigint>")


def _slices(runs: DataFrame) -> DataFrame:
    """range, slice: the rows of each range that follow one another in their order, packed in arrays.

    A partition may read several sorted files, one after the other, so a slice ends where the order falls as well as where the range changes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, score, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            falls = (score[1:] > score[:-1]) | ((score[1:] == score[:-1]) & (ids[1:] < ids[:-1]))
            ends = np.append(np.flatnonzero((own[1:] != own[:-1]) | falls) + 1, len(own)).astype(np.int32) if len(own) else np.zeros(0, np.int32)
            starts = np.concatenate([np.zeros(1, np.int32), ends]).astype(np.int32)
            packed = [pa.ListArray.from_arrays(pa.array(starts), batch.column(1 + i)) for i in range(len(_PACKED))] if len(own) else [pa.array([], pa.list_(pa.int64()))] * len(_PACKED)
            yield pa.RecordBatch.from_arrays([pa.array(own[starts[:-1]]) if len(own) else pa.array([], pa.int64()), *packed], ["range", *_PACKED])

    return runs.select("range", *_PACKED).mapInArrow(run, "range bigint, " + ", ".join(f"{c} array<bigint>" for c in _PACKED))


def _merged(slices: DataFrame, before: DataFrame, draw: int) -> DataFrame:
    """The rows of every range with their ranks; those after the last rank of the draw have none. before: range, before (rows of earlier ranges)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = table.column("before")[0].as_py()
        runs = [{c: table.column(c)[i].values.to_numpy(zero_copy_only=False) for c in _PACKED} for i in range(table.num_rows)]
        keys = [list(zip((-r["score"]).tolist(), r["__id"].tolist())) for r in runs]
        bases = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        rank = np.zeros(int(bases[-1]), np.int64)
        left = draw - at
        for place, (which, own) in enumerate(Tournament(keys)):
            if place >= left:  # the draw is complete
                break
            rank[bases[which] + own] = at + place + 1
        columns = [pa.array(np.concatenate([r[c] for r in runs])) for c in _PACKED]
        return pa.table([*columns, pa.array(rank, mask=rank == 0)], names=[*_PACKED, "rank"])

    held = slices.join(before, "range")
    return held.groupBy("range").applyInArrow(run, ", ".join(f"{c} bigint" for c in (*_PACKED, "rank")))


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of :func:`scored`'s (written) table without n_words, with rank: 1, 2, 3... of the highest scores of the eligible rows, null for all others.

    Eligible are rows with a score and at least ``least_words`` words; floor(percent * N / 100) of N such rows are drawn, ties to the smaller id.
    Rows alike in score and id take ranks in any order, and meet in one range.
    """
    own = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    eligible = scores.where(own)
    ranges = _ranges(eligible, range_rows)
    index = F.col("first") + F.size(F.filter("ids", lambda b: b < F.col("__id")))
    placed = eligible.join(F.broadcast(ranges), "score").select(index.alias("range"), *_PACKED)
    runs = written(placed.sortWithinPartitions("range", F.desc("score"), "__id"), "runs", keep=True)
    counts = runs.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect()  # one row for range_rows rows
    draw = percent * sum(r.n for r in counts) // 100
    before, at = [], 0
    for r in counts:
        if at < draw:
            before.append((r.range, at))
            at += r.n
    last = before[-1][0] if before else -1
    taken = runs.where(F.col("range") <= last)
    ranked = _merged(_slices(taken), scores.sparkSession.createDataFrame(before, "range bigint, before bigint"), draw)
    columns = ["__id", "n_features", "weight", "score"]
    rest = runs.where(F.col("range") > last).select(*columns).union(scores.where(~own).select(*columns)).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*columns, "rank").union(rest)


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = PERCENT, runs: int = RUN_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs, drawn towards the texts of target.

    Words are runs of ASCII letters and digits and of whatever is not ASCII, capitals A-Z made small. Null and empty texts have no features,
    weight 0, and are never drawn. A row with a null id has no score and is not drawn, nor counted. Repeated rows are each a row of the
    corpus. An empty target leaves gains that only the corpus makes; an empty table gives an empty one. Other columns are not read.
    """
    with scratch():
        gain = gains(bucket_counts(docs, buckets, runs, text_col), bucket_counts(target, buckets, runs, target_text), buckets)
        scores = written(scored(docs, gain, runs, seed, id_col, text_col), "scores", keep=True)
        out = drawn(scores, percent, least_words, range_rows)
        return out.withColumnRenamed("__id", id_col)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", rank_col: str = "rank", **options) -> DataFrame:
    """The drawn rows of docs, all their columns, and ``rank_col``, which must be a new name; ids name rows (of repeated ids, each row takes every rank of its id)."""
    if rank_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already have {rank_col}")
    ranks = importance_ranks(docs, target, percent, id_col=id_col, **options).where("rank is not null").select(F.col(id_col).alias("__drawn"), F.col("rank").alias("__rank"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{id_col}`").cast("bigint").alias("__drawn"))
    return own.join(ranks, "__drawn").select("__row.*", F.col("__rank").alias(rank_col))
