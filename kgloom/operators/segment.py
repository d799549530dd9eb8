"""Chapters, sentences, chunks (G1, G2, P4) and the names of their files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.functions.rx import pieces, strip

_B = r"[\s&&[^\n]]*"
#: A chapter's heading: level marks, a number in one of three forms, a title (fixed value).
HEADING = rf"#+{_B}(?:第?{_B}[0-9一二三四五六七八九十]+{_B}[章节]|Chapter[\s&&[^\n]]+\d+|[0-9]+\.)[^\n]*"
WHOLE = "全文"
#: Bytes of texts whose chunks Python makes at a time.
PART_BYTES = 1 << 20


def chapters(docs: DataFrame, keep_preamble: bool = False) -> DataFrame:
    """G1: (doc_id, text) to doc_id, chapter_no, title, content; a text without headings is one chapter.

    What stands before the first heading is lost, as in the original semantics, unless keep_preamble.
    """
    parts = pieces(F.concat(F.lit("\n"), F.col("text")), rf"(?=\n(?i:{HEADING})(?:\n|\z))")
    is_head = lambda p: F.rlike(p, F.lit(rf"(?dU)\A\n(?i:{HEADING})(?:\n|\z)"))
    body = lambda p: F.substring(p, 2, F.length(p))
    title = lambda p: strip(F.substring_index(body(p), "\n", 1))
    rest = lambda p: F.when(F.locate("\n", body(p)) > 0, F.substring(body(p), F.locate("\n", body(p)) + 1, F.length(p))).otherwise("")
    own = F.transform(F.filter(F.col("parts"), is_head), lambda p: F.struct(title(p).alias("title"), rest(p).alias("content")))
    whole = lambda p: F.struct(F.lit(WHOLE).alias("title"), body(p).alias("content"))
    before = F.transform(F.filter(F.col("parts"), lambda p: ~is_head(p) & (F.length(p) > 0)), whole)
    found = F.when(F.size(own) == 0, F.transform(F.slice("parts", 1, 1), whole)).otherwise(F.concat(before, own) if keep_preamble else own)
    return docs.select("doc_id", parts.alias("parts")).select("doc_id", F.posexplode(found).alias("chapter_no", "c")).select("doc_id", (F.col("chapter_no") + 1).alias("chapter_no"), "c.title", "c.content")


def chapter_files(chapter_rows: DataFrame) -> DataFrame:
    """File name and content of each chapter; doc_id is the stem."""
    name = F.format_string("%s_chapter%02d_%s.md", "doc_id", "chapter_no", X.safe_title(F.col("title")))
    return chapter_rows.select("doc_id", "chapter_no", name.alias("file"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "content").alias("text"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_no, sentence."""
    return docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def sentence_files(docs: DataFrame) -> DataFrame:
    """File name and text, a sentence a line, of each document; doc_id is the stem."""
    return docs.select("doc_id", F.concat("doc_id", F.lit("_sentences.txt")).alias("file"), F.array_join(X.sentences(F.col("text")), "\n").alias("text"))


def packed(text: str | None, max_chars: int, terminators: str) -> list[str] | None:
    """Sentences packed greedily into chunks of up to max_chars; a longer sentence is cut hard and merges with nothing. Takes time in proportion to the text.

    Where a chunk that starts at a sentence ends is looked up for all sentences at once in the running sum of their lengths; the walk then jumps from chunk to chunk.
    """
    if text is None:
        return None
    own = [s for s in map(str.strip, re.findall(f"[^{terminators}]*[{terminators}]|[^{terminators}]+", text)) if s]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    after = np.searchsorted(ends, ends[:-1] + max_chars, "right") - 1  # the sentence after the chunk
    long = np.append(np.flatnonzero(sizes > max_chars), len(own))
    after = np.minimum(after, long[np.searchsorted(long, np.arange(len(own)))]).tolist()
    out, i = [], 0
    while i < len(own):
        if after[i] == i:
            out += [own[i][k : k + max_chars].strip() for k in range(0, len(own[i]), max_chars)]
            i += 1
        else:
            out.append("".join(own[i : after[i]]))
            i = after[i]
    return out


def chunk_array(text: Column, max_chars: int = 150, terminators: str = X.SENTENCE_ENDS) -> Column:
    """G2 as a column: the chunks of a text; null for a null text.

    The original asks for an overlap of 30 characters from the last sentence boundary, which is always at the chunk's end: no
    overlap ever results, and none is made here.
    """

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield chunked(texts, max_chars, terminators)

    return run(text)


def chunked(texts: pa.Array, max_chars: int, terminators: str, most: int = PART_BYTES) -> pa.Array:
    """The chunks of a batch of texts. Python holds about ``most`` bytes of its texts and their chunks at a time (or one longer text's); the rest is in Arrow."""
    kind, parts, at = pa.list_(pa.string()), [], 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        parts.append(pa.array([packed(t, max_chars, terminators) for t in texts.slice(at, to - at).to_pylist()], kind))
        at = to
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def chunks(docs: DataFrame, max_chars: int = 150, terminators: str = X.SENTENCE_ENDS) -> DataFrame:
    """doc_id, chunk_no, chunk."""
    return docs.select("doc_id", F.posexplode(chunk_array(F.col("text"), max_chars, terminators)).alias("chunk_no", "chunk"))


def chunk_stats(chunk_rows: DataFrame) -> DataFrame:
    """One row; zeros where there are no chunks."""
    size = F.length("chunk")
    return chunk_rows.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_chars"), F.coalesce(F.min(size), F.lit(0)).alias("min_chars"), F.coalesce(F.max(size), F.lit(0)).alias("max_chars"))
