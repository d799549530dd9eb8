"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut at boundaries where no token can cross, so a very long one is never encoded in one call, and the parts of a
batch, each distinct part once, are encoded in calls that hold about as many bytes each. Parts met again are not
encoded again (a bounded cache per Python worker).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import Cache, by_bytes, bytes_of

#: Bytes in one call of the tokenizer.
CALL_BYTES = 256 << 10
#: Distinct parts that a worker remembers, twice.
CACHE_PARTS = 250_000
#: A space between white space and white space (or the end): the pre-tokenizer takes the run as one, so no cut is safe there.
INNER_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Characters of a part from which on it is cut further, where a run of letters or digits ends: no token goes on there, whatever stands around.
LONG_PART = 2048
#: Letters and what ends a run of them are named one by one, so that no table of a newer Unicode decides (fixed values).
LETTERS, ENDS = "A-Za-zà-öø-ÿа-яぁ-ゖァ-ヺ一-龥가-힣", " \n\r\t.,;:!?()、。，！？：；"
CHANGE = re.compile(rf"(?<=[{LETTERS}])(?=[0-9{ENDS}])|(?<=[0-9])(?=[{LETTERS}{ENDS}])")

_workers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _workers[path] = t, Cache(CACHE_PARTS), tuple(a.content for a in t.get_added_tokens_decoder().values())
    return _workers[path]


def parts(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """text, cut before every space that begins a token of its own whatever stands before it; long parts are cut further.

    A cut before a space is safe where a run of white space begins, or where what is left of the run is that space alone:
    byte-level pre-tokenizers give the last space of a run to the word after it. A part of more than LONG_PART characters is cut again
    where letters or digits end, unless it holds one of the special strings. One run of letters is one match of the pre-tokenizer,
    however long, and stays whole.
    """
    if " " not in text:
        out = [text] if text else []
    elif INNER_SPACE.search(text):  # runs of several: cut only before a space between two others
        out = [x for x in re.split(r"(?<=\S)(?= \S)", text) if x]
    else:
        first, *rest = text.split(" ")
        out = ([first] if first else []) + [" " + x for x in rest]
    return [y for x in out for y in _shorter(x, special)] if any(len(x) > LONG_PART for x in out) else out


def _shorter(part: str, special: tuple[str, ...]) -> list[str]:
    out, at = [], 0
    if not any(s in part for s in special):
        while len(part) - at > LONG_PART and (found := CHANGE.search(part, at + LONG_PART)):
            out.append(part[at : found.start()])
            at = found.start()
    return [*out, part[at:]]


def count_batch(texts: list[str], path: str) -> list[int]:
    """The number of tokens of each text, without begin, end or added special tokens."""
    tokenizer, cache, special = _tokenizer(path)
    cut = [parts(t, special) for t in texts]
    new = list(cache.unknown(cut))
    for a, b in by_bytes(new, CALL_BYTES):
        for p, e in zip(new[a:b], tokenizer.encode_batch_fast(new[a:b], add_special_tokens=False), strict=True):
            cache[p] = len(e)
    out = [sum(map(cache.__getitem__, ps)) for ps in cut]
    cache.trim()
    return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every row.

    tokenizer: path of a byte-level BPE file that all executors have. A null text counts as an empty one: 0 bytes, 0 tokens.
    Repeated rows give repeated rows; a null id stays null; other columns are not read. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_bytes(texts):
                n = pa.array(count_batch(texts[a:b], tokenizer), pa.int64())
                size = pa.array([bytes_of(t) for t in texts[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), size, n, pa.compute.greater(n, limit)], ["__id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401  (pa.compute)

    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(count, f"__id {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("__id", id_col)
