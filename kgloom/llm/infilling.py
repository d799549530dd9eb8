"""Fill-in-middle transformation in Spark's SQL functions only.

``regexp_extract_all`` makes the array of a text's units, ``conv`` of ``substring`` of ``sha2`` draws the cuts, ``slice`` and ``array_join`` build
the arrangements, and splitting at the sentinels restores the text. Every row is its own: nothing is shuffled, no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a text: lines with their line feed.
LINES = "[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 documents about so many are transformed; of these, about so many have the suffix first.
RATE, SUFFIX_FIRST = 100, 50


def draws(key: Column, seed: int = SEED, n: int = 4) -> list[Column]:
    """The first n groups of 8 hexadecimal digits of the SHA-256 of ``seed:key``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def _own(c: str) -> str:
    return f"__fim_{c}"


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, units: str = LINES, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """docs, all their columns and rows, with the columns ``names``: units, form (plain, psm, spm), code points of prefix and middle, output.

    A text is cut at two places between its units, drawn from the hash of the seed and the id; a part may be empty. A text that is empty, or holds a
    sentinel itself, stays plain, as do ``100 - rate`` of 100; then its output is the text and both lengths are null. A null text is an
    empty one. A null id draws as an empty id does. Repeated rows give repeated rows; an empty table gives an empty one. Columns of docs may have any
    names but those of the new columns.
    """
    if clash := {c.lower() for c in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already have {sorted(clash)}")
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(_own("row"))
    text, key = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    cut = docs.select(kept, text.alias(_own("text")), *(h.alias(_own(f"h{i}")) for i, h in enumerate(draws(key, seed))))
    cut = cut.withColumn(_own("units"), F.regexp_extract_all(_own("text"), F.lit(units), F.lit(0))).withColumn(_own("n"), F.size(_own("units")))
    places = [F.col(_own(f"h{i}")) % (F.col(_own("n")) + 1) for i in (0, 1)]
    cut = cut.withColumn(_own("a"), F.least(*places).cast("int")).withColumn(_own("b"), F.greatest(*places).cast("int"))
    a, b, n = F.col(_own("a")), F.col(_own("b")), F.col(_own("n"))
    part = lambda first, size: F.array_join(F.slice(_own("units"), first, size), "")
    cut = cut.select("*", part(F.lit(1), a).alias(_own("p")), part(a + 1, b - a).alias(_own("m")), part(b + 1, n - b).alias(_own("s")))
    held = [F.contains(_own("text"), F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col(_own("text")) == "") | held[0] | held[1] | held[2] | (F.col(_own("h2")) % 100 >= rate)
    cut = cut.withColumn(_own("form"), F.when(plain, "plain").when(F.col(_own("h3")) % 100 < suffix_first, "spm").otherwise("psm"))
    p, m, s, form = (F.col(_own(c)) for c in ("p", "m", "s", "form"))
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    spm = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    output = F.when(form == "plain", F.col(_own("text"))).when(form == "spm", spm).otherwise(psm)
    chars = lambda c: F.when(form != "plain", F.length(c).cast("bigint"))
    made = (n.cast("bigint"), form, chars(p), chars(m), output)
    return cut.select(*(F.col(f"{_own('row')}.`{c}`").alias(c) for c in docs.columns), *(c.alias(name) for c, name in zip(made, names)))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts stand after the sentinels, in the order that its form tells.

    A sentinel cannot arise where two parts meet: each part is followed by a sentinel's own first character, or by nothing, and no part holds one.
    """
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text that is rebuilt from it, of every row."""
    own = transformed(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), seed, rate, suffix_first)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return own.select(F.col("doc_id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
