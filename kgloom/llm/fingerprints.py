"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (what stands between line feeds, if not empty). Each paragraph is hashed to a wide
vector of ``LANES`` signed 16-bit numbers: those of the whole paragraph plus those of its pieces of ``PIECE`` code points, each
with its place in the paragraph. A fingerprint is the sum of the vectors, every lane modulo 2**32. So texts with the same
paragraphs in any order have equal fingerprints, a paragraph is added or taken away by adding or subtracting its vector, and because lanes
have mean 0 the squared length of the difference of two fingerprints estimates how many pieces the texts do not share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import row_key, scratch, written

LANES, PIECE, MODULUS = 64, 16, 1 << 32


def lane_sums(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, lanes array<bigint> (each in [0, 2**32)) for every value of keys, of the paragraphs of its rows' texts.

    Keys whose texts have no paragraph get zeros. Sums are taken before anything is shuffled.
    """
    paragraphs = texts.select(*keys, F.explode_outer(F.split(F.col(text_col), "\n", -1)).alias("__p"))
    pieces = paragraphs.select(*keys, F.posexplode_outer(F.when(F.length("__p") > 0, F.concat(F.array("__p"), F.regexp_extract_all("__p", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))).alias("__at", "__e"))
    hashed = pieces.select(*keys, F.col("__e").isNotNull().alias("__is"), F.xxhash64("__e", "__at").alias("__h1"), F.xxhash64(F.lit("h2"), "__at", "__e").alias("__h2"))
    wide = hashed.select(*keys, "__is", *(F.xxhash64("__h1", F.lit(j), "__h2").alias(f"__w{j}") for j in range(LANES // 4)))
    lane = lambda j, i: F.when(F.col("__is"), (F.shiftrightunsigned(f"__w{j}", 16 * i).bitwiseAND(0xFFFF) - 32768)).otherwise(0)
    sums = wide.groupBy(*keys).agg(*(F.sum(lane(j, i)).alias(f"__s{4 * j + i}") for j in range(LANES // 4) for i in range(4)))
    return sums.select(*keys, F.array(*(F.pmod(f"__s{k}", F.lit(MODULUS)) for k in range(LANES))).alias("lanes"))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS)))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs less b's."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def as_text(lanes: Column) -> Column:
    """8 hexadecimal digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints alone: 1 less the share of what they hold that they do not share. Two empty ones: 1."""

    def squares(v: Column) -> Column:
        centred = lambda x: (F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x)).cast("double")
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + centred(x) * centred(x))

    both = squares(a) + squares(b)
    return F.when(both == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - squares(minus(a, b)) / both)))


def successors(elements: DataFrame) -> DataFrame:
    """__k1, __k2, __n1, __n2: the key of the element that follows in the order of (__id, __k1, __k2), nulls first; after the last the first.

    Ranges of the order are numbered and written; each finds its own successors, and the ranges' heads, of which there are as many
    as partitions, those of the last of each range.
    """
    ranged = written(elements.select("__id", "__k1", "__k2").repartitionByRange("__id", "__k1", "__k2").withColumn("__range", F.spark_partition_id()), "ranges")
    me = F.struct("__id", "__k1", "__k2")
    heads = ranged.groupBy("__range").agg(F.min(me).alias("__head"))
    order = Window.orderBy("__range")
    after = heads.select("__range", F.coalesce(F.lead("__head").over(order), F.first("__head").over(order)).alias("__after"))
    inside = ranged.withColumn("__next", F.lead(me).over(Window.partitionBy("__range").orderBy("__id", "__k1", "__k2")))
    found = inside.join(F.broadcast(after), "__range").withColumn("__next", F.coalesce("__next", "__after"))  # a row for each partition
    return found.select("__k1", "__k2", F.col("__next.__k1").alias("__n1"), F.col("__next.__k2").alias("__n2"))


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    row's text, in ascending doc_id (nulls first; rows of one id in the order of a hash; after the last the first; a row alone is
    its own next). Rows alike in id and text are one in this order. A null text is an empty one. Other columns are not read.
    An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    keyed = rows.select("__id", "__text", *row_key(F.col("__id"), F.col("__text")))
    unique = keyed.groupBy("__k1", "__k2").agg(F.first("__id").alias("__id"), F.first("__text").alias("__text"))
    with scratch():
        sizes = written(keyed.select("__id", "__k1", "__k2", F.length("__text").alias("__n")).groupBy("__k1", "__k2").agg(F.first("__id").alias("__id"), F.first("__n").alias("__n")), "sizes")
        after = written(successors(sizes).join(sizes.select("__k1", "__k2", "__n"), ["__k1", "__k2"]), "successors")
        before = after.select(F.col("__n1").alias("__k1"), F.col("__n2").alias("__k2"), F.col("__k1").alias("__p1"), F.col("__k2").alias("__p2"), F.floor(F.col("__n") / 2).cast("int").alias("__half"))
        heads = unique.join(before, ["__k1", "__k2"]).select(F.col("__p1").alias("__k1"), F.col("__p2").alias("__k2"), F.expr("left(__text, __half)").alias("__more"))
        joined = unique.join(after, ["__k1", "__k2"]).join(heads, ["__k1", "__k2"])
        edited = joined.select("__k1", "__k2", "__n1", "__n2", "__n", "__text", F.concat(F.expr("left(__text, __n - cast(floor(__n / 2) as int))"), F.col("__more")).alias("__edited"))
        texts = edited.select("__k1", "__k2", "__n1", "__n2", "__n", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(False).alias("e"), F.col("__text").alias("t")), F.struct(F.lit(True).alias("e"), F.col("__edited").alias("t")))).alias("__v"))
        flat = texts.select("__k1", "__k2", "__n1", "__n2", "__n", "edited_sha256", F.col("__v.e").alias("__edit"), F.col("__v.t").alias("__t"))
        sums = lane_sums(flat, ["__k1", "__k2", "__n1", "__n2", "__n", "edited_sha256", "__edit"], "__t")
        prints = written(sums.groupBy("__k1", "__k2", "__n1", "__n2", "__n", "edited_sha256").agg(F.max(F.when(~F.col("__edit"), F.col("lanes"))).alias("own"), F.max(F.when(F.col("__edit"), F.col("lanes"))).alias("other")), "prints", keep=True)
    nexts = prints.select(F.col("__k1").alias("__n1"), F.col("__k2").alias("__n2"), F.col("own").alias("next"))
    near = prints.join(nexts, ["__n1", "__n2"]).select("__k1", "__k2", F.col("__n").cast("bigint").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
    return keyed.select("__id", "__k1", "__k2").join(near, ["__k1", "__k2"]).select(F.col("__id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
