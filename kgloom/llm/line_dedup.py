"""Line dedup by site-relative frequency, in DataFrame functions only.

For each host, the pages that hold a line are divided by the host's pages; lines over a ratio are boilerplate of that host and are
dropped from its pages. Lines are counted once a page and summed up by host and line (128 bits of hash) before they are
shuffled, so a host or line of a third of all pages is one row a task. The table of boilerplate lines is written, and its measured
size lets the planner broadcast it where it is small and shuffle it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import row_key, scratch, written

#: A line on more than this share of a host's pages, and on so many of them at least, is boilerplate.
RATIO, LEAST_PAGES = 0.03, 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _line_key(host: str, line: Column) -> list[Column]:
    return [F.xxhash64(F.col(host), line).alias("__l1"), F.xxhash64(F.lit("l2"), line, F.col(host)).alias("__l2")]


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """__l1, __l2 of lines that exceed the ratio, for pages (__host, __text); written."""
    lines = pages.select("__host", F.explode(F.array_distinct(_lines("__text"))).alias("__line")).where("__line rlike '\\\\S'")
    counts = lines.select("__host", *_line_key("__host", F.col("__line"))).groupBy("__host", "__l1", "__l2").agg(F.count("*").alias("__n")).where(F.col("__n") >= least_pages)
    totals = pages.groupBy("__host").agg(F.count("*").alias("__pages")).withColumnRenamed("__host", "__h")
    often = counts.join(totals, F.col("__host").eqNullSafe(F.col("__h"))).where(F.col("__n") > ratio * F.col("__pages"))
    return written(often.select("__l1", "__l2"), "boilerplate")


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """pages, all their columns and rows, with text_col less its host's boilerplate lines, and, where ``counts`` names them, lines and dropped lines.

    Lines are parts between line feeds, compared as they are; blank ones are always kept. A null host is a host of its own, a
    null text stays null (0 lines), a page whose lines all go has an empty text. Each repeated row is a page. A table of
    no rows gives one of no rows. Column names may be of any kind, but counts must be new ones. The last join is a shuffle at every size,
    for the dropped places grow with the pages.
    """
    if counts and (clash := {c.lower() for c in counts} & {c.lower() for c in pages.columns}):
        raise ValueError(f"pages already have {sorted(clash)}")
    own = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("__row"), F.col(f"`{host_col}`").cast("string").alias("__host"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    keyed = own.select("__row", "__host", "__text", *row_key(F.col("__host"), F.col("__text")))
    places = keyed.select("__host", "__k1", "__k2", F.posexplode(_lines("__text")).alias("__at", "__line")).select("__k1", "__k2", "__at", *_line_key("__host", F.col("__line")))
    with scratch():
        often = boilerplate(own.select("__host", "__text"), ratio, least_pages)
        drops = written(places.join(often, ["__l1", "__l2"], "left_semi").groupBy("__k1", "__k2").agg(F.array_sort(F.collect_set("__at")).alias("__drop")), "drops", keep=True)
    joined = keyed.join(drops.hint("merge"), ["__k1", "__k2"], "left")
    # a flag for each line up to the last that goes, laid beside the lines: one pass, however many go
    gap = lambda at, i: at - F.coalesce(F.get("__drop", i - 1), F.lit(-1)) - 1
    flags = F.flatten(F.transform("__drop", lambda at, i: F.concat(F.array_repeat(F.lit(False), gap(at, i)), F.array(F.lit(True)))))
    left = F.filter(F.zip_with(_lines("__text"), flags, lambda x, gone: F.when(gone, F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    kept = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(F.array_join(left, "\n"))
    out = [kept.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in pages.columns]
    if counts:
        out.append(F.when(F.col("__text").isNull(), 0).otherwise(F.size(_lines("__text"))).cast("bigint").alias(counts[0]))
        out.append(F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("bigint").alias(counts[1]))
    return joined.select(*out)
