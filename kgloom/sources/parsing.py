"""Documents from pages by a pluggable parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.sources.io import without_done


class PageParser(Protocol):
    """Pages of a document's bytes or text, as Markdown; made once in each Python worker."""

    def __call__(self, content: bytes | str) -> list[str]: ...


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in ("h1", "h2", "h3"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "article", "li", "br", "tr"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


class HtmlPages:
    """The parser that needs no service: the text of an HTML page as one page."""

    def __call__(self, content: bytes | str) -> list[str]:
        parser = _Text()
        parser.feed(content.decode("utf-8", "replace") if isinstance(content, bytes) else content)
        parser.close()
        return ["".join(parser.out).strip()]


class PlainPages:
    """UTF-8 text whose pages end at form feeds, as tools that take text out of PDF files write it; what is no UTF-8 raises."""

    def __call__(self, content: bytes | str) -> list[str]:
        return (content.decode("utf-8") if isinstance(content, bytes) else content).split("\f")


def parse(sources: DataFrame, parser: Callable[[], PageParser], done: DataFrame | None = None, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """doc_id, text, error: pages joined, two line feeds after each. What done has is skipped; what fails has a null text and its error."""
    rows = without_done(sources, done, id_col) if done is not None else sources
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = parser()
        for f in frames:
            texts, errors = [], []
            for c in f["__content"]:
                try:
                    texts.append("".join(p + "\n\n" for p in own(c)))
                    errors.append(None)
                except Exception as e:  # one document must not fail the rest
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"__id": f["__id"], "text": texts, "error": errors})

    return rows.select(F.col(id_col).alias("__id"), F.col(content).alias("__content")).mapInPandas(run, f"__id {kind}, text string, error string").withColumnRenamed("__id", id_col)


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text of (doc_id, page_no, text), each page followed by two line feeds."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n"), F.lit("\n\n")).alias("text"))
