"""Documents' files as a data source of Spark (S11, S12): read and parsed by the tasks, a partition a run of files."""

from __future__ import annotations

import importlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kgloom.sources.io import _opened

FORMAT = "kgloom_pages"
#: Bytes of files in a partition, about; a larger file is one of its own.
PARTITION_BYTES = 64 << 20
#: Files in a partition at most.
PARTITION_FILES = 4096


@dataclass
class Files(InputPartition):
    paths: list[str]


class PageFiles(DataSource):
    """``spark.read.format("kgloom_pages").option(...).load(folder)``: a row for each file, or for each page.

    Rows are doc_id (the file's stem), path, text, error; with the option ``rows`` = "pages" doc_id, path, page_no (from 0), text, error. A document's text is its
    pages, each followed by two line feeds. A file that cannot be read or parsed has a null text (page_no 0) and its error, and the rest go on.

    Options: ``parser``, "module:name" of what makes a parser (as :class:`kgloom.sources.parsing.PageParser`) in each worker; ``suffix``, of the files to be read
    (".pdf" if not given, case ignored); ``done``, a folder: files whose ``<stem>.md`` is there are skipped, as each partition finds when it is
    read, so a repeated run goes on where one broke off; ``bytes``, of files in a partition. A folder that is missing or has no such file raises. Empty
    files are given to the parser as they are. Subfolders are not read.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        page = "page_no int, " if self._pages() else ""
        return f"doc_id string, path string, {page}text string, error string"

    def _pages(self) -> bool:
        kind = self.options.get("rows", "documents")
        if kind not in ("documents", "pages"):
            raise ValueError(f"rows must be documents or pages, not {kind}")
        return kind == "pages"

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("load needs a folder")
        return _Reader(dict(self.options), self._pages())


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], pages: bool) -> None:
        self.folder, self.done, self.pages = options["path"], options.get("done"), pages
        self.suffix = options.get("suffix", ".pdf").lower()
        self.parser = options.get("parser", "kgloom.sources.parsing:HtmlPages")
        self.most = int(options.get("bytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        """Names and sizes only, in the order of names; nothing is opened here."""
        store, root = _opened(self.folder)
        found = sorted((i.path, i.size or 0) for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.path.lower().endswith(self.suffix))
        if not found:
            raise FileNotFoundError(f"{self.folder} has no files that end in {self.suffix}")
        out, held = [Files([])], 0
        for path, size in found:
            if out[-1].paths and (held + size > self.most or len(out[-1].paths) == PARTITION_FILES):
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out

    def _left(self, paths: list[str]) -> list[str]:
        if not self.done:
            return paths
        store, root = _opened(self.done)
        there = store.get_file_info([f"{root}/{_stem(p)}.md" for p in paths])
        return [p for p, i in zip(paths, there) if i.type == fs.FileType.NotFound]

    def read(self, partition: Files) -> Iterator[tuple]:
        paths = self._left(partition.paths)
        if not paths:
            return
        store, _ = _opened(self.folder)
        module, name = self.parser.split(":")
        parse = getattr(importlib.import_module(module), name)()
        for path in paths:
            try:
                with store.open_input_stream(path) as file:
                    pages = parse(file.read())
                texts, error = (pages if self.pages else ["".join(p + "\n\n" for p in pages)]), None
            except Exception as e:  # one file must not fail the rest
                texts, error = [None], f"{type(e).__name__}: {e}"
            for k, text in enumerate(texts):
                yield (_stem(path), path, k, text, error) if self.pages else (_stem(path), path, text, error)


def _stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(PageFiles)
