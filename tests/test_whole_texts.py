"""Queries over whole texts, against loops with Python's own regular expressions over a fixture and the smallest tables."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest

from kgloom.functions import text as X
from kgloom.operators import segment
from kgloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
FLAGS = {"": 0, "m": re.M, "i": re.I, "mi": re.M | re.I, "s": re.S}
LONG = "word [3] ![kept alt](u) <sup>[9]</sup>\n3 / 4\nPage 12\n# 标题\ntext " * 40 + "end"
md5 = lambda t: hashlib.md5(t.encode()).hexdigest()


def deleted(table, t):
    for pattern, flags in table:
        t = re.sub(pattern, "", t, flags=FLAGS[flags])
    return t


def images(t):
    t = re.sub(r"!\[(?:[^\]]{0,3}|(?i:图片|image|img|pic))\]\([^\)]+\)", "", t)
    return re.sub(r"!\[([^\]]*)\]\([^\)]+\)", r"\1", t)


def sections(t):
    out, skip = [], False
    for line in t.split("\n"):
        if skip and any(re.match(p, line) for p in X.SECTION_ENDS):
            skip = False
        elif not skip and any(re.match(p, line) for p in X.SECTION_STARTS):
            skip = True
        out += [] if skip else [line]
    return "\n".join(out)


def chapters(t):
    out = []
    for line in t.split("\n"):
        if re.fullmatch(segment.HEADING.replace(segment._B, r"[^\S\n]*").replace(r"[\s&&[^\n]]", r"[^\S\n]"), line, re.I):
            out.append([line.strip()])
        elif out:
            out[-1].append(line)
    return [(k, c[0], md5("\n".join(c[1:]))) for k, c in enumerate(out, 1)]


@pytest.fixture(scope="module", params=["fixture", "tables"])
def folder(request, spark, tmp_path_factory):
    if request.param == "tables":
        return SF
    path = str(tmp_path_factory.mktemp("whole"))
    table = "<p>x</p><table><thead><tr><th>a</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table>y"
    spark.createDataFrame([(1, LONG), (2, ""), (3, "short\n\n声明"), (4, 'a "quoted" \\ {b}\ttext')], "doc_id bigint, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, table * 30), (2, "no table")], "page_id bigint, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def test_whole_texts_like_loops(spark, folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = {k: v or "" for k, v in zip(t["doc_id"], t["text"])}
    plain = lambda t: t.replace("#", " ").replace("*", " ")
    cases = {
        "image_references": (images, Q.IMAGES, str),
        "page_markers": (lambda t: deleted(X.PAGE_MARKERS, t), Q.PAGES, str),
        "citation_strip": (lambda t: re.sub(r"<sup>(\[[\d,\-\s]+\])</sup>", r"\1", deleted(X.CITATIONS, t)), [Q.CITED], str),
        "keyword_labels": (lambda t: deleted(X.KEYWORD_LABELS, t), Q.KEYWORDS, str),
        "captions": (lambda t: deleted(X.CAPTIONS, t), Q.CAPTIONS, str),
        "section_skip": (sections, Q.SECTIONS, plain),
    }
    around = lambda t, markers: t + "".join(m + t for m in markers)
    for name, (model, markers, own) in cases.items():
        got = {r.doc_id: r.digest for r in Q.QUERIES[name](spark, folder).collect()}
        assert got == {k: md5(model(around(own(v), markers))) for k, v in docs.items()}, name
    got = {}
    for r in sorted(Q.QUERIES["chapter_split"](spark, folder).collect(), key=lambda r: (r.doc_id, r.chapter_no)):
        got.setdefault(r.doc_id, []).append((r.chapter_no, r.title, r.digest))
    assert got == {k: chapters(around(plain(v), Q.CHAPTERS)) for k, v in docs.items()}
    t = pq.read_table(f"{folder}/pages.parquet", columns=["page_id", "html"]).to_pydict()
    got = {r.page_id: r.digest for r in Q.QUERIES["html_pages"](spark, folder).collect()}
    tables = lambda h: re.sub(r"<table.*?(</table>|\Z)", lambda m: X.table_to_markdown(m[0]) if m[1] else m[0].replace("<table", ""), h, flags=re.S)
    assert got == {k: md5(tables(h)) for k, h in zip(t["page_id"], t["html"])}
