"""Text cleaning (P1 to P18) as native column expressions; only HTML tables need Python."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kgloom.functions.rx import pieces, rx, strip, sub, sub_all, sub_held, where_any

# What counts as author, publishing, thesis and page matter.
AUTHOR = [
    (r"^作者[：:].+$", "m"),
    (r"^通讯作者[：:].+$", "m"),
    (r"^联系人[：:].+$", "m"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ""),
]
SECTION_STARTS = (r"#+\s*关于学位论文使用授权的说明", r"#+\s*声\s*明", r"#+\s*个人简历", r"#+\s*指导教师评语", r"#+\s*答辩委员会决议书", r"\*\*声\s*明\*\*", r"\*\*个人简历.*\*\*", r"\*\*指导教师评语\*\*", r"\*\*答辩委员会决议书\*\*")
SECTION_WORDS = ("关于学位论文", "声", "个人简历", "指导教师评语", "答辩委员会")
SECTION_ENDS = (r"#\s+第\s*[一-龥\d]+\s*[章节]", r"#\s+摘\s*要", r"#\s+(?i:Abstract)", r"#\s+第\s*1\s*章")
_LABELS = (("出版发行", "地址邮编", r"经\s*售", r"印\s*刷", r"开\s*本", r"印\s*张", r"字\s*数", r"版\s*印\s*次", r"印\s*数", r"定\s*价", "国防书店", "发行邮购", "发行传真", "发行业务"), ("中图分类号", "文献标识码", "文章编号", "收稿日期", "网络出版时间", "网络出版地址", "基金项目", "退修日期", "录用日期"), ("培养单位", r"学\s*科", r"研\s*究\s*生", "指导教师"))
#: (pattern, flags, words): one of the words, in lower case where the pattern ignores case, is in whatever the pattern matches.
METADATA = [
    (r"\*\*DOI[：:]\*\*.+", "i", ("doi",)),
    (r"^DOI[：:].+$", "mi", ("doi",)),
    (r"ISBN\s+[\d\-]+", "i", ("isbn",)),
    *((rf"\*\*{label}\*\*[：:].+", "", ("行", "编", "售", "刷", "本", "张", "数", "次", "价", "书店", "购", "传真", "业务")) for label in _LABELS[0]),
    (r"\*\*责任编辑[：:]\*\*.+", "", ("责任编辑",)),
    (r"\*\*责任校对[：:]\*\*.+", "", ("责任校对",)),
    (r"定价[：:]\s*[\d\.]+\s*元", "", ("定价",)),
    (r"上架建议.+", "", ("上架建议",)),
    (r"Barcode.+", "", ("Barcode",)),
    (r"\|[^\n]*ISBN[^\n]*\|[^\n]*\n(\|[^\n]*\n)*", "i", ("isbn",)),
    (r"\|[^\n]*URL[^\n]*\|[^\n]*\n", "i", ("url",)),
    (r"\|[^\n]*无人机[^\n]*\|[^\n]*\n", "", ("无人机",)),
    (r"\|[^\n]*787118[^\n]*\|[^\n]*\n", "", ("787118",)),
    (r"#+\s*WILEY\s*\n", "i", ("wiley",)),
    (r"QR Code with.+", "i", ("qr code",)),
    (r"中国版本图书馆\s*CIP\s*数据核字.+", "i", ("中国版本图书馆",)),
    (r"#+\s*著作权合同登记", "", ("著作权合同登记",)),
    (r"图字[：:].+", "", ("图字",)),
    (r"<mark>.+?</mark>", "s", ("<mark>",)),
    (r"^引用格式[：:].+$", "m", ("引用格式",)),
    *((rf"\*\*{label}[：:]\*\*.+", "", _LABELS[1]) for label in _LABELS[1]),
    (r"\blogo\b", "i", ("logo",)),
    *((rf"\*\*?{label}\*\*?[：:].+", "", ("培养单位", "科", "生", "指导教师")) for label in _LABELS[2]),
]
METADATA_WORDS = ("doi", "isbn", "*", "定价", "上架建议", "barcode", "url", "无人机", "787118", "wiley", "qr code", "中国版本图书馆", "著作权合同登记", "图字", "<mark>", "引用格式", "logo")
KEYWORD_LABELS = [(r"^\*\*关键词[：:]\*\*\s*", "m"), (r"^关键词[：:]\s*", "m"), (r"^\*\*Keywords?[：:]\*\*\s*", "mi"), (r"^Keywords?[：:]\s*", "mi")]
PAGE_MARKERS = [
    (r"<page_footer>.*?</page_footer>", "s"),
    (r"<page_header>.*?</page_header>", "s"),
    (r"^第\s*\d+\s*页\s*$", "m"),
    (r"^Page\s+\d+\s*$", "mi"),
    (r"^\d+\s*/\s*\d+\s*$", "m"),
]
LINKS = [(r"https?://[^\s\)]+", ""), (r"doi[：:]?\s*10\.\d+/[^\s]+", "i")]
CAPTIONS = [(r"^图\s*\d+[：:].+$", "m"), (r"^表\s*\d+[：:].+$", "m"), (r"^Fig\.?\s*\d+[：:].+$", "mi"), (r"^Table\s+\d+[：:].+$", "mi")]
CITATIONS = [(r"(?<![a-zA-Z一-龥])\[[\d,\-\s]+\](?![a-zA-Z一-龥])", "")]
REFERENCES = (r"\n{level} 参\s*考\s*文\s*献\s*\n", r"\n{level} References?\s*\n")
SENTENCE_ENDS = "。！？；"


def author_info(text: Column) -> Column:
    """P6."""
    return where_any(text, ("作者", "联系人", "@"), lambda t: sub_all(t, AUTHOR))


def skipped_sections(text: Column) -> Column:
    """Drops sections from a start line up to the next resuming heading, which stays.

    The text is cut before every resuming heading; within a part, everything from its first start line on goes. No heading reaches over a line's end.
    """
    starts, ends = ("|".join(p.replace(r"\s", r"[\s&&[^\n]]") for p in own) for own in (SECTION_STARTS, SECTION_ENDS))

    def cut(t: Column) -> Column:
        parts = pieces(F.concat(F.lit("\n"), t), rf"(?=\n(?:{ends}))")
        kept = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, F.lit(rf"(?dU)\n(?:{starts})(?s:.*)"), F.lit(""))), "")
        return F.regexp_replace(kept, F.lit(r"\A\n"), F.lit(""))

    return where_any(text, SECTION_WORDS, cut)


def metadata(text: Column) -> Column:
    """P8."""
    return where_any(text, METADATA_WORDS, lambda t: sub_held(t, METADATA))


def thesis_metadata(text: Column) -> Column:
    """P7, then P8."""
    return metadata(skipped_sections(text))


def references(text: Column) -> Column:
    """P5: several headings of level 1: a book, left alone; one: cut there; else at the last of level 2, else of level 3.

    The last is the last English heading if there is one, else the last Chinese one.
    """
    return where_any(text, ("参", "reference"), _references)


def _references(text: Column) -> Column:
    def found(level: str) -> list[str]:
        return [rx(p.format(level=level), "i") for p in REFERENCES]

    def before_last(pattern: str) -> Column:
        last = F.element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), -1)
        return F.left(text, F.length(text) - F.length(F.element_at(F.split(text, pattern, -1), -1)) - F.length(last))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    zh1, en1 = found("#")
    out = F.when(count(zh1) + count(en1) > 1, text).when(count(zh1) == 1, before_last(zh1)).when(count(en1) == 1, before_last(en1))
    for level in ("##", "###"):
        zh, en = found(level)
        out = out.when(count(en) > 0, before_last(en)).when(count(zh) > 0, before_last(zh))
    return out.otherwise(text)


def keyword_labels(text: Column) -> Column:
    """P9, opt-in."""
    return sub_all(text, KEYWORD_LABELS)


def page_markers(text: Column) -> Column:
    """P10."""
    return where_any(text, ("<page_", "第", "page", "/"), lambda t: sub_all(t, PAGE_MARKERS))


def links(text: Column) -> Column:
    """P11."""
    return where_any(text, ("http", "doi"), lambda t: sub_all(t, LINKS))


def captions(text: Column) -> Column:
    """P12, opt-in."""
    return sub_all(text, CAPTIONS)


def citation_markers(text: Column) -> Column:
    """Numbers in square brackets go unless a letter or Han character stands beside them; so a superscript keeps its tags."""
    return where_any(text, ("[",), lambda t: sub(sub_all(t, CITATIONS), r"<sup>(\[[\d,\-\s]+\])</sup>", "$1"))


def image_references(text: Column) -> Column:
    """An image is its alternative text, or nothing if that is short or generic."""
    generic = r"!\[(?:[^\]]{0,3}|(?i:图片|image|img|pic))\]\([^\)]+\)"
    return where_any(text, ("![",), lambda t: sub(sub(t, generic), r"!\[([^\]]*)\]\([^\)]+\)", "$1"))


def whitespace(text: Column) -> Column:
    """Lines stripped, rules dropped, runs of blank lines made one."""
    blank = r"[\s\x1c-\x1f&&[^\n]]+"
    lines = sub(text, rf"^{blank}|{blank}$", "", "m")
    kept = F.regexp_replace(sub(F.concat(F.lit("\n"), lines), r"\n[-*_]{3,}(?=\n|\z)"), F.lit(r"\A\n"), F.lit(""))
    for pattern, to in ((r"\A\n+\z", ""), (r"\n{3,}", "\n\n"), (r"\A\n{2,}", "\n"), (r"\n{2,}\z", "\n")):
        kept = sub(kept, pattern, to)
    return kept


class _Tables(HTMLParser):
    """Rows of the first table: (in head, in body, cells), with cell text stripped piece by piece."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, list[str], bool]] = []
        self.part, self.cell, self.has_head, self.has_body, self.depth = "", None, False, False, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif tag in ("thead", "tbody"):
            self.part = tag
            self.has_head |= tag == "thead"
            self.has_body |= tag == "tbody"
        elif tag == "tr":
            self.rows.append((self.part, [], False))
            self.cell = None
        elif tag in ("td", "th") and self.rows:
            self.cell = []
            self.rows[-1][1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("thead", "tbody"):
            self.part = ""
        elif tag in ("td", "th", "tr"):
            self.cell = None
        elif tag == "table":
            self.depth -= 1

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())


def table_to_markdown(html: str) -> str:
    """A header row and a rule for the head's first row, then the rows of the body, or, without one, all rows not in the head."""
    parser = _Tables()
    try:
        parser.feed(html)
        parser.close()
    except Exception:  # what cannot be parsed stays as it is
        return html
    if not re.match(r"<table[\s>/]", html):
        return html
    line = lambda cells: "| " + " | ".join("".join(c) for c in cells) + " |"
    head = [cells for part, cells, _ in parser.rows if part == "thead"]
    out = [line(head[0]), "| " + " | ".join(["---"] * len(head[0])) + " |"] if head and head[0] else []
    wanted = "tbody" if parser.has_body else ""
    return "\n".join(out + [line(cells) for part, cells, _ in parser.rows if cells and part == wanted])


def rewrite_tables(text: str | None) -> str | None:
    """Tables become Markdown in one pass; the opening of a table that never ends is deleted."""
    if text is None or "<table" not in text:
        return text
    out, at = [], 0
    while (start := text.find("<table", at)) >= 0:
        end = text.find("</table>", start)
        if end < 0:
            return "".join(out) + text[at:].replace("<table", "")
        end += len("</table>")
        out += [text[at:start], table_to_markdown(text[start:end])]
        at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _rewrite_tables(texts: pd.Series) -> pd.Series:
    return texts.map(rewrite_tables)


def tables(text: Column) -> Column:
    """P1 and P2."""
    return _rewrite_tables(text)


def before_tables(text: Column) -> Column:
    """P15 up to the tables: its steps depend on each other in this order."""
    return citation_markers(links(page_markers(author_info(references(thesis_metadata(text))))))


def after_tables(text: Column, with_images: bool = True) -> Column:
    return whitespace(thesis_metadata(image_references(text) if with_images else text))


def clean(text: Column, with_tables: bool = True, with_images: bool = True) -> Column:
    """The whole cleaning. :func:`kgloom.plans.pipelines.cleaned` does the same and sends only texts with tables to Python."""
    out = before_tables(text)
    return after_tables(tables(out) if with_tables else out, with_images)


def reduction(before: Column, after: Column) -> Column:
    """Percent saved; null where there was nothing."""
    return (1 - F.try_divide(after, before)) * 100


def safe_title(title: Column) -> Column:
    """P17."""
    return F.replace(strip(F.substring(sub(title, r"[^\w\s-]"), 1, 50)), F.lit(" "), F.lit("_"))


def entity_name(name: Column) -> Column:
    """P18."""
    return F.lower(strip(name))


def relation_label(relation: Column) -> Column:
    """P20."""
    return F.replace(F.replace(relation, F.lit("`"), F.lit("")), F.lit(" "), F.lit("_"))


def without_echo(text: Column, prompt: Column) -> Column:
    """P23."""
    return F.when(F.startswith(text, prompt), F.substring(text, F.length(prompt) + 1, F.length(text))).otherwise(text)


def sentences(text: Column) -> Column:
    """Parts between sentence ends and line feeds, stripped, longer than 5."""
    return F.filter(F.transform(pieces(text, f"[{SENTENCE_ENDS}\\n]+"), strip), lambda s: F.length(s) > 5)
