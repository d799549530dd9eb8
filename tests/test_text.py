import random
import re

import pytest
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.operators import segment
from kgloom.plans import pipelines


def one(spark, f, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", f(F.col("text")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def lines_model(text):
    """Whitespace clean-up as a loop over lines."""
    out, blank = [], False
    for line in (x.strip() for x in text.split("\n")):
        if re.match(r"^[-*_]{3,}$", line):
            continue
        if line or not blank:
            out.append(line)
        blank = not line
    return "\n".join(out)


def test_whitespace_like_a_loop(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", " ", "\n", "---", "***", "　", "\t", "\r"]) for _ in range(rnd.randint(0, 14))) for _ in range(600)]
    assert one(spark, X.whitespace, *texts) == [lines_model(t) for t in texts]


def skip_model(text):
    starts, ends = [re.compile(p) for p in X.SECTION_STARTS], [re.compile(p) for p in X.SECTION_ENDS]
    out, skip = [], False
    for line in text.split("\n"):
        if skip and any(p.match(line) for p in ends):
            skip = False
        elif not skip and any(p.match(line) for p in starts):
            skip = True
        if not skip:
            out.append(line)
    return "\n".join(out)


def test_sections_like_a_loop(spark):
    rnd = random.Random(6)
    parts = ["#", "# ", "##\t", "# 第", "# 声 明", "**声明**", "## 个人简历", "# 摘 要", "# abstract", "# 第2章 x", "# 第 1 章", "text", "", "**个人简历x**", "# 标题", "声明"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(500)]
    assert one(spark, X.skipped_sections, *texts) == [skip_model(t) for t in texts]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("a\n# 参考文献\nx", "a"),
        ("a\n# References\nx\n# 参考文献\ny", "a\n# References\nx\n# 参考文献\ny"),  # a book
        ("a\n## References\nx\n## 参考文献\ny", "a"),  # the last in the list is the English one
        ("a\n## 参考文献\nx\n## 参 考 文 献 \ny", "a\n## 参考文献\nx"),
        ("a\n### reference\nx", "a"),
        ("no heading", "no heading"),
        ("", ""),
    ],
)
def test_references(spark, before, after):
    assert one(spark, X.references, before) == [after]


def test_patterns(spark):
    assert one(spark, X.citation_markers, "x<sup>[2]</sup>", "见[1-3]", "a [1, 2].", "[3]b") == ["x<sup></sup>", "见[1-3]", "a .", "[3]b"]
    assert one(spark, X.image_references, "![](u)![abc](u)![IMAGE](u)![fig 1](u)", "![图片](x)![图片说明](y)") == ["fig 1", "图片说明"]
    assert one(spark, X.links, "a https://x.y/z) b", "DOI：10.1/ab c") == ["a ) b", " c"]
    assert one(spark, X.page_markers, "a\n第 3 页\nb\nPAGE 4\n5 / 6\n<page_footer>x\ny</page_footer>") == ["a\n\nb\n\n"]
    assert one(spark, X.author_info, "作者：甲\nx@y.com z") == ["\n z"]
    assert one(spark, X.metadata, "**DOI：** 10\nISBN 978-7 x\n| ISBN | 1 |\n| a |\nlogo y\n**学 科**：z\n<mark>a\nb</mark>c") == ["\n x\n y\n\nc"]
    assert one(spark, X.keyword_labels, "关键词：a\nKeywords: b") == ["a\nb"]
    assert one(spark, X.captions, "图 1：x\nTable 2: y\nz") == ["\n\nz"]
    assert one(spark, X.safe_title, "第1章 a/b　c!") == ["第1章_ab　c"]
    assert one(spark, X.sentences, "短。这是一个长句子！ok\nlonger one") == [["这是一个长句子", "longer one"]]
    assert one(spark, lambda c: X.without_echo(c, F.lit("ab")), "abc", "xab") == ["c", "xab"]
    assert one(spark, X.entity_name, "　 Ab\t") == ["ab"]


def test_tables():
    head = "<table><thead><tr><th>a</th><th> b </th></tr></thead>"
    assert X.rewrite_tables(head + "<tbody><tr><td>1</td><td>2</td></tr></tbody></table>!") == "| a | b |\n| --- | --- |\n| 1 | 2 |!"
    assert X.rewrite_tables("x<table><tr><td>1<b> 2</b></td></tr></table>") == "x| 12 |"
    assert X.rewrite_tables("a<table border=1>b") == "a border=1>b"
    assert X.rewrite_tables("<tablefoo></table>") == "<tablefoo></table>"  # no table: unchanged, and no endless loop
    assert X.rewrite_tables(None) is None


def chunk_model(text, most):
    out, cur = [], ""
    for s in (x.strip() for x in re.split(r"(?<=[。！？；])", text)):
        if not s:
            continue
        if len(s) > most:
            if cur:
                out.append(cur.strip())
            cur = ""
            out += [s[i : i + most].strip() for i in range(0, len(s), most)]
        elif len(cur) + len(s) <= most:
            cur += s
        else:
            if cur:
                out.append(cur.strip())
            cur = s
    return out + ([cur.strip()] if cur.strip() else [])


def test_chunks_like_a_loop(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab 。！；\n　") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    got = one(spark, lambda c: segment.chunk_array(c, 9), *texts)
    assert got == [chunk_model(t, 9) for t in texts]
    assert all(len(c) <= 9 for x in got for c in x)


def test_chapters(spark):
    docs = spark.createDataFrame([(1, "pre\n# 第1章 x\na\nb\n## Chapter 2\n### 3. z\nc"), (2, "none\nhere"), (3, "")], "doc_id int, text string")
    rows = sorted(map(tuple, segment.chapters(docs).collect()))
    assert rows == [(1, 1, "# 第1章 x", "a\nb"), (1, 2, "## Chapter 2", ""), (1, 3, "### 3. z", "c"), (2, 1, "全文", "none\nhere"), (3, 1, "全文", "")]
    kept = segment.chapters(docs, keep_preamble=True).where("doc_id = 1").orderBy("chapter_no").collect()
    assert [r.title for r in kept][:2] == ["全文", "# 第1章 x"]
    files = segment.chapter_files(segment.chapters(docs)).where("doc_id = 1 and chapter_no = 1").first()
    assert files.file == "1_chapter01_第1章_x.md" and files.text == "# # 第1章 x\n\na\nb"


def test_words_stand_for_patterns(spark):
    """What a group of patterns changes holds one of its words, so texts without them need not be looked at: cases of letters included."""
    texts = ["ıſbn 123-4", "Iſbn 12", "ISBN 5", "doı: 10", "DOİ: 1", "^DOI：x", "LOGO", "x@y.COM", "第 3 页", "12 / 13", "HTTP://x", "plain", "", None]
    for words, table, f in ((X.METADATA_WORDS, X.METADATA, X.metadata), (("作者", "联系人", "@"), X.AUTHOR, X.author_info), (("http", "doi"), X.LINKS, X.links)):
        assert one(spark, f, *texts) == one(spark, lambda c, t=table: X.sub_all(c, t), *texts), words


def test_patterns_by_their_words(spark):
    """A pattern is tried only on texts with one of its words; deletions may put such a word together, and the rest of the texts hold every kind of line."""
    lines = ["**DOI：**10.1/x", "doi: 10.2", "ISBN 978-7", "**经 售**：书店", "**印  次数**：1", "**版 印 次**：3", "**责任编辑：**甲", "**责任校对:**乙", "定价： 3.5 元", "上架建议：科技", "Barcode 1", "barcode 2", "| isbn 1 | x |\n| y |\n| z |\nrest"]
    lines += ["| a | url x |\n", "| 无人机 | b |\n", "| 787118 | c |\n", "## Wiley \n", "qr CODE with x", "中国版本图书馆 CIP 数据核字 (1)", "## 著作权合同登记", "图字：01", "<mark>a\nb</mark>", "引用格式：x", "**收稿日期：**1", "**基金项目:** y", "a LOGO b"]
    lines += ["*学 科*：z", "**研 究 生**: w", "**指导教师**：v", "*培养单位**：u", "lo<mark>x</mark>go", "IS上架建议\nBN 3", "**字 数**：9", "**国防书店**:8"]
    texts = [*lines, "\n".join(lines), "plain", "", None]
    whole = one(spark, lambda c: X.sub_all(c, X.METADATA), *texts)
    assert one(spark, lambda c: X.sub_held(c, X.METADATA), *texts) == whole == one(spark, X.metadata, *texts)


def test_only_texts_with_tables_go_to_python(spark):
    texts = ["a<table><tr><td>v</td></tr></table>", "<table never", "none", "", None, "<ta[3]ble><tr><td>w</td></tr></table>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for with_tables, with_images in ((True, True), (False, False)):
        got = [r.text for r in pipelines.cleaned(docs, with_tables, with_images).orderBy("doc_id").collect()]
        assert got == one(spark, lambda c, a=with_tables, b=with_images: X.clean(c, a, b), *texts)


def test_clean_composite(spark):
    text = "# 标题\n作者：甲\n\n\n见[1] <table><tr><td>v</td></tr></table>\n---\nend\n# 参考文献\nx"
    assert one(spark, X.clean, text) == ["# 标题\n\n见[1] | v |\nend"]


def test_chunks_of_a_batch_part_by_part():
    """Parts change nothing, and Python holds a part of a batch, not all of it."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, "", "一。二。三"] + [f"{i}。" + "x y。" * 900 for i in range(3000)])
    want = [segment.packed(t, 150, "。！？；") for t in texts.to_pylist()]
    for most in (1, 5000, 1 << 30):
        assert segment.chunked(texts.slice(0, 60), 150, "。！？；", most).to_pylist() == want[:60]
    assert segment.chunked(texts.slice(0, 0), 150, "。！？；").to_pylist() == []
    del want
    tracemalloc.start()
    segment.chunked(texts, 150, "。！？；")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
