import hashlib
import random
import re

import pytest

from kgloom.llm import infilling


def expected(doc_id, text, seed=7, rate=100, first=50):
    """n, form, prefix, middle, output, by the statement of the task."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < first:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    parts = ["\n", "a", "é", "😀", "<", ">", "P", "S", "M", "<P", "S>", "\r\n", "\x00", " ", " ", "word"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(800)]
    return out + ["x<P>y", "<M>", "a\n<S>\n", "\n" * 50, "x" * 300_000 + "\n" + "y" * 300_000, None, ""]


@pytest.mark.parametrize("rate, first", [(100, 50), (60, 20), (0, 50), (100, 100)])
def test_like_the_statement_and_restored(spark, texts, rate, first):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    own = infilling.transformed(docs, rate=rate, suffix_first=first)
    got = {r.doc_id: tuple(r)[1:] for r in own.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infilling.restored(own["output"], own["form"])).collect()}
    assert got == {i: (*expected(i, t, rate=rate, first=first), t or "") for i, t in enumerate(texts)}


def test_digests(spark, odd, none):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in odd.collect():
        n, form, a, b, output = expected(r.doc_id, r.text)
        want.append((r.doc_id, n, form, a, b, sha(output), sha(r.text or "")))
    assert sorted(map(str, infilling.digests(odd).collect())) == sorted(str(r) for r in infilling.digests(odd).sparkSession.createDataFrame(want, infilling.digests(odd).schema).collect())
    assert infilling.digests(none).count() == 0


def test_rows_keep_their_columns(odd):
    got = infilling.transformed(odd)
    assert got.columns == [*odd.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(str, got.select(*(f"`{c}`" for c in odd.columns)).collect())) == sorted(map(str, odd.collect()))
    with pytest.raises(ValueError):
        infilling.transformed(odd.withColumnRenamed("source", "FORM"))


def test_no_python_and_no_exchange(odd):
    plan = infilling.digests(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
