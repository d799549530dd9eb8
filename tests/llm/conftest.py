import pytest

IDS = [5, 1, 9, 7, 7, None, 3, 2, 4]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, extra columns with clashing names."""
    long = " ".join(f"wörd{i % 997} thing{i % 31}," for i in range(4000)) + "\nlast line here"
    texts = [None, "", long, "same text here\nfoo bar", "same text here\nfoo bar", "no id", "  \n\n ", "don't you'll\nstop", long + " x"]
    sources = ["a", None, "a", "b", "b", "b", None, "a", "a"]
    clash = ("fp", "h", "__k1", "__k2", "__n", "__n_lines", "__n_dropped", "__row", "__id", "__text", "__payload", "__host", "__cut", "__score", "__kept", "__drop", "c0", "a", "b.c", "stays")
    rows = [(i, t, None, s, None, *(f"{k}{at}" for k in range(len(clash)))) for at, (i, t, s) in enumerate(zip(IDS, texts, sources))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in clash))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
