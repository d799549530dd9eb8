import duckdb
import pytest

import __spark_entry__ as entry
from kgloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["relation", "n"]


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(Q.SQL) <= set(Q.QUERIES)


def shown(v):
    return None if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", ["triple_dedup_first_wins", "mutex_resolution", "composite_score", "entity_clusters", "connectivity_bins", "sentence_split", "end_to_end_mutex", "postprocess_composite", "normalize_composite", "references_cut", "json_extract", "advice", "page_source", "consistency_checks"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = con.execute(Q.SQL[name]).df()
    key = lambda row: tuple(str(v) for v in row)
    a = sorted((tuple(shown(v) for v in r) for r in got.select(*sorted(got.columns)).collect()), key=key)
    b = sorted((tuple(shown(v) for v in r) for r in want[sorted(want.columns)].astype(object).itertuples(index=False)), key=key)
    assert a == b
