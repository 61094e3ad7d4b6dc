"""Every catalogue query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from palimpsest import catalog_code as catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DIR)
    want = con.sql(catalog.SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(value(r[c]) for c in cols)) for r in df.collect()) == sorted(repr(tuple(value(r[i]) for i in at)) for r in want.fetchall())


def test_rank_buckets_reach_rank_100(spark, tmp_path):
    asked = [" ".join(f"t{i}{c}" for c in "abcd") for i in range(4)]
    texts = [f"filler{i} and more words" for i in range(150)]
    for item, better in zip(asked, (0, 15, 50, 120), strict=True):
        texts += [" ".join(item.split()[::-1] * 2)] * better + [f"{item} and ten more words that only make this text longer"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.bucket: r.n for r in catalog.QUERIES["rank_buckets"](spark, str(tmp_path)).collect()}
    assert got == {"rank_1": 1, "rank_2_3": 0, "rank_4_10": 0, "rank_11_20": 1, "rank_21_100": 1, "not_in_top_100": 1}
