"""Every graph query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from hopgrid.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    """Sorted rows with columns by name; numbers as floats, so that nulls beside integers compare."""

    def value(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        if isinstance(v, bool) or not hasattr(v, "__float__"):
            return str(v)
        return f"{round(float(v), 6):.6f}"

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)



def test_page_rank_sums_to_one(spark, sf_dir):
    r = QUERIES["page_rank_nations"](spark, sf_dir).toPandas()
    assert len(r) == 25 and abs(r["rank"].sum() - 1) < 1e-6


@pytest.mark.parametrize("name", ["merge_relationship", "merge_partial_rows", "merge_counters", "bulk_merge"])
def test_merge_where_moved_keys_exist(spark, tmp_path, name):
    c = duckdb.connect()
    c.execute("create table customer as select k::bigint c_custkey, 'c'||k c_name, 'SEG' c_mktsegment, 2.5::double c_acctbal from (values (0), (1), (6), (1000000), (1000006), (5000000), (5000006)) t(k)")
    c.execute("create table orders as select k::bigint o_orderkey, (k % 5000000 % 3)::bigint o_custkey, '1-URGENT' o_orderpriority from (values (0), (1), (5), (5000000), (5000001), (5000005)) t(k)")
    for t in ("customer", "orders"):
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)
