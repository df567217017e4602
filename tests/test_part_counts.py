import duckdb
import pytest

from loghaven import registry
from loghaven.operators import analytics


def test_parts_beyond_the_given_number_are_counted(spark):
    logs = spark.createDataFrame([(5,), (250_999,), (1_500_000,)], "block_number long")
    got = {r["part"]: r["n_logs"] for r in analytics.part_counts(logs, 200, 1000).collect()}
    assert len(got) == 1501 and sum(got.values()) == 3 and got["000"] == got["250"] == got["1500"] == 1


def test_fewer_parts_and_no_rows(spark):
    logs = spark.createDataFrame([(1_500,)], "block_number long")
    assert [r["n_logs"] for r in analytics.part_counts(logs, 3, 1000).orderBy("part").collect()] == [0, 1, 0]
    assert [r["n_logs"] for r in analytics.part_counts(logs.limit(0), 3, 1000).collect()] == [0, 0, 0]


def test_logs_below_part_0_and_without_a_block(spark):
    logs = spark.createDataFrame([(-2_500,), (-1,), (5,), (None,), (None,)], "block_number long")
    got = {r["part"]: r["n_logs"] for r in analytics.part_counts(logs, 3, 1000).collect()}
    assert got == {None: 2, "-02": 1, "000": 2, "001": 0, "002": 0}


@pytest.mark.parametrize("shifts", ["0, 250_000, 1_234_000", "-5_000, 0, NULL"])
def test_query_counts_its_whole_table(spark, tmp_path, shifts):
    """Parts beyond 200 and beyond 1000, below 0 and lines without a key: each line counts once, in SQL too."""
    with duckdb.connect() as con:
        source = f"SELECT t.* REPLACE (l_orderkey + shift AS l_orderkey) FROM '/root/testdata/sf0.001/lineitem.parquet' t, unnest([{shifts}]) s(shift)"
        con.sql(f"COPY ({source}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
        con.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
        for table in ("lineitem", "orders"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        plain = dict(con.sql("SELECT l_orderkey // 1000, count(*) FROM lineitem GROUP BY ALL").fetchall())
        want = con.sql(registry.oracle_sql()["part_row_counts"]).fetchall()
    got = [tuple(r) for r in registry.queries()["part_row_counts"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == set(want)
    assert len(got) == len(dict(got)) and {None if p is None else int(p): n for p, n in got if n} == plain
