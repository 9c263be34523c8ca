"""Named queries against their SQL on small tables that the driver's sizes do not reach."""

import duckdb
import pytest
from pyspark.sql import functions as F

from footage_lake.plans import catalog_queries, edit_queries, line_queries, reader_queries, registry, source_queries  # noqa: F401 (they register queries)


@pytest.fixture
def same(spark, tmp_path):
    """Writes tables and compares a query's rows with its SQL's."""

    def of(name: str, **tables) -> int:
        for t, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        registry.QUERIES[name](spark, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/got")
        c = duckdb.connect()
        for t in tables:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        c.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
        c.execute(f"CREATE TABLE want AS {registry.ORACLE[name]}")
        columns = ", ".join(f'"{r[0]}"' for r in c.execute("DESCRIBE want").fetchall())
        for a, b in (("got", "want"), ("want", "got")):
            assert c.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []
        return c.execute("SELECT count(*) FROM got").fetchall()[0][0]

    return of


def _orders(spark, n: int, customers: int, price=None):
    k = F.col("id")
    return spark.range(n).select(
        k.alias("o_orderkey"), (k % customers * 16).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        (F.lit(1000.0) + k if price is None else price).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"),
    )


@pytest.mark.parametrize("name", ["timeline_entries", "final_table", "edl_lines", "edl_document"])
def test_timelines_of_over_99_hours(spark, same, name):
    assert same(name, orders=_orders(spark, 40_000, 3)) >= 40_000


@pytest.mark.parametrize("name", ["inventory_shots", "processed_shots"])
def test_over_999_shots_in_a_project(spark, same, name):
    assert same(name, pages=spark.range(8000).select(F.col("id").alias("page_id"))) > 4000


def test_qualities_halfway_between_two_places(spark, same):
    """Prices of 250 times odd numbers: 0.145 and the like, next to others that must not round to the same."""
    price = 250.0 * (2 * (F.col("id") % 1200) + 1)
    assert same("beat_report", orders=_orders(spark, 2400, 1, price)) == 1


def test_decision_files_of_many_partitions(spark, same):
    """Blocks come from as many partitions as the shuffle has, and none is lost."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert same("decision_files", orders=_orders(spark, 3000, 500)) == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
