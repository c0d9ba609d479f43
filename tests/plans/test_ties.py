"""Candidates at equal distances are taken in the order of their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.plans import registry

LARGEST = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["stmatch_viterbi"])
def test_equal_distances(spark, tmp_path, name):
    """Trajectories with points as far from one street as from another, up to rounding."""
    spark.read.parquet(f"{LARGEST}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{LARGEST}/events.parquet").filter(F.col("user_id").isin(16, 158, 822)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("supplier", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select(*names).collect()) == sorted(found.fetchall())
