"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from flowsieve.plans import queries as P

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(P.ORACLES))
def test_against_sql(spark, con, name):
    df = P.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([normal(r[c]) for c in columns]) for r in df.collect())
    spark.catalog.clearCache()
    cur = con.execute(P.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(str([normal(v) for _, v in sorted(zip(names, r, strict=True))]) for r in cur.fetchall())
    assert sorted(names) == columns
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(P.ORACLES) <= set(P.QUERIES)


def test_streaming_cap(spark):
    got = {r["event_type"]: r["n"] for r in P.st1(spark, SF).collect()}
    whole = {r["event_type"]: r["count"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").count().collect()}
    assert got == {k: min(100, n) for k, n in whole.items()}


def test_streaming_cap_holds_over_a_restart(spark, tmp_path):
    """A family with nine tenths of the rows, files that come in one by one, and a query that stops and starts again."""
    from pyspark.sql import functions as F

    from flowsieve.streaming.caps import stream_family_cap

    root = f"file://{tmp_path}"
    rows = lambda k: spark.range(k * 1000, k * 1000 + 1000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 100 == 0, None).otherwise(F.concat(F.lit("f"), (F.col("id") % 70).cast("string"))).alias("family"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            rows(k).coalesce(2).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema("event_id long, family string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
            done = stream_family_cap(stream, "family", 1200, salts=4).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
            done.awaitTermination()
            seen = spark.read.parquet(f"{root}/in").groupBy("family").count().collect()
            got = {r["family"]: r["count"] for r in spark.read.parquet(f"{root}/out").groupBy("family").count().collect()}
            assert got == {r["family"]: min(1200, r["count"]) for r in seen}
        whole = spark.read.parquet(f"{root}/out")
        assert whole.distinct().count() == whole.count()
    finally:
        spark.conf.set(provider, before)
