"""The registered text queries and the pipeline on the smallest tables."""

from pathlib import Path

import pytest

from flowsieve.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", ["op3_chat_formatting", "op11_fill_in_middle", "op13_quality_rules"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cur = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = Q.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


def test_vector_codes_of_the_table(spark):
    """The query on the whole table against plain loops in numpy."""
    import hashlib

    import numpy as np

    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    v = np.floor(np.array([r["embedding"] for r in rows], dtype=np.float64) * 1024).astype(np.int64).reshape(len(rows), 4, -1)
    books = v[:256].transpose(1, 0, 2).copy()
    codes = lambda: np.stack([((v[:, p, None] - books[p]) ** 2).sum(axis=2) for p in range(4)], axis=1)
    for _ in range(4):
        nearest = codes().argmin(axis=2)
        for p in range(4):
            for e in np.unique(nearest[:, p]):
                own = v[nearest[:, p] == e, p]
                books[p][e] = own.sum(axis=0) // len(own)
    far = codes()
    error = far.min(axis=2).sum(axis=1)
    totals = {}
    for r, e in zip(rows, error):
        totals[r["label"]] = totals.get(r["label"], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()
    want = {r["vec_id"]: ("".join(f"{x:02x}" for x in far[k].argmin(axis=1)), int(error[k]), totals[r["label"]], digest) for k, r in enumerate(rows)}
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in Q.op12_vector_codes(spark, SF).collect()} == want


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, k
    whole = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.5 * whole < docs.count() <= whole
    assert P.run(spark, SF).select("doc_id").distinct().count() == docs.count()


def test_stored_tables_are_removed_on_request(spark):
    from urllib.parse import urlparse

    from flowsieve.llm import common

    common.remove_stored(spark)
    df = spark.range(5)
    one, two = common.stored(df, "one"), common.stored_in_buckets(df, "id", 2, "two")
    path = Path(urlparse(common._FOLDERS[-1]).path)
    assert one.count() == two.count() == 5 and path.exists()
    assert common.remove_stored(spark) == 2 and not path.exists() and not spark.catalog.listTables(pattern="two_*")
