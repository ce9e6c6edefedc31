"""Every registered redaction query against its SQL twin, and streams against batches."""

import glob
import os

import duckdb
import pytest

from lacquer.functions import policy as P
from lacquer.operators import groups
from lacquer.plans import oracle, queries
from lacquer.streaming import redacted_stream, stream_batch_items, write_stream

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, values):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(v[i] for i in by) for v in values], key=str)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sql, name):
    df = queries.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = sql.execute(oracle.oracle_sql()[name])
    assert got == rows([d[0] for d in want.description], want.fetchall())


def test_streams_equal_batches(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/customer.parquet")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    table.repartition(3).write.parquet(src)
    stream = redacted_stream(spark, src, table.schema, queries.CUSTOMER)
    write_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, queries.redact_columns_customer(spark, DATA).collect()))


def test_a_stream_keeps_the_budget(spark, tmp_path):
    policy = P.Policy(limits=P.Limits(max_output_bytes=10))
    items = [(1, i, "field", "f", "abcd") for i in range(5)]
    df = spark.createDataFrame(items, "b int, i int, op string, name string, value string")
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    for i in range(5):
        df.where(f"i = {i}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_batch_items(stream, "b", "i", policy)
    write_stream(q, out, str(tmp_path / "c")).awaitTermination()
    texts = [r.text for r in spark.read.parquet(out).collect()]
    batch = [r.text for r in groups.batch_items(df, "b", "i", policy).collect()]
    assert sorted(texts) == sorted(batch) == ["", "", "", "abcd", "abcd"]
