"""The registered quality query against its SQL, on a given table and on awkward rows
of which some hosts fall."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quakes.llm.quality_rules import OP7_SQL, op7_quality_rules

SF = "/root/testdata/sf0.001"
CLEAN = "one two three four five six seven eight nine ten eleven twelve"
AGAIN = " ".join(["a b c d e"] * 6)
LINES = "\n".join([CLEAN] * 9)
AWKWARD = (
    [(k, CLEAN, "good") for k in range(40)]
    + [(100 + k, "short text", "bad") for k in range(40)]
    + [(200 + k, CLEAN + " ####" * 12, "symbols") for k in range(60)]
    + [(300 + k, LINES if k % 2 else AGAIN, "mixed") for k in range(30)]
    + [(400, CLEAN, "bad"), (401, None, "bad"), (402, CLEAN, "symbols"), (403, "", None), (404, CLEAN, None), (404, CLEAN, None)]
    + [(405, "a a a a a a a a a a", "few"), (406, "x\x0by\x0cz \r\n\t" + CLEAN, "few"), (407, "É\x85 ẞ # | <>\n\n" + CLEAN, "few")]
    + [(None, CLEAN, "good"), (408, AGAIN + " " + CLEAN + " " + AGAIN, "few"), (409, "w " * 20_000, "long"), (410, "one", "alone")]
)


def both(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{GLOB[folder == SF]}')")
    want = con.execute(OP7_SQL)
    names = [d[0] for d in want.description]
    got = op7_quality_rules(spark, folder)
    assert sorted(got.columns) == sorted(names)
    return sorted((tuple(r) for r in got.select(*names).collect()), key=repr), sorted(want.fetchall(), key=repr), names


GLOB = {True: "", False: "/*.parquet"}


def test_op7_equals_its_sql(spark):
    got, want, _ = both(spark, SF)
    assert got == want


@pytest.mark.parametrize("partitions", [1, 7])
def test_op7_equals_its_sql_where_hosts_fall(spark, tmp_dir, partitions):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, source string").withColumn("n", F.lit(1))
    df.repartition(partitions).write.parquet(f"{tmp_dir}/documents.parquet")
    got, want, names = both(spark, tmp_dir)
    assert got == want
    kept = {r[names.index("doc_id")] for r in got if r[names.index("kept")]}
    assert 400 not in kept and 402 not in kept  # clean documents of hosts that fall
    assert set(range(40)) <= kept and 404 in kept


def test_op7_sql_on_no_rows(spark, tmp_dir):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_dir}/documents.parquet")
    assert both(spark, tmp_dir)[:2] == ([], [])
