"""Tables of a database, in slices; plans of cheap aggregates."""

import pytest
from pyspark.sql import functions as F

from grantlens.operators import guards
from grantlens.sources.tables import jdbc_catalog, load_and_gate, load_jdbc, register_schemas


@pytest.fixture(scope="module")
def url(spark):
    where = "jdbc:derby:memory:grants;create=true"
    spark.range(1000).selectExpr("id", "cast(id % 7 AS string) AS name").write.jdbc(where, "grants", "overwrite")
    return where


@pytest.mark.parametrize(("options", "slices"), [({}, 1), ({"partition_column": "id", "partitions": 5}, 5), ({"partition_column": "id", "bounds": (0, 10), "partitions": 3}, 3)])
def test_database_tables_are_read_whole_and_in_slices(spark, url, options, slices):
    df = load_jdbc(spark, url, "grants", **options)
    assert sorted(r[0] for r in df.select("id").collect()) == list(range(1000))
    parts = df.selectExpr("spark_partition_id() AS p").distinct().count()
    assert parts <= slices and (parts > 1) == (slices > 1)


def test_amendment_profile_hashes(spark):
    df = spark.createDataFrame([(1, "r", "2", 5), (2, "r", "", 3), (3, "r", None, 4), (4, "s", "1", None)], "_id long, ref_number string, amendment_number string, agreement_value int")
    profile = guards.amendment_profile(df)
    assert "SortAggregate" not in profile._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in profile.collect() if r.ref_number == "r") == [("r", 3, 1, 3, 5, 2)]


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows: half of them at one key, a tenth without a key, the others far apart; two columns to split by."""
    where = "jdbc:derby:memory:skewed;create=true"
    key = "CASE WHEN id % 2 = 0 THEN 77 WHEN id % 10 = 1 THEN NULL ELSE cast(pow(id, 3) AS long) - 1000000 END"
    spark.range(4000).selectExpr("id", f"{key} AS k", "IF(id % 400 = 0, NULL, id % 97) AS s", "cast(id % 7 AS string) AS name").write.jdbc(where, "skewed", "overwrite")
    return where


@pytest.mark.parametrize("split_by", [None, "id"])
def test_even_slices(spark, skewed, split_by):
    df = load_jdbc(spark, skewed, "skewed", "k", partitions=8, even=True, split_by=split_by)
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert sorted(r.id for r in df.select("id").collect()) == list(range(4000))  # every row once, NULL keys too
    if split_by:
        # neighbours of the hot key and of NULL may come short; all others are within two times of each other
        assert max(sizes) <= 500 and sum(size >= 250 for size in sizes) >= 7
    else:
        assert sizes[-1] == 2000 and sizes[-2] <= 500


def test_even_slices_of_odd_columns(spark, skewed):
    assert load_jdbc(spark, skewed, "skewed", "s", partitions=5, even=True, split_by="k").count() == 4000
    assert load_jdbc(spark, skewed, '(SELECT * FROM skewed WHERE "id" < 0) few', "k", partitions=5, even=True).count() == 0
    assert load_jdbc(spark, skewed, '(SELECT * FROM skewed WHERE "k" IS NULL) bare', "k", partitions=5, even=True).count() == 400


def test_filters_and_columns_reach_the_database(spark, skewed):
    df = load_jdbc(spark, skewed, "skewed", "id", partitions=4).filter("k = 77 AND id < 1000").select("s")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "*EqualTo(k,77)" in plan and "*LessThan(id,1000)" in plan and "ReadSchema: struct<s:" in plan
    assert df.count() == 500


def test_aggregates_run_in_a_catalogued_database(spark, skewed):
    jdbc_catalog(spark, "lens_db", skewed, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    df = spark.sql("SELECT s, count(*) AS n, max(id) AS top FROM lens_db.APP.SKEWED WHERE id < 700 GROUP BY s")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregates: [COUNT(*), MAX(" in plan and "PushedFilters" in plan and "PushedGroupByExpressions" in plan
    want = {}
    for k in range(700):
        want.setdefault(None if k % 400 == 0 else k % 97, []).append(k)
    assert {r.s: (r.n, r.top) for r in df.collect()} == {s: (len(v), max(v)) for s, v in want.items()}


def test_gate_counts_what_the_writes_wrote(spark, tmp_path):
    tables = {"fed.a": spark.range(3), "cra.b": spark.range(0), "ab.c": spark.range(9).repartition(4), "ab.free": spark.range(1)}
    written, gate = load_and_gate(tables, str(tmp_path), {"fed.a": 4, "cra.b": 0, "ab.c": 9})
    assert sorted(tuple(r) for r in gate.collect()) == [("ab.c", 9, 9, True), ("cra.b", 0, 0, True), ("fed.a", 3, 4, False)]
    assert {k: v.count() for k, v in written.items()} == {"fed.a": 3, "cra.b": 0, "ab.c": 9, "ab.free": 1}
    assert "FileScan" not in gate._jdf.queryExecution().executedPlan().toString()


def test_tables_are_named_by_schema(spark, tmp_path):
    for name, n in (("lens_x.a", 3), ("lens_y.a", 5), ("lens_y.b", 2)):
        spark.range(n).write.parquet(str(tmp_path / f"{name.replace('.', '/')}.parquet"))
    names = ("lens_x.a", "lens_y.a", "lens_y.b")
    for _ in range(2):  # again over the same names
        register_schemas(spark, str(tmp_path), names, search_path=("lens_y", "lens_x"))
        assert spark.sql("SELECT count(*) FROM lens_x.a").first()[0] == 3 and spark.sql("SELECT count(*) FROM a JOIN b USING (id)").first()[0] == 2
    try:
        register_schemas(spark, str(tmp_path), names, use="lens_x")
        spark.sql("DROP VIEW a")
        assert spark.table("a").count() == 3 and spark.catalog.currentDatabase() == "lens_x"
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP VIEW IF EXISTS b")
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    assert spark.read.parquet(str(tmp_path / "lens_y/a.parquet")).count() == 5  # the files stay
