"""Relational sources: Parquet folders or JDBC, registered under qualified names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The tables read and the row counts a complete load reaches.
SPENDING_TABLES = (
    "general.entity_golden_records",
    "fed.grants_contributions",
    "cra.t3010_impossibilities",
    "cra.t3010_plausibility_flags",
    "cra.loops",
    "cra.loop_universe",
    "ab.ab_grants",
)
MINIMUM_ROWS = {
    "general.entity_golden_records": 700_000,
    "fed.grants_contributions": 1_200_000,
    "cra.t3010_impossibilities": 50_000,
    "cra.t3010_plausibility_flags": 1_000,
    "cra.loops": 5_500,
    "cra.loop_universe": 1_400,
}


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A qualified table kept as <base>/<schema>/<table>.parquet, or an unqualified one as <base>/<name>.parquet."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name.replace('.', '/')}.parquet")


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    timeout_seconds: int | None = None,
    even: bool = False,
    split_by: str | None = None,
    **options: str,
) -> DataFrame:
    """A table of a database, read in parallel slices of a whole-numbered column.

    Bounds that aren't given are looked up first. A table without such a column is read in one task. Slices of equal
    width hold as many rows as the values fall there; `even` asks the database for the rows per value range and cuts
    slices of about equal rows, with slices of their own for NULL and for a value that has more rows than a slice.
    `split_by` names a second whole-numbered column that cuts these further.
    """
    def reader(source: str):
        made = spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**options)
        return made if timeout_seconds is None else made.option("queryTimeout", timeout_seconds)

    if partition_column is None:
        return reader(table).load()
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    ask = lambda query: [tuple(r) for r in reader(f"({query}) asked").load().collect()]
    if even:
        slices = even_slices(ask, table, quote(partition_column), partitions, quote(split_by) if split_by else None)
        properties = {k: str(v) for k, v in options.items()} | ({} if timeout_seconds is None else {"queryTimeout": str(timeout_seconds)})
        return spark.read.jdbc(url, table, predicates=slices, properties=properties)
    if bounds is None:
        least, most = ask(f"SELECT min({quote(partition_column)}) AS a, max({quote(partition_column)}) AS b FROM {table}")[0]
        bounds = (int(least or 0), int(most or 0) + 1)
    sliced = reader(table).option("partitionColumn", partition_column).option("lowerBound", bounds[0])
    return sliced.option("upperBound", bounds[1]).option("numPartitions", partitions).load()


def even_slices(ask: Callable[[str], list[tuple]], table: str, column: str, slices: int, split_by: str | None = None) -> list[str]:
    """Predicates that cut a table into parts of about equal rows; each row meets just one of them.

    The database counts rows in ranges of equal width, and again inside every range that holds more than a quarter of a
    slice, until ranges are that small or a single value. At most some 64 counts a question reach the driver.
    """
    def counted(where: str, by: str, least: int, most: int) -> list[tuple[int, int, int]]:
        """(least, most, rows) of up to 64 ranges of whole numbers with rows in them."""
        width = max(1, -(-(most - least + 1) // 64))
        cell = f"({by} - ({least})) / {width}" if width > 1 else f"{by} - ({least})"
        found = ask(f"SELECT cell_no, count(*) AS n FROM (SELECT {cell} AS cell_no FROM {table} WHERE {where} AND {by} BETWEEN {least} AND {most}) cells GROUP BY cell_no")
        return [(least + int(at) * width, min(most, least + (int(at) + 1) * width - 1), int(n)) for at, n in sorted(found)]

    def ranges(where: str, by: str, size: float) -> list[tuple[int, int, int]]:
        least, most = ask(f"SELECT min({by}) AS a, max({by}) AS b FROM {table} WHERE {where}")[0]
        todo, done = [] if least is None else [(int(least), int(most), None)], []
        while todo:
            lo, hi, n = todo.pop()
            if n is None or (n > size / 4 and hi > lo):
                todo += counted(where, by, lo, hi)
            else:
                done.append((lo, hi, n))
        return sorted(done)

    def cut(where: str, by: str, size: float, further: str | None) -> list[str]:
        """Neighbouring ranges together up to a slice; a value with more rows than that apart, cut by the further column."""
        out, held = [], []

        def close() -> None:
            if held:
                out.append(f"{where} AND {by} BETWEEN {held[0][0]} AND {held[-1][1]}")
            held.clear()

        for lo, hi, n in ranges(where, by, size):
            if n > size and further:
                close()
                out.extend(cut(f"{where} AND {by} = {lo}", further, size, None))
                out.append(f"{where} AND {by} = {lo} AND {further} IS NULL")
                continue
            if held and sum(r[2] for r in held) + n > size:
                close()
            held.append((lo, hi, n))
        close()
        return out

    total, nulls = (int(n) for n in ask(f"SELECT count(*) AS n, count(*) - count({column}) AS m FROM {table}")[0])
    size = max(1.0, total / max(1, slices))
    out = cut(f"{column} IS NOT NULL", column, size, split_by)
    if nulls > size and split_by:
        out += cut(f"{column} IS NULL", split_by, size, None) + [f"{column} IS NULL AND {split_by} IS NULL"]
    elif nulls or not out:
        out.append(f"{column} IS NULL")
    return out


def jdbc_catalog(spark: SparkSession, name: str, url: str, **options: str) -> None:
    """Make a database a catalog: SQL names its tables <name>.<schema>.<table>, and filters, columns, aggregates, limits and top-k run there."""
    key = f"spark.sql.catalog.{name}"
    spark.conf.set(key, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    pushed = {f"pushDown{what}": "true" for what in ("Predicate", "Aggregate", "Limit", "Offset", "TableSample")}
    for option, value in ({"url": url} | pushed | options).items():
        spark.conf.set(f"{key}.{option}", value)


def register_views(
    spark: SparkSession, base: str, names: Iterable[str] = SPENDING_TABLES, search_path: Iterable[str] = ()
) -> dict[str, DataFrame]:
    """Register each table as schema_table, and unqualified for the schemas on the search path, first one first."""
    frames = {name: load_table(spark, base, name) for name in names}
    for name, df in frames.items():
        df.createOrReplaceTempView(name.replace(".", "_"))
    for schema in reversed(list(search_path)):
        for name, df in frames.items():
            owner, _, table = name.rpartition(".")
            if owner == schema:
                df.createOrReplaceTempView(table)
    return frames


def register_schemas(
    spark: SparkSession, base: str, names: Iterable[str] = SPENDING_TABLES, use: str | None = None, search_path: Iterable[str] = ()
) -> None:
    """Put each schema.table of the catalog in front of its files, so that SQL names tables as their owner does.

    The tables are external: nothing is copied, and replacing or dropping one leaves its files. `use` makes a schema
    the current one. Unqualified names that this schema lacks are found along the search path, first schema first.
    """
    names = list(names)
    for schema in dict.fromkeys(name.rpartition(".")[0] for name in names):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted_name(schema)}")
    for name in names:
        where = f"{base.rstrip('/')}/{name.replace('.', '/')}.parquet"
        spark.sql(f"DROP TABLE IF EXISTS {quoted_name(name)}")
        spark.catalog.createTable(quoted_name(name), path=where, source="parquet")
    for schema in reversed(list(search_path)):
        for name in names:
            owner, _, table = name.rpartition(".")
            if owner == schema:
                spark.table(quoted_name(name)).createOrReplaceTempView(table)
    if use is not None:
        spark.catalog.setCurrentDatabase(use)


def quoted_name(name: str) -> str:
    """A qualified name with each part quoted."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def save_current(
    current: DataFrame,
    table: str,
    buckets: int = 256,
    by: str = "ref_number",
    row_id: str = "_id",
    files_per_bucket: int = 4,
    path: str | None = None,
) -> DataFrame:
    """Keep current-version rows as a bucketed table: later joins and groupings on the key need no shuffle.

    Rows are gathered by bucket before writing, each bucket in a few parts so that a key with many
    rows is written by more than one task.
    """
    bucket = F.pmod(F.hash(by), F.lit(buckets))
    part = F.pmod(F.xxhash64(row_id), F.lit(files_per_bucket))
    gathered = current.repartition(buckets * files_per_bucket, bucket, part)
    writer = gathered.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return current.sparkSession.table(table)


def row_count_gate(tables: Mapping[str, DataFrame], minimums: Mapping[str, int] = MINIMUM_ROWS) -> DataFrame:
    """(label, n, expected_at_least, passed) per table."""
    gates = None
    for label, least in minimums.items():
        gate = tables[label].agg(F.count("*").alias("n")).select(
            F.lit(label).alias("label"),
            "n",
            F.lit(least).cast("bigint").alias("expected_at_least"),
            (F.col("n") >= least).alias("passed"),
        )
        gates = gate if gates is None else gates.unionByName(gate)
    return gates


def load_and_gate(tables: Mapping[str, DataFrame], base: str, minimums: Mapping[str, int] = MINIMUM_ROWS) -> tuple[dict[str, DataFrame], DataFrame]:
    """Write each table below base as load_table reads it, and gate it by the rows that its own write counted.

    Nothing is read again: the count is a metric of the write, so a gate costs no scan, and it counts just what
    was written. Returns the tables as written and (label, n, expected_at_least, passed) of those with a minimum.
    """
    written, told = {}, []
    for label, df in tables.items():
        seen = Observation(f"rows of {label}")
        path = f"{base.rstrip('/')}/{label.replace('.', '/')}.parquet"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        written[label] = df.sparkSession.read.schema(df.schema).parquet(path)
        if label in minimums:
            n = seen.get["n"]
            told.append((label, n, minimums[label], n >= minimums[label]))
    spark = next(iter(tables.values())).sparkSession
    return written, spark.createDataFrame(told, "label string, n bigint, expected_at_least bigint, passed boolean")
