"""Data-defect guards: current version, exact duplicates, roll-ups and reversals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import blank_to_int, recipient_partition_key

PAYMENT_KEYS = ("ministry", "business_unit_name", "recipient", "program", "payment_date")


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in a total order; NULL keys count as equal.

    row_number() <= 1 lets Spark prune to one row per key inside every map task before the
    shuffle, so a key that holds a large part of the table never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def current_version(
    df: DataFrame,
    keys: Sequence[Column | str] | None = None,
    order: Sequence[Column] | None = None,
    ref: str = "ref_number",
    amendment: str = "amendment_number",
    bn: str = "recipient_business_number",
    name: str = "recipient_legal_name",
    row_id: str = "_id",
) -> DataFrame:
    """Latest amendment of each agreement; colliding reference numbers stay apart by recipient."""
    if keys is None:
        keys = [F.col(ref), recipient_partition_key(bn, name, row_id)]
    if order is None:
        order = [blank_to_int(amendment).desc_nulls_last(), F.col(row_id).desc()]
    return first_per_key(df, keys, order)


def exclude_rollups(df: DataFrame, recipient: str = "recipient") -> DataFrame:
    """Drop publisher roll-up rows, which name no recipient."""
    return df.filter(F.col(recipient).isNotNull())


def omitted_rollup(
    df: DataFrame, recipient: str = "recipient", amount: str = "amount", by: Sequence[str] = ()
) -> DataFrame:
    """The aggregate the roll-up exclusion leaves out, for disclosure next to totals."""
    return (
        df.filter(F.col(recipient).isNull())
        .groupBy(*by)
        .agg(F.count("*").alias("omitted_rows"), F.sum(amount).alias("omitted_amount"))
    )


def dedupe_exact(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per exact duplicate group."""
    return first_per_key(df, keys, order)


def flag_reversals(
    df: DataFrame,
    keys: Sequence[str] = PAYMENT_KEYS,
    amount: str = "amount",
    null_safe: bool = False,
) -> DataFrame:
    """Mark rows that have a twin with the opposite amount. The input must be free of exact duplicates.

    Twins share the keys and the absolute amount, so after deduplication a group holds at most two
    rows and one windowed count finds the pair. A NULL key part never pairs unless null_safe.
    """
    w = Window.partitionBy(*keys, F.abs(F.col(amount)))
    paired = F.count("*").over(w) > 1
    paired = paired & F.col(amount).isNotNull()
    if not null_safe:
        for k in keys:
            paired = paired & F.col(k).isNotNull()
    return df.withColumn("has_reversal_pair", paired)


def clean_payments(
    df: DataFrame,
    keys: Sequence[str] = PAYMENT_KEYS,
    amount: str = "amount",
    row_id: str = "id",
    recipient: str = "recipient",
    null_safe: bool = False,
) -> DataFrame:
    """Roll-ups out, exact duplicates out, reversal pairs reduced to their positive half, which has_reversal_pair marks.

    Rows of equal keys and equal absolute amount are one group, of which only the smallest id of each sign
    can stay: one aggregate finds both, combined before its only shuffle. An amount of zero or NULL has no twin.
    """
    others = [c for c in df.columns if c not in (*keys, amount, row_id)]
    negative = F.coalesce(F.col(amount) < 0, F.lit(False))

    def first(of_sign: Column) -> Column:
        at = F.when(of_sign, F.col(row_id))
        return F.min_by(F.struct(row_id, *others), at) if others else F.min(at)

    kept = exclude_rollups(df, recipient).groupBy(*keys, F.abs(F.col(amount)).alias("_size"))
    groups = kept.agg(first(~negative).alias("_plus"), first(negative).alias("_minus"))
    twins = F.col("_plus").isNotNull() & F.col("_minus").isNotNull()
    if not null_safe:
        for k in keys:
            twins = twins & F.col(k).isNotNull()
    kind = df.schema[amount].dataType

    def side(row: str, value: Column) -> Column:
        told = [F.col(row)[c].alias(c) for c in (row_id, *others)] if others else [F.col(row).alias(row_id)]
        return F.struct(value.cast(kind).alias(amount), *told, twins.alias("has_reversal_pair"))

    plus = F.when(F.col("_plus").isNotNull(), side("_plus", F.col("_size")))
    minus = F.when(F.col("_minus").isNotNull() & ~twins, side("_minus", -F.col("_size")))
    rows = groups.select(*keys, F.explode(F.array_compact(F.array(plus, minus))).alias("_row"))
    return rows.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in (*df.columns, "has_reversal_pair")])


def recipient_totals(
    df: DataFrame,
    value: str = "agreement_value",
    bn: str = "recipient_business_number",
    name: str = "recipient_legal_name",
) -> DataFrame:
    """Commitment and agreement count per recipient; rows without a value take no part."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.coalesce(bn, name).alias("recipient_key"))
        .agg(F.sum(value).alias("total_commitment"), F.count("*").alias("agreement_count"))
    )


def amendment_profile(
    df: DataFrame,
    keys: Sequence[str] = ("ref_number",),
    amendment: Column | str = "amendment_number",
    value: str = "agreement_value",
    row_id: str = "_id",
) -> DataFrame:
    """Amendments filed per agreement, and how far the value has grown since the first version. row_id is a whole number."""
    number = blank_to_int(amendment)
    # Versions without a number are originals and sort first. One decimal holds number and whole-numbered
    # row id, since an order of two fields would keep the aggregation from hashing.
    wide = "decimal(38,0)"
    order = F.coalesce(number, F.lit(-1)).cast(wide) * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(row_id).cast(wide)
    order = order.cast(wide)
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("versions"),
            F.count(F.when(number > 0, 1)).alias("amendment_count"),
            F.min_by(value, order).alias("first_value"),
            F.max(value).alias("max_value"),
        )
        .withColumn("growth", F.col("max_value") - F.col("first_value"))
    )


def description_gaps(
    df: DataFrame,
    min_value: float = 1_000_000,
    min_len: int = 80,
    value: str = "agreement_value",
    description: str = "description_en",
    **version_columns: str,
) -> DataFrame:
    """Current commitments above a floor whose description is missing or too short."""
    current = current_version(df, **version_columns)
    short = F.col(description).isNull() | (F.length(description) <= min_len)
    return current.filter((F.col(value) > min_value) & short)
