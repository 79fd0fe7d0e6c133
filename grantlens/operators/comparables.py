"""Tiered nearest-comparable retrieval, in batch over every source, without pairing whole groups.

Tier 1: same program, value within +/- 50 % of the source's.
Tier 2: same program, start years at most five apart.
Tier 3: same department.
Candidates carry a usable description; a source never meets rows of its own reference number.
Within a tier the higher value comes first, then the lower row id.

A source needs only its k best. So each program-year and each department is reduced once to a
short list that provably holds the answer for every source, and sources meet lists, not groups:

* Tier 1 or 2 rows can repeat in a later tier's list, fewer than k of them when the later tier is
  needed at all, so a list must serve 2k-1 rows that are not the source's own.
* A reference number never supplies more than those 2k-1, so each is held to its best 2k-1; of the
  rest the best 2(2k-1) leave enough whichever single reference number is taken out.

For tier 1 the range differs by source. Candidates of a program get a position in value order and
are packed into small blocks by position; a source looks up the block at its upper bound. Where a
reference number has more rows in the program than a block can absorb, the rows just before each
of its own rows are added: every gap between own rows then contributes its last k, which is all
the answer can use. All of it grows linearly with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fiscal_year, has_description
from ..session import Stages, stages_of
from .guards import current_version, first_per_key
from .skew import SPREAD, distinct_keys, reduce_by, spread

# Rows of one program that positions are counted over in one go, as far as the sketch of its values is exact, the
# most cells of a program (a power of two), and the sketch's size. Of n rows in c cells a cell gets at most
# n / c + 2 n x 0.0002 and the rows of one value more. These only affect task sizes.
CELL_ROWS = 1 << 16
MOST_CELLS = 1 << 12
SKETCH = 1 << 15


# Exact for any amount of 18 digits and its half or one and a half.
WIDE = "decimal(24,4)"


def _times(value: str, factor: str) -> Column:
    return (F.col(value) * F.lit(factor).cast("decimal(2,1)")).cast(WIDE)


def _best_first() -> list[Column]:
    return [F.col("value").desc_nulls_last(), F.col("id").asc()]


def _at_most(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key; pruned map-side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def _short_list(df: DataFrame, keys: list[str], serve: int) -> DataFrame:
    """Rows that hold the best `serve` for every source, whichever one reference number it excludes."""
    held = _at_most(df, [*keys, "ref"], _best_first(), serve)
    return _at_most(held, keys, _best_first(), 2 * serve)


def _collect(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Pack short lists into one array per key, best first (highest value, then lowest id)."""
    entry = F.struct(
        F.col("value").isNull().alias("no_value"),
        (-F.col("value")).alias("neg_value"),
        F.col("id").alias("id"),
        F.col("ref").alias("ref"),
        F.col("program").alias("program"),
        F.col("year").alias("year"),
    )
    return reduce_by(df, keys, F.sort_array(F.collect_list(entry)).alias(name))


def agreement_rows(
    grants: DataFrame,
    ref: str = "ref_number",
    program: str = "prog_name_en",
    department: str = "owner_org_title",
    value: str = "agreement_value",
    start: str = "agreement_start_date",
    description: str = "description_en",
    row_id: str = "_id",
    min_len: int = 80,
    **version_columns: str,
) -> DataFrame:
    """Narrow current-version rows; the description travels as a flag only."""
    return current_version(grants, ref=ref, row_id=row_id, **version_columns).select(
        F.col(row_id).alias("id"),
        F.col(ref).alias("ref"),
        F.col(program).alias("program"),
        F.col(department).alias("department"),
        F.col(value).cast("decimal(18,2)").alias("value"),
        F.year(start).alias("year"),
        has_description(description, min_len).alias("described"),
    )


def pick_sources(rows: DataFrame, source_refs: DataFrame | None = None) -> DataFrame:
    """One source row per reference number: the highest value, then the lowest id."""
    rows = rows.filter(F.col("ref").isNotNull())
    if source_refs is not None:
        rows = rows.join(distinct_keys(source_refs, "ref"), "ref", "left_semi")
    return first_per_key(rows, ["ref"], _best_first())


def _cuts(rows: DataFrame) -> DataFrame:
    """(program, cuts): ascending values that cut a program's rows into parts of about equal size; no cuts for small programs."""
    sketched = reduce_by(rows, ["program"], F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(SKETCH)).alias("sketch"), F.count("*").alias("n"))
    cells = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / CELL_ROWS))), F.lit(MOST_CELLS)).cast("int")
    # The function takes constant ranks only: the finest are asked for, and as many kept as the program needs.
    ranks = F.split(F.lit(",".join(str(j / MOST_CELLS) for j in range(1, MOST_CELLS))), ",").cast("array<double>")
    large = sketched.filter(F.col("n") > CELL_ROWS).withColumn("stride", F.lit(MOST_CELLS) / cells)
    kept = F.filter(F.kll_sketch_get_quantile_double("sketch", ranks), lambda _, at: (at + 1) % F.col("stride") == 0)
    return large.select("program", F.array_distinct(kept).alias("cuts"))


def _cell(value: Column, cuts: Column) -> Column:
    """How many of the ascending cuts a value reaches, by halving."""
    steps = F.array(*[F.lit(MOST_CELLS >> n) for n in range(MOST_CELLS.bit_length())])
    reaches = lambda at: F.coalesce(F.get(cuts, at - 1) <= value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reaches(at + step), at + step).otherwise(at))


def _celled(rows: DataFrame, stages: Stages) -> DataFrame:
    """Rows of a table of the shared folder with the cell of their value within their program."""
    cuts = stages.add(_cuts(rows))
    cell = F.when(F.col("cuts").isNull(), 0).otherwise(_cell(F.col("value").cast("double"), F.col("cuts")))
    return rows.join(cuts, "program", "left").withColumn("cell", cell).drop("cuts")


def _value_positions(cands: DataFrame, bounds: DataFrame, stages: Stages) -> DataFrame:
    """Rank candidates by (value, id descending) within a program, and place the bounds among them.

    A program may hold a third of the table, so ranks are counted inside cells and the cell totals (few per
    program) give each cell its offset. Cells are cut at quantiles of the program's own values, so values
    that crowd into a narrow range get as many cells as any others.
    """
    rows = cands.select(
        "program", "value", F.lit(0).alias("kind"), "id", "ref", "year"
    ).unionByName(bounds.select("program", "value", F.lit(1).alias("kind")), allowMissingColumns=True)
    rows = _celled(stages.add(rows), stages)
    is_cand = F.when(F.col("kind") == 0, 1).otherwise(0)
    totals = rows.groupBy("program", "cell").agg(F.sum(is_cand).alias("in_cell"))
    before = Window.partitionBy("program").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("program", "cell", F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("program", "cell").orderBy("value", "kind", F.col("id").desc())
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("local", F.sum(is_cand).over(inside))
    return ranked.join(offsets, ["program", "cell"]).withColumn("pos", F.col("offset") + F.col("local"))


def _tier_one(rows: DataFrame, sources: DataFrame, k: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(list per program and source value, list per source whose own rows crowd the program)."""
    valued = F.col("program").isNotNull() & (F.col("value") >= 0)
    cands = rows.filter(F.col("described") & valued).withColumn("value", F.col("value").cast(WIDE))
    # rows of one program and value beyond these can never be among anyone's best k
    cands = _at_most(cands, ["program", "value", "ref"], _best_first(), k)
    cands = _at_most(cands, ["program", "value"], _best_first(), 2 * k)
    bounds = sources.filter(valued).select("program", _times("value", "1.5").alias("value")).distinct()
    placed = stages.add(_value_positions(cands, bounds, stages).drop("cell", "offset", "local"))

    found = placed.filter("kind = 0")
    size = 2 * k
    # a block holds its own rows and those of the block before, so any position in it looks back
    # over at least `size` rows
    block = F.floor((F.col("pos") - 1) / size)
    entry = F.struct("pos", "value", "id", "ref", "year")
    blocks = reduce_by(
        found.withColumn("block", F.explode(F.array(block, block + 1))),
        ["program", "block"],
        F.sort_array(F.collect_list(entry), asc=False).alias("members"),
    )

    def look_back(points: DataFrame) -> DataFrame:
        here = points.filter(F.col("pos") > 0).withColumn("block", F.floor((F.col("pos") - 1) / size))
        joined = here.join(blocks, ["program", "block"])
        at = F.col("pos")
        return joined.withColumn("members", F.filter("members", lambda m: m["pos"] <= at)).drop("block")

    probes = placed.filter("kind = 1").select("program", F.col("value").alias("bound"), "pos")
    at_bound = look_back(probes).select("program", "bound", "members")

    own_rows = found.groupBy("program", "ref", spread("program", "ref")).agg(F.count("*").alias("n"))
    crowded = own_rows.filter(F.col("n") > k)
    src = sources.filter(valued).select("program", "ref", _times("value", "1.5").alias("bound"), _times("value", "0.5").alias("lower"))
    src = src.withColumn(SPREAD, spread("program", "ref"))
    crowded_src = src.join(crowded, ["program", "ref", SPREAD], "left_semi").drop(SPREAD)
    own = (
        found.select("program", "ref", "value", "pos")
        .join(crowded_src, ["program", "ref"])
        .filter("value <= bound")
        .select("program", "ref", "lower", F.col("pos") - 1)
        .toDF("program", "own_ref", "lower", "pos")
    )
    ends = crowded_src.join(probes, ["program", "bound"]).select("program", F.col("ref").alias("own_ref"), "lower", "pos")
    gaps = look_back(own.unionByName(ends))
    others = gaps.select(
        "own_ref",
        F.explode(F.filter("members", lambda m: (m["ref"] != F.col("own_ref")) & (m["value"] >= F.col("lower")))).alias("m"),
    ).select("own_ref", "m.*")
    # the same row may be seen from several gaps
    others = others.dropDuplicates(["own_ref", "id"])
    order = [F.col("value").desc(), F.col("id").asc()]
    best = _at_most(others, ["own_ref"], order, k)
    crowded_lists = best.groupBy(F.col("own_ref").alias("ref")).agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("crowded_members")
    )
    return at_bound, crowded_lists


def match_comparables(
    rows: DataFrame, sources: DataFrame, k: int = 12, years: int = 5, stages: Stages | None = None
) -> DataFrame:
    """(source_ref, id, ref, value, similarity_tier, position) for every source row."""
    serve = 2 * k - 1
    rows = rows.filter(F.col("ref").isNotNull())
    stages = stages or stages_of(rows.sparkSession)
    at_bound, crowded = _tier_one(rows, sources, k, stages)

    described = rows.filter("described")
    yearly = described.filter(F.col("program").isNotNull() & F.col("year").isNotNull())
    yearly = _short_list(yearly, ["program", "year"], serve)
    near = yearly.withColumn("source_year", F.explode(F.sequence(F.col("year") - years, F.col("year") + years)))
    near = _short_list(near, ["program", "source_year"], serve)
    by_year = _collect(near, ["program", "source_year"], "year_list")
    dept = _short_list(described.filter(F.col("department").isNotNull()), ["department"], serve)
    by_dept = _collect(dept, ["department"], "dept_list")

    low = _times("value", "0.5")
    own = F.col("ref")

    def shaped(items: Column, tier: int, value) -> Column:
        made = F.transform(
            items,
            lambda m: F.struct(m["id"].alias("id"), m["ref"].alias("ref"), value(m).cast(WIDE).alias("value"), F.lit(tier).alias("tier")),
        )
        return F.coalesce(made, F.array().cast(f"array<struct<id:{ids},ref:{refs},value:{WIDE},tier:int>>"))

    def in_band(m) -> Column:
        v = -m["neg_value"]
        return F.coalesce(v.between(low, F.col("bound")), F.lit(False))

    def filled(df: DataFrame, more: Column) -> DataFrame:
        return df.select(*source_columns, F.slice(F.concat("best", more), 1, k).alias("best"))

    ids, refs = (sources.schema[c].dataType.simpleString() for c in ("id", "ref"))
    same_program = lambda m: F.coalesce(m["program"] == F.col("program"), F.lit(False))
    s = sources.withColumn("bound", _times("value", "1.5"))
    source_columns = s.columns
    # A source with k rows of tier 1 meets no further list; only one still short after tier 2 meets its department's.
    tiered = s.join(at_bound, ["program", "bound"], "left").join(crowded, "ref", "left").withColumn("best", F.array().cast(
        f"array<struct<id:{ids},ref:{refs},value:{WIDE},tier:int>>"))
    near_value = F.filter(F.coalesce("crowded_members", "members"), lambda m: (m["ref"] != own) & (m["value"] >= low))
    first = stages.add(filled(tiered, shaped(near_value, 1, lambda m: m["value"])))
    short = first.filter(F.size("best") < k).join(by_year.withColumnRenamed("source_year", "year"), ["program", "year"], "left")
    in_years = F.filter("year_list", lambda m: (m["ref"] != own) & ~in_band(m))
    second = stages.add(filled(short, shaped(in_years, 2, lambda m: -m["neg_value"])))
    still = second.filter(F.size("best") < k).join(by_dept, "department", "left")
    elsewhere = F.filter(
        "dept_list",
        lambda m: (m["ref"] != own)
        & ~(same_program(m) & (in_band(m) | F.coalesce(F.abs(m["year"] - F.col("year")) <= years, F.lit(False)))),
    )
    third = filled(still, shaped(elsewhere, 3, lambda m: -m["neg_value"]))
    done = first.filter(F.size("best") == k).unionByName(second.filter(F.size("best") == k)).unionByName(third)
    return done.select(F.col("ref").alias("source_ref"), F.posexplode("best").alias("at", "m")).select(
        "source_ref", "m.id", "m.ref", "m.value", F.col("m.tier").alias("similarity_tier"), (F.col("at") + 1).alias("position")
    )


def comparable_grants(
    grants: DataFrame,
    source_refs: DataFrame | None = None,
    k: int = 12,
    fy_mode: str = "as_coded",
    description: str = "description_en",
    department: str = "owner_org_title",
    value: str = "agreement_value",
    start: str = "agreement_start_date",
    row_id: str = "_id",
    stages: Stages | None = None,
    **columns: str,
) -> DataFrame:
    """The k best comparables of each source reference number (all of them when none are given).

    Texts and dates are joined back only for rows that were chosen. stages owns the intermediates.
    """
    stages = stages or stages_of(grants.sparkSession)
    rows = stages.add(
        agreement_rows(grants, description=description, department=department, value=value, start=start, row_id=row_id, **columns)
    )
    chosen = match_comparables(rows, pick_sources(rows, source_refs), k, stages=stages)
    wide = grants.select(
        F.col(row_id).alias("id"),
        F.col(description).alias("description"),
        F.col(value).alias("amount"),
        F.col(department).alias("department_code"),
        fiscal_year(start, fy_mode).alias("fiscal_year"),
    )
    return chosen.join(wide, "id").select(
        "source_ref", F.col("ref").alias("grant_id"), "id", "description", "amount", "department_code",
        "fiscal_year", "similarity_tier", "position",
    )


def tier_counts(comparables: DataFrame) -> DataFrame:
    return comparables.groupBy("source_ref", F.col("similarity_tier").alias("tier")).agg(F.count("*").alias("grants"))
