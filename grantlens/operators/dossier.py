"""Per-entity dossiers, seed look-ups and postal-code roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import any_address_in, json_number, matching_number, normalize_postal, recipient_partition_key
from ..session import Stages, stages_of
from .guards import current_version
from .scoring import violation_counts
from .skew import distinct_keys, reduce_by, spread

AGREEMENT_FIELDS = (
    "_id", "ref_number", "recipient_business_number", "recipient_legal_name", "recipient_country",
    "recipient_province", "agreement_value", "agreement_start_date", "agreement_end_date", "description_en",
    "prog_name_en", "owner_org_title",
)
LOOP_FIELDS = ("bn", "legal_name", "score", "total_loops", "max_bottleneck", "total_circular_amt")

# Parts a large entity is spread over while its agreements are dealt to pages.
SALTS = 64

# Rows a seed look-up keeps of each kind.
SEED_LIMITS = {"golden": 5, "loops": 5, "agreements": 100, "violations": 10}

# Profile fields that add up to external funding.
FUNDING_FIELDS = (
    ("fed_profile", "total_grants"),
    ("ab_profile", "total_grants"),
    ("ab_profile", "total_contracts"),
    ("ab_profile", "total_sole_source"),
)


def or_empty(name: str, typed_by: DataFrame) -> Column:
    """The array column, or an empty array of its type where it is NULL."""
    return F.coalesce(F.col(name), F.array().cast(typed_by.schema[name].dataType)).alias(name)


def match_grants(entities: DataFrame, grants: DataFrame, by_root: bool = False) -> DataFrame:
    """Grants of each entity: by business number, or by name for entities that have none.

    The two cases exclude each other, so the OR becomes a union of two equi-joins. Numbers match as
    written; by_root matches their nine-digit roots, so that program accounts of one number count.
    """
    e = entities.select(F.col("id").alias("entity_id"), matching_number("bn_root", by_root).alias("bn_root"), "canonical_name")
    by_number = e.filter(F.col("bn_root").isNotNull()).select("entity_id", "bn_root")
    by_name = e.filter(F.col("bn_root").isNull()).select("entity_id", F.lower("canonical_name").alias("name_key"))
    numbered = grants.filter(F.col("recipient_business_number").isNotNull())
    named = grants.filter(F.col("recipient_legal_name").isNotNull())
    on_number = numbered.join(by_number, matching_number(numbered["recipient_business_number"], by_root) == by_number["bn_root"]).drop("bn_root")
    on_name = named.withColumn("name_key", F.lower("recipient_legal_name")).join(by_name, "name_key").drop("name_key")
    return on_number.unionByName(on_name)


def entity_agreements(entities: DataFrame, grants: DataFrame) -> DataFrame:
    """Current agreements of each entity, latest among the entity's own rows."""
    keys = [
        F.col("entity_id"),
        F.col("ref_number"),
        recipient_partition_key("recipient_business_number", "recipient_legal_name", "_id"),
    ]
    return current_version(match_grants(entities, grants), keys=keys).select("entity_id", *AGREEMENT_FIELDS)


# The distinct values that a summary tells, by the name of their list.
LISTS = {"departments": "owner_org_title", "programs": "prog_name_en", "countries": "recipient_country", "provinces": "recipient_province"}
# Registers of the distinct-count sketch, as a power of two: counts up to some 300 come out exact, larger
# ones with a standard error of 1.04 / sqrt(4096), that is 1.6 %. A sketch has at most 4 KB.
SKETCH_BITS = 12


def fed_summary(agreements: DataFrame, by: Sequence[str] = ("entity_id",), lists: bool = True) -> DataFrame:
    """Totals, date span and distinct values over agreements that carry a value; rows counts all of them.

    Without lists each of them is a count of its distinct values from a sketch, so that a row's size is fixed;
    the values themselves are then rows of value_pages.
    """
    def valued(c: str) -> Column:
        return F.when(F.col("agreement_value").isNotNull(), F.col(c))

    def distinct(c: str) -> Column:
        if not lists:
            return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(valued(c), SKETCH_BITS)), F.lit(0))
        return F.sort_array(F.collect_set(valued(c)))

    grouped = agreements.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.sum("agreement_value").alias("total_current_commitment"),
        F.count("agreement_value").alias("agreement_count"),
        F.min(valued("agreement_start_date")).alias("earliest_start"),
        F.max(valued("agreement_end_date")).alias("latest_end"),
        *[distinct(c).alias(name) for name, c in LISTS.items()],
    )
    fields = F.struct(*[c for c in grouped.columns if c not in (*by, "rows")])
    return grouped.select(*by, "rows", F.when(F.col("agreement_count") > 0, fields).alias("fed_summary"))


def value_pages(agreements: DataFrame, by: Sequence[str] = ("entity_id",), page_values: int = 1000) -> DataFrame:
    """(by, list, page, values): the distinct values of each summary list, about page_values a row at most, sorted inside a page.

    Exact at any number of values. A value's page follows from its hash, so no list is ever held whole.
    """
    told = F.array(*[F.struct(F.lit(name).alias("list"), F.col(c).cast("string").alias("value")) for name, c in LISTS.items()])
    rows = agreements.filter(F.col("agreement_value").isNotNull()).select(*by, F.inline(told)).filter(F.col("value").isNotNull())
    rows = distinct_keys(rows, *by, "list", "value")
    key = [*by, "list"]
    large = reduce_by(rows, key, F.ceil(F.count("*") / page_values).cast("int").alias("pages")).filter("pages > 1")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = salted.join(large, [*key, "salt"], "left").withColumn("page", F.pmod(F.xxhash64("value", F.lit(1)), F.coalesce("pages", F.lit(1))).cast("int"))
    return placed.groupBy(*key, "page").agg(F.sort_array(F.collect_list("value")).alias("values"))


def top_loops(entities: DataFrame, loops: DataFrame, k: int = 5) -> DataFrame:
    """Loops of each entity by score, the k highest."""
    e = entities.filter(F.col("bn_root").isNotNull()).select(F.col("id").alias("entity_id"), F.col("bn_root").alias("bn"))
    w = Window.partitionBy("entity_id").orderBy(F.col("score").desc_nulls_last(), F.col("total_loops").desc_nulls_last(), "legal_name")
    joined = loops.select(*LOOP_FIELDS).join(e, "bn")
    return joined.withColumn("loop_rank", F.row_number().over(w)).filter(F.col("loop_rank") <= k)


class Dossiers(NamedTuple):
    """heads: one row per entity. pages: one row per entity and page, each with its share of the agreements."""

    heads: DataFrame
    pages: DataFrame


def entity_dossier(
    entities: DataFrame,
    grants: DataFrame,
    violations: DataFrame,
    loops: DataFrame,
    ids: DataFrame | None = None,
    keep_empty: bool = False,
    page_rows: int = 10_000,
    stages: Stages | None = None,
    lists: bool = True,
) -> Dossiers:
    """Dossier of each entity as two tables that have the same shape at every size.

    heads has entity_id, entity, fed_summary, violations, loops and the number of pages; pages has
    entity_id, page and agreements, about page_rows of them at most, so no row or group grows with the
    table. An entity without any agreement has a head with no page, and that only with keep_empty.
    stages owns the tables of agreements and heads, which several readers share. Without lists, heads have a
    fixed size whatever the number of distinct departments or programs, and value_pages has the values.
    """
    if ids is not None:
        entities = entities.join(distinct_keys(ids, "id"), "id", "left_semi")
    stages = stages or stages_of(entities.sparkSession)
    agreements = stages.add(entity_agreements(entities, grants))
    summary = fed_summary(agreements, lists=lists).withColumn("pages", F.ceil(F.col("rows") / page_rows).cast("int")).drop("rows")
    return Dossiers(stages.add(_heads(entities, summary, violations, loops, keep_empty)), _pages(agreements, page_rows))


def _heads(entities: DataFrame, summary: DataFrame, violations: DataFrame, loops: DataFrame, keep_empty: bool) -> DataFrame:
    loop_rows = top_loops(entities, loops).groupBy("entity_id").agg(
        F.sort_array(F.collect_list(F.struct("loop_rank", *LOOP_FIELDS))).alias("loops")
    )
    head = entities.select(F.col("id").alias("entity_id"), F.col("bn_root").alias("_bn"), F.struct(*entities.columns).alias("entity"))
    known = head.join(summary, "entity_id", "left" if keep_empty else "inner").join(loop_rows, "entity_id", "left")
    counts = violation_counts(violations).select(F.col("bn").alias("_bn"), F.struct("bn", "arithmetic_violations").alias("violations"))
    # Entities without a number look nothing up, and would only gather on NULL.
    numbered = known.filter(F.col("_bn").isNotNull()).join(counts, "_bn", "left")
    unnumbered = known.filter(F.col("_bn").isNull()).withColumn("violations", F.lit(None).cast(counts.schema["violations"].dataType))
    return numbered.unionByName(unnumbered).select(
        "entity_id", F.coalesce("pages", F.lit(0)).alias("pages"), "entity", "fed_summary", "violations", or_empty("loops", loop_rows)
    )


def _pages(agreements: DataFrame, page_rows: int) -> DataFrame:
    """Only entities of several pages are looked up, under a salt.

    Placed by entity alone, the rows would already lie where a grouping by entity and page wants them,
    and a large entity's pages would all be built in one task.
    """
    sizes = reduce_by(agreements, ["entity_id"], F.count("*").alias("rows")).filter(F.col("rows") > page_rows)
    large = sizes.select(
        "entity_id", F.ceil(F.col("rows") / page_rows).cast("int").alias("large"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    key = F.xxhash64("_id", "ref_number")
    salted = agreements.withColumn("salt", F.pmod(key, F.lit(SALTS)).cast("int")).join(large, ["entity_id", "salt"], "left")
    placed = salted.withColumn("page", F.pmod(F.xxhash64("ref_number", "_id"), F.coalesce("large", F.lit(1))).cast("int"))
    return placed.groupBy("entity_id", "page").agg(F.sort_array(F.collect_list(F.struct(*AGREEMENT_FIELDS))).alias("agreements"))


def nest_dossiers(dossiers: Dossiers) -> DataFrame:
    """One document per page, each with its entity's head; an entity without pages has one with no agreements.

    Heads meet pages last, as an inner join of two plain shuffles, so that an entity with very many
    pages is split over tasks.
    """
    heads, pages = dossiers
    nested = pages.join(heads, "entity_id")
    bare = heads.filter("pages = 0").withColumn("page", F.lit(0)).withColumn("agreements", F.array().cast(pages.schema["agreements"].dataType))
    return nested.unionByName(bare).select("entity_id", "page", "pages", "entity", "fed_summary", "agreements", "violations", "loops")


# --- seed look-ups ----------------------------------------------------------------------------

# Lengths of the parts by which names are listed. A seed uses the greatest that its longest literal holds, so the parts
# of a seed say two thirds of the literal and more, and no part is common just because it is short.
GRAMS = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32, 48, 64)


def _literal(pattern: str) -> Column:
    """The longest part of a pattern without wildcards; the first of those."""
    parts = F.split(F.lower(F.col(pattern)), "[%_]")
    return F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))


def _grams(text: Column, size: int) -> Column:
    """Hashes of the distinct parts of a length; a shorter text has none."""
    if not size:
        return F.array(F.xxhash64(F.lit("")))
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    hashed = F.array_distinct(F.transform(starts, lambda at: F.xxhash64(F.substring(text, at, F.lit(size)))))
    return F.when(F.length(text) >= size, hashed).otherwise(F.array().cast("array<long>"))


def name_matches(names: DataFrame, seeds: DataFrame, stages: Stages | None = None) -> DataFrame:
    """(name, seed) wherever a lower-case name of the one column of names contains a seed, % and _ matching as in LIKE.

    A posting list holds (part's hash, name's hash): the parts of every distinct name, of the few lengths that the
    seeds use. A name that contains a seed also contains each part of the seed's longest literal, so the two meet
    on the one of these that fewest names have, and LIKE confirms. Parts grow with the literal, for three letters are
    in a fixed share of the names and would meet names times seeds. A name has at most its length times the lengths used.
    """
    stages = stages or stages_of(names.sparkSession)
    column = names.columns[0]
    names = stages.add(distinct_keys(names.filter(F.col(column).isNotNull()).select(F.col(column).alias("name")), "name")
                       .select("name", F.xxhash64("name").alias("h")))
    near = _near(names, seeds, stages).join(names, "h")
    like = F.like(F.col("name"), F.lower(F.concat(F.lit("%"), "seed", F.lit("%"))))
    plain = ~F.col("seed").rlike(r"[%_\\]")
    return stages.add(near.filter(F.when(plain, F.contains("name", F.lower("seed"))).otherwise(like)).select("name", "seed").distinct())


def _near(names: DataFrame, seeds: DataFrame, stages: Stages) -> DataFrame:
    """(h, seed) wherever a name of names(name, h) holds the rarest part of a seed."""
    wanted = distinct_keys(seeds.select(F.col("name").alias("seed")).filter(F.col("seed").isNotNull()), "seed")
    length = F.length("_literal")
    held = F.greatest(F.lit(0), *[F.when(length >= n, n) for n in GRAMS])
    sized = wanted.withColumn("_literal", _literal("seed")).withColumn("_size", held)
    sizes = sorted(r["_size"] for r in sized.select("_size").distinct().collect())  # at most GRAMS and 0
    if not sizes:
        return names.limit(0).select("h", F.col("name").alias("seed"))
    posted = names.select("h", F.explode(F.concat(*[_grams(F.col("name"), n) for n in sizes])).alias("part"))
    own = F.concat(*[F.when(F.col("_size") == n, _grams(F.col("_literal"), n)).otherwise(F.array().cast("array<long>")) for n in sizes])
    asked = sized.select("seed", F.explode(own).alias("part"))
    common = posted.groupBy("part").agg(F.count("*").alias("n"))
    # A part that no name has rules its seed out.
    rare = asked.join(common, "part", "left").groupBy("seed", spread("seed")).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("part").alias("part"))).alias("least"))
    keyed = stages.add(rare.filter("least.n > 0").select("seed", F.col("least.part").alias("part")))
    return posted.join(keyed, "part").select("h", "seed")


def _wanted(seeds: DataFrame, by_root: bool = False) -> DataFrame:
    return seeds.select(F.col("name").alias("seed"), matching_number("bn", by_root).alias("_seed_bn")).filter(F.col("seed").isNotNull()).distinct()


def _by_name(df: DataFrame, matches: DataFrame, name: str) -> DataFrame:
    """Rows with each seed that their name contains, and what else matches tell."""
    return df.join(matches.withColumnRenamed("name", "_name"), F.lower(F.col(name)) == F.col("_name")).drop("_name")


def _by_number(df: DataFrame, wanted: DataFrame, bn: str, by_root: bool = False) -> DataFrame:
    """Rows with each seed whose number is theirs."""
    return df.join(wanted.filter(F.col("_seed_bn").isNotNull()), matching_number(bn, by_root) == F.col("_seed_bn"))


def match_seeds(df: DataFrame, seeds: DataFrame, name: str, bn: str | None = None, by_root: bool = False,
                matches: DataFrame | None = None, stages: Stages | None = None) -> DataFrame:
    """Rows whose name contains a seed's name (any case, % and _ match as in LIKE) or whose number equals the seed's.

    seeds(name, bn) may be of any length. Names meet on the matches of name_matches, which several tables may
    share; numbers meet by equality. Whole rows take part in nothing but these two equi-joins.
    """
    if matches is None:
        matches = name_matches(df.select(F.lower(F.col(name)).alias("name")), seeds, stages)
    wanted = _wanted(seeds, by_root)
    named = _by_name(df, matches.join(wanted, "seed"), name)
    if bn is None:
        return named.drop("_seed_bn")
    same = matching_number(bn, by_root) == F.col("_seed_bn")
    return _by_number(df, wanted, bn, by_root).unionByName(named.filter(~F.coalesce(same, F.lit(False)))).drop("_seed_bn")


def _times(df: DataFrame, count: str, most: int) -> DataFrame:
    """Each row as often as it counts, most times at most."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.least(F.col(count), F.lit(most)).cast("int")))).drop("_copy", count)


def _top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy("seed").orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def seed_dossiers(
    seeds: DataFrame,
    entities: DataFrame,
    grants: DataFrame,
    violations: DataFrame,
    loops: DataFrame,
    limits: dict[str, int] = SEED_LIMITS,
    stages: Stages | None = None,
) -> dict[str, DataFrame]:
    """For every row of seeds(name, bn): matching entities, their loops and violations, and matching current agreements.

    The names of both tables make one list of distinct names that meets the seeds once. Seeds of one name and
    several numbers count each; they are carried as a number, and only as many copies as a list can hold are made of a row.
    """
    stages = stages or stages_of(entities.sparkSession)
    known = entities.select(F.lower("canonical_name").alias("name")).unionByName(grants.select(F.lower("recipient_legal_name").alias("name")))
    matches = name_matches(known, seeds, stages)
    wanted = _wanted(seeds)
    counted = matches.join(reduce_by(wanted, ["seed"], F.count("*").alias("_seeds")), "seed")
    by_name = _by_name(entities, counted, "canonical_name")
    by_number = _by_number(entities, wanted, "bn_root").drop("_seed_bn").withColumn("_name", F.lower("canonical_name"))
    by_number = by_number.join(matches.withColumnRenamed("name", "_name"), ["_name", "seed"], "left_anti").drop("_name")
    golden = by_number.withColumn("_seeds", F.lit(1).cast("long")).unionByName(by_name)
    golden = _top(_times(golden, "_seeds", limits["golden"]), [F.col("id")], limits["golden"])
    # two entities may share a number: each counts for its loops and violations, as in a plain join
    named = by_name.filter(F.col("bn_root").isNotNull()).groupBy("seed", F.col("bn_root").alias("bn")).agg(F.sum("_seeds").alias("entities"))
    named = stages.add(named)
    loop_rows = _top(
        _times(loops.select(*LOOP_FIELDS).join(named, "bn"), "entities", limits["loops"]),
        [F.col("score").desc_nulls_last(), F.col("total_loops").desc_nulls_last(), F.col("bn"), F.col("legal_name")],
        limits["loops"],
    )
    # a row found by name and by number, or by several numbers, is one row of its group
    found = _by_name(grants, matches, "recipient_legal_name").unionByName(_by_number(grants, wanted, "recipient_business_number").drop("_seed_bn"))
    keys = [F.col("seed"), F.col("ref_number"), recipient_partition_key("recipient_business_number", "recipient_legal_name", "_id")]
    agreements = _top(
        current_version(found, keys=keys),
        [F.col("agreement_value").desc_nulls_last(), F.col("_id")],
        limits["agreements"],
    )
    counted = violation_counts(violations).join(named, "bn").select(
        "seed", "bn", (F.col("arithmetic_violations") * F.col("entities")).alias("arithmetic_violations")
    )
    violation_rows = _top(counted, [F.col("bn")], limits["violations"])
    return {"golden": golden, "loops": loop_rows, "agreements": agreements, "violations": violation_rows}


def nest_seed_dossiers(seeds: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One nested document per seed; every list is bounded by the seed limits."""
    out = seeds.select(F.col("name").alias("seed"), F.col("bn").alias("seed_bn"))
    for name, part in parts.items():
        fields = [c for c in part.columns if c not in ("seed", "position")]
        listed = part.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("row")))).alias("rows"))
        listed = listed.select("seed", F.transform("rows", lambda r: r["row"]).alias(name))
        out = out.join(listed, "seed", "left")
        out = out.withColumn(name, or_empty(name, listed))
    return out


# --- postal code roll-ups ---------------------------------------------------------------------


def external_funding() -> Column:
    """Sum of the funding fields at their full scale; a field that is absent or no number adds nothing."""
    total = F.lit(0).cast("decimal(38,6)")
    for profile, field in FUNDING_FIELDS:
        total = (total + F.coalesce(json_number(profile, field), F.lit(0).cast("decimal(38,6)"))).cast("decimal(38,6)")
    return total


def unreadable_funding() -> Column:
    """How many funding fields are there but can't be read as a number, so that their sum is known to be short."""
    def lost(profile: str, field: str) -> Column:
        there = F.get_json_object(F.col(profile), f"$.{field}").isNotNull()
        return F.when(there & json_number(profile, field).isNull(), 1).otherwise(0)

    return sum((lost(p, f) for p, f in FUNDING_FIELDS), F.lit(0))


def postal_lookup(entities: DataFrame, postal_code: str, limit: int = 50) -> DataFrame:
    """Entities with an address in a postal code, best funded first."""
    return (
        entities.filter(any_address_in("addresses", F.lit(postal_code)))
        .select("id", "canonical_name", "bn_root", "dataset_sources", external_funding().alias("total_external_funding"))
        .orderBy(F.col("total_external_funding").desc(), "id")
        .limit(limit)
    )


def postal_rollup(entities: DataFrame, limit: int = 50) -> DataFrame:
    """The same for all postal codes at once: each code's best funded entities."""
    codes = F.array_distinct(F.transform("addresses", lambda a: normalize_postal(a["postal_code"])))
    spread = entities.select(
        "id", "canonical_name", "bn_root", external_funding().alias("total_external_funding"), F.explode(codes).alias("postal_code")
    ).filter(F.col("postal_code").isNotNull())
    w = Window.partitionBy("postal_code").orderBy(F.col("total_external_funding").desc(), "id")
    return spread.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def postal_totals(entities: DataFrame) -> DataFrame:
    """Entities and funding per postal code, over everything."""
    codes = F.array_distinct(F.transform("addresses", lambda a: normalize_postal(a["postal_code"])))
    spread = entities.select(external_funding().alias("funding"), F.explode(codes).alias("postal_code"))
    return spread.filter(F.col("postal_code").isNotNull()).groupBy("postal_code").agg(
        F.count("*").alias("entities"), F.sum("funding").alias("total_external_funding")
    )
