"""Chains of tokens over all their generations: root, depth, and chains that never end.

A token names its parent by the parent's hash. Following one parent at a time takes a join per
generation; here every round joins a token to its ancestor's ancestor, so the distance covered doubles
and the rounds grow with the logarithm of the longest chain. A token whose jump ends at a root is
settled and takes no further part. As long as tokens with an end are left, each round settles some: the
first round that settles none leaves just the tokens whose ancestors form a cycle.

Rounds read and write (hash, ancestor's hash, distance), never whole tokens. Both sides of their joins
are tables in the shared folder, so a parent with very many children is a skewed partition that adaptive
execution splits.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages, stages_of
from .skew import distinct_keys, reduce_by


def links(tokens: DataFrame, token: str = "proofToken") -> DataFrame:
    """(proof_id, token_hash, previous_hash) per token; an empty hash counts as none."""
    t = F.col(token)
    audit = t["tiers"]["audit"]
    return tokens.select(
        t["proofId"].alias("proof_id"),
        F.nullif(audit["tokenHash"], F.lit("")).alias("token_hash"),
        F.nullif(audit["previousTokenHash"], F.lit("")).alias("previous_hash"),
    )


def ancestors(named: DataFrame, stages: Stages) -> DataFrame:
    """(hash, root, distance) from (hash, previous): the hash at the end of each chain; both NULL where a cycle is reached.

    Every hash once. A previous hash that no row carries ends the chain at the row that names it.
    """
    known = distinct_keys(named.select(F.col("hash").alias("previous")), "previous").withColumn("known", F.lit(True))
    asks = named.filter("previous IS NOT NULL").join(known, "previous", "left")
    ends = named.filter("previous IS NULL").withColumn("known", F.lit(None).cast("boolean"))
    inner = F.coalesce("known", F.lit(False))
    first = asks.unionByName(ends).select(
        "hash", F.when(inner, F.col("previous")).otherwise(F.col("hash")).alias("jump"), F.when(inner, 1).otherwise(0).cast("long").alias("far"), (~inner).alias("settled")
    )
    table = stages.add(first)
    done, active = [table.filter("settled")], table.filter("NOT settled")
    while active.count():
        target = functools.reduce(DataFrame.unionByName, done, active).select(
            F.col("hash").alias("jump"), F.col("jump").alias("to"), F.col("far").alias("more"), "settled"
        )
        doubled = active.select("hash", "jump", "far").join(target, "jump")
        table = stages.add(doubled.select("hash", F.col("to").alias("jump"), (F.col("far") + F.col("more")).alias("far"), "settled"))
        newly, active = table.filter("settled"), table.filter("NOT settled")
        if newly.isEmpty():
            break
        done.append(newly)
    found = functools.reduce(DataFrame.unionByName, done).select("hash", F.col("jump").alias("root"), F.col("far").alias("distance"))
    endless = active.select("hash", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("distance"))
    return found.unionByName(endless)


def chain_generations(tokens: DataFrame, token: str = "proofToken", stages: Stages | None = None) -> DataFrame:
    """(proof_id, previous_hash, root_id, depth, parent_found, cyclic) of every token.

    A token without a parent, or whose parent is not there, is a root: depth 0, its own root_id. Where several
    tokens carry one hash, the one with the smallest id is the parent. A token on a cycle, or below one, has no
    root and no depth and is cyclic. Repeated tokens give repeated rows.
    """
    stages = stages or stages_of(tokens.sparkSession)
    flat = stages.add(links(tokens, token))
    # The parent that a hash stands for, first by id; a token without an id can be one too.
    pick = F.min_by(F.struct("proof_id", "previous_hash"), F.struct(F.col("proof_id").isNull(), "proof_id", F.col("previous_hash").isNull(), "previous_hash"))
    named = stages.add(reduce_by(flat.filter("token_hash IS NOT NULL"), ["token_hash"], pick.alias("one"))
                       .select(F.col("token_hash").alias("hash"), F.col("one.previous_hash").alias("previous"), F.col("one.proof_id").alias("proof_id")))
    found = ancestors(named.select("hash", "previous"), stages)
    names = named.select(F.col("hash").alias("root"), F.col("proof_id").alias("root_id"))
    placed = found.join(names, "root", "left").select(F.col("hash").alias("previous_hash"), "root_id", "distance", F.col("root").isNull().alias("cyclic"))
    children = flat.filter("previous_hash IS NOT NULL").join(placed, "previous_hash", "left")
    there = F.col("cyclic").isNotNull()
    told = children.select(
        "proof_id", "previous_hash",
        F.when(there, F.col("root_id")).otherwise(F.col("proof_id")).alias("root_id"),
        F.when(there, F.col("distance") + 1).otherwise(F.lit(0)).alias("depth"),
        there.alias("parent_found"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )
    roots = flat.filter("previous_hash IS NULL").select(
        "proof_id", "previous_hash", F.col("proof_id").alias("root_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("boolean").alias("parent_found"), F.lit(False).alias("cyclic"),
    )
    return roots.unionByName(told)


def chain_summary(generations: DataFrame) -> DataFrame:
    """(root_id, tokens, generations, dangling) per chain; tokens of cycles are left out."""
    own = generations.filter("NOT cyclic")
    return own.groupBy("root_id").agg(
        F.count("*").alias("tokens"), (F.max("depth") + 1).alias("generations"),
        F.coalesce(F.bool_or(F.col("depth").eqNullSafe(0) & ~F.coalesce("parent_found", F.lit(True))), F.lit(False)).alias("dangling"),
    )
