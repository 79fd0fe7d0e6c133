"""Chains over generations: roots, depths, lost parents, cycles."""

import random

from pyspark.sql import functions as F

from grantlens.operators import chains


def frame(spark, rows):
    """rows: (id, hash, previous hash)"""
    df = spark.createDataFrame(rows, "id string, h string, p string")
    audit = F.struct(F.col("h").alias("tokenHash"), F.col("p").alias("previousTokenHash"))
    return df.select(F.struct(F.col("id").alias("proofId"), F.struct(audit.alias("audit")).alias("tiers")).alias("proofToken"))


def told(df):
    return {r.proof_id: (r.root_id, r.depth, r.parent_found, r.cyclic) for r in chains.chain_generations(df).collect()}


def brute(rows):
    first = {}
    for i, h, p in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[2] is None, r[2] or "")):
        if h:
            first.setdefault(h, (i, p or None))
    out = {}
    for i, _, p in rows:
        p, depth, root, seen = p or None, 0, i, set()
        found = None if p is None else p in first
        while p in first and p not in seen:
            seen.add(p)
            root, p, depth = first[p][0], first[p][1], depth + 1
        cyclic = p in first
        out[i] = (None, None, found, True) if cyclic else (root, depth, found, False)
    return out


def test_edge_cases(spark):
    rows = [
        ("a", "A", None), ("b", "B", "A"), ("c", "C", "B"), ("d", "D", "B"), ("e", "E", ""),  # a tree and an unchained token
        ("f", "F", "lost"), ("g", "G", "F"),  # a parent nobody has
        ("x", "X", "Z"), ("y", "Y", "X"), ("z", "Z", "Y"), ("w", "W", "Z"), ("s", "S", "S"),  # a cycle, a token below it, its own parent
        ("m2", "M", "A"), ("m1", "M", None), ("n", "N", "M"),  # two tokens of one hash: the smaller id is the parent
        ("q", None, "C"), ("r", "", "C"),  # no hash of their own
    ]
    got = told(frame(spark, rows))
    assert got == brute(rows)
    assert got["n"] == ("m1", 1, True, False) and got["m2"] == ("a", 1, True, False)
    assert got["w"] == (None, None, True, True) and got["g"] == ("f", 1, True, False)
    summary = {r.root_id: (r.tokens, r.generations, r.dangling) for r in chains.chain_summary(chains.chain_generations(frame(spark, rows))).collect()}
    assert summary["a"] == (7, 4, False) and summary["f"] == (2, 2, True)
    assert told(frame(spark, rows).limit(0)) == {}
    assert chains.chain_generations(frame(spark, [("k", "K", None)] * 2)).count() == 2


def test_long_chain_takes_logarithmic_rounds(spark):
    rows = [(f"t{k:05d}", f"h{k}", f"h{k - 1}" if k else None) for k in range(5000)]
    random.Random(1).shuffle(rows)

    class Counting(chains.Stages):
        def add(self, df):
            for held in ("proofToken", "tiers"):
                assert held not in df.columns  # no round writes whole tokens
            return super().add(df)

    with Counting(spark) as stages:
        got = {r.proof_id: (r.root_id, r.depth) for r in chains.chain_generations(frame(spark, rows), stages=stages).collect()}
        assert len(stages.paths) <= 2 + 1 + 13
    assert got == {f"t{k:05d}": ("t00000", k) for k in range(5000)}


def test_random_forests(spark):
    rng = random.Random(5)
    rows = [(f"t{k}", f"h{k}", rng.choice([None, f"h{rng.randrange(400)}", f"h{rng.randrange(k + 1)}", f"h{max(0, k - 1)}", "none"])) for k in range(300)]
    assert told(frame(spark, rows)) == brute(rows)


def test_hot_parent(spark):
    rows = [("root", "R", None), ("hot", "H", "R")] + [(f"c{k}", f"C{k}", "H") for k in range(3000)]
    got = told(frame(spark, rows))
    assert all(got[f"c{k}"] == ("root", 2, True, False) for k in range(3000))
