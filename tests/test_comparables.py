"""Batch comparables against the pairwise definition, evaluated in plain Python."""

import random
from decimal import Decimal

import pytest

from grantlens.operators import comparables
from grantlens.operators.comparables import match_comparables, pick_sources
from grantlens.session import Stages

SCHEMA = "id bigint, ref string, program string, department string, value decimal(18,2), year int, described boolean"


def brute_force(rows, k):
    def best(r):
        return (r[4] is None, -(r[4] or 0), r[0])

    sources = {}
    for r in sorted((r for r in rows if r[1] is not None), key=best):
        sources.setdefault(r[1], r)
    out = {}
    for ref, s in sources.items():
        hits = []
        for c in rows:
            if c[1] is None or c[1] == ref or not c[6]:
                continue
            same = c[2] is not None and c[2] == s[2]
            band = c[4] is not None and s[4] is not None and s[4] * Decimal("0.5") <= c[4] <= s[4] * Decimal("1.5")
            years = c[5] is not None and s[5] is not None and abs(c[5] - s[5]) <= 5
            if same and band:
                tier = 1
            elif same and years:
                tier = 2
            elif c[3] is not None and c[3] == s[3]:
                tier = 3
            else:
                continue
            hits.append((tier, *best(c)))
        out[ref] = [(h[0], h[3]) for h in sorted(hits)[:k]]
    return {r: v for r, v in out.items() if v}


def make_rows(seed, n, refs, programs, values, years):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ref = None if rng.random() < 0.03 else f"R{min(rng.randrange(refs), rng.randrange(refs))}"
        rows.append((
            i, ref,
            None if rng.random() < 0.05 else f"P{min(rng.randrange(programs), rng.randrange(programs))}",
            None if rng.random() < 0.05 else f"D{rng.randrange(3)}",
            None if rng.random() < 0.05 else Decimal(rng.choice(values)),
            None if rng.random() < 0.05 else rng.choice(years),
            rng.random() < 0.8,
        ))
    return rows


CASES = {
    # few references, so that their own rows crowd each program
    "crowded_refs": (make_rows(1, 400, 6, 2, [str(v) for v in range(0, 90)], range(2000, 2020)), 3),
    # a handful of values shared by many rows
    "hot_values": (make_rows(2, 500, 80, 2, ["100", "100", "100", "150.01", "149.99", "50", "-5", "0"], range(1990, 2020)), 4),
    "spread": (make_rows(3, 600, 300, 8, [f"{v}.{v % 100:02d}" for v in range(1, 50000, 37)], range(1980, 2020)), 12),
    "one_ref": (make_rows(4, 40, 1, 1, ["10", "20"], [2001]), 3),
}


@pytest.mark.parametrize("case", CASES)
def test_matches_pairwise_definition(spark, case):
    rows, k = CASES[case]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in match_comparables(df, pick_sources(df), k).orderBy("source_ref", "position").collect():
        got.setdefault(r.source_ref, []).append((r.similarity_tier, r.id))
    assert got == brute_force(rows, k)


@pytest.mark.parametrize("case", CASES)
def test_small_cells_change_nothing(spark, monkeypatch, case):
    monkeypatch.setattr(comparables, "CELL_ROWS", 7)
    test_matches_pairwise_definition(spark, case)


def test_crowded_values_are_cut_evenly(spark, monkeypatch):
    """Nine in ten values lie within one per cent of each other; one value repeats; a second program is small."""
    monkeypatch.setattr(comparables, "CELL_ROWS", 500)
    rng = random.Random(9)
    values = [1_000_000 + rng.randrange(10_000) for _ in range(18_000)] + [rng.randrange(10**9) for _ in range(2_000)] + [1_004_000] * 40
    rows = spark.createDataFrame([("P", Decimal(v)) for v in values] + [("Q", Decimal(v)) for v in range(300)], "program string, value decimal(24,4)")
    with Stages(spark) as stages:
        celled = comparables._celled(stages.add(rows), stages)
        sizes = {(r.program, r.cell): (r["count"], r.low, r.high) for r in celled.selectExpr("*", "value AS v").groupBy("program", "cell").agg(
            *[f.alias(a) for f, a in ((comparables.F.count("*"), "count"), (comparables.F.min("v"), "low"), (comparables.F.max("v"), "high"))]).collect()}
    n, cells = len(values), 64
    assert sizes.pop(("Q", 0))[0] == 300
    assert len(sizes) == cells and max(c for c, _, _ in sizes.values()) <= n / cells + 2 * n * 0.0002 + 42
    ends = [sizes["P", c][1:] for c in range(cells)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))  # cells follow the values
