"""Hard negatives and clusters against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlens.llm import centroids, negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(vec, scale):
    if vec is None or any(x is None or not math.isfinite(x) for x in vec):
        return None
    return [math.floor(scale * x) for x in vec]


# --- hard negatives ---------------------------------------------------------------------------


def brute_negatives(rows, every=10):
    live = [(i, whole(v, 256), c) for i, v, c in rows if i is not None and c is not None]
    live = [(i, v, c) for i, v, c in live if v is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, v, c in live:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, d) for j, w, d in live if len(w) == len(v))
        for p, j, _ in [r for r in scored if r[2] == c and r[1] != i][:5]:
            fits = [r for r in scored if r[2] != c and 80 * -p <= 100 * -r[0] <= 100 * -p]
            yield from ((i, j, rank + 1, other, -p, -n) for rank, (n, other, _) in enumerate(fits[:5]))


def mined(df, grid=negatives.Grid(), every=10):
    got = negatives.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), grid=grid)
    assert dict(got.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in got.collect())


SMALL = negatives.Grid(group_bytes=256, part_rows=40, least_rows=10, block_anchors=3, block_rows=7)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_of_random_rows(spark, seed):
    rng = np.random.default_rng(seed)
    size = 6
    centre = rng.normal(size=(4, size))
    rows = [(k, (centre[k % 4] + rng.normal(scale=0.6, size=size)).round(1).tolist(), int(rng.integers(3))) for k in range(150)]
    rows += [(k, rows[3][1], int(rng.integers(3))) for k in range(150, 220)]  # copies: equal scores, smaller ids first
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(brute_negatives(rows))
    assert len(want) > 50
    assert mined(df) == want
    assert mined(df, SMALL) == want  # many groups, parts and blocks: the same rows


def test_negatives_edge_cases(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.0], 3), (4, None, 2), (5, [float("nan"), 1.0], 2), (6, [None, 1.0], 2),
        (7, [0.9, 0.0], None), (None, [0.9, 0.0], 2), (8, [1.0], 2), (9, [1.0], 1), (10, [1.0], 2), (20, [-1.0, 0.0], 5), (21, [1.0, 0.0], 5),
        (30, [float("inf"), 0.0], 1), (40, [], 1), (41, [], 1), (42, [], 2), (50, [0.0, 0.0], 7), (51, [0.0, 0.0], 7), (60, [0.5, 0.5], 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "'x' AS number", "0 AS asks", "2 AS slot")
    assert mined(df) == sorted(brute_negatives(rows))
    repeated = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2)]
    assert mined(spark.createDataFrame(repeated, SCHEMA)) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 2, 65536, 58880)]
    assert mined(df.limit(0)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []  # no anchor


def test_negatives_of_large_components(spark):
    """Scores beyond the exact range of floating point; a vector whose scores no long holds takes no part."""
    rng = random.Random(4)
    rows = [(k, [rng.choice([1e6, 1e6 + 1 / 256, -3e5, 12345.0625]) for _ in range(4)], k % 2) for k in range(30)]
    assert mined(spark.createDataFrame(rows + [(70, [1e300] * 4, 0), (71, [1e18] * 4, 1)], SCHEMA)) == sorted(brute_negatives(rows))


def test_slots_answer_all_windows():
    rng = np.random.default_rng(0)
    limits = np.array([[90, 70, 50], [40, negatives.NONE, negatives.NONE]])
    best, offered = negatives.Best(limits, 2), []
    for at in range(0, 300, 25):
        anchor, score = np.sort(rng.integers(0, 2, 25)), rng.integers(-20, 95, 25)
        keep = score <= limits[anchor, 0]
        best.offer(anchor[keep], score[keep], np.arange(at, at + 25)[keep])
        offered += list(zip(anchor[keep].tolist(), score[keep].tolist(), range(at, at + 25)[:0] or np.arange(at, at + 25)[keep].tolist(), strict=True))
    found = list(zip(*[c.tolist() for c in best.found()], strict=True))
    for a in range(2):
        for j, limit in enumerate(limits[a].tolist()):
            if limit == negatives.NONE:
                continue
            suffix = sorted((s, -n, i) for b, s, n, i in found if b == a and s >= j)
            want = sorted((-n, i) for b, n, i in offered if b == a and n <= limit)
            assert [(n, i) for _, n, i in suffix][:2] == want[:2]


# --- clusters ---------------------------------------------------------------------------------


def brute_clusters(rows, size, clusters=8, rounds=10):
    live = [(i, whole(v, 1024)) for i, v, _ in rows]
    live = [(i, v) for i, v in live if v is not None and len(v) == size and max(map(abs, v)) < centroids.TOO_LARGE]
    seeds = sorted(live, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    mid = [list(v) for _, v in seeds]
    far = lambda v, m: sum((x - y) ** 2 for x, y in zip(v, m, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(mid)), key=lambda c: (far(v, mid[c]), c)) for _, v in live]
        if step < rounds:
            for c in range(len(mid)):
                held = [v for (_, v), o in zip(live, own, strict=True) if o == c]
                if held:
                    mid[c] = [sum(col) // len(held) for col in zip(*held, strict=True)]
    dist = [far(v, mid[o]) for (_, v), o in zip(live, own, strict=True)]
    for (i, _), o, d in zip(live, own, dist, strict=True):
        yield (i, o, d, sum(e for e, p in zip(dist, own, strict=True) if p == o), sum(dist), hashlib.sha256(",".join(map(str, mid[o])).encode()).hexdigest())


def clustered(df, **settings):
    return sorted((tuple(r) for r in centroids.report(centroids.cluster(df, centroids.Settings(**settings))).collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_clusters_of_random_rows(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(scale=0.2, size=5).round(2).tolist(), 0) for k in range(120)] + [(k, [0.1, -0.2, 0.3, 0.0, 0.0], 0) for k in range(120, 180)]
    assert clustered(spark.createDataFrame(rows, SCHEMA), size=5) == sorted(brute_clusters(rows, 5), key=repr)


def test_clusters_edge_cases(spark):
    rows = [
        (1, [0.1, 0.2], 0), (1, [0.1, 0.2], 0), (2, [0.1, 0.2], 0), (3, [0.5, -0.5], 0), (4, None, 0), (5, [None, 1.0], 0), (6, [float("nan"), 0.0], 0),
        (7, [1.0], 0), (8, [float("-inf"), 0.0], 0), (None, [0.4, -0.4], 0), (9, [1e12, 0.0], 0), (10, [-65535.0, 65535.0], 0), (11, [], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cluster", "'x' AS dots", "0 AS distance", "2 AS vec")
    assert clustered(df, size=2) == sorted(brute_clusters(rows, 2), key=repr)
    assert clustered(df, size=2, clusters=2, rounds=1) == sorted(brute_clusters(rows, 2, 2, 1), key=repr)
    assert clustered(df.limit(0), size=2) == [] and clustered(df, size=99) == []


def test_only_moved_components_are_multiplied():
    rng = np.random.default_rng(1)
    vec, before = rng.integers(-50, 50, (20, 6)), rng.integers(-50, 50, (3, 6))
    after = before.copy()
    after[0, 2] += 5
    after[2, [1, 4]] -= 3
    moves = centroids.moved(before, after)
    assert [(c, at.tolist()) for c, at, _ in moves] == [(0, [2]), (2, [1, 4])]
    assert (centroids.updated(vec @ before.T, vec, moves) == vec @ after.T).all()
