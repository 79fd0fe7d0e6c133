"""Embedding near duplicates by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), nearest first. Close vectors share
most of them. Inverted lists hold, for each pair of pivots, the vectors that have both among their
nearest, so two vectors meet in a list just if they share at least two pivots. Vectors that meet are
compared by cosine in double precision; a pair that shares more pivots is counted only in the list of
the first two. Lists of any length are cut into blocks and compared block by block, so no task holds
more than two blocks. Each task returns a count and a root per vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, forest, lowest, stage


class Index(NamedTuple):
    """512 pivots and 7 nearest find 98 of 100 random pairs at a cosine of just 0.9 in 64 dimensions, and all at 0.98."""

    pivots: int = 512
    nearest: int = 7
    #: Vectors from which the pivots are chosen, each as far as possible from those before it.
    sample: int = 4096
    block: int = 2048


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares stay in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled ** 2).sum(axis=1, keepdims=True))


def apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` of the rows, each the one that is least like all rows chosen before."""
    chosen, like = [0], vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)):
        best = int(like.argmin())
        if like[best] > 1 - 1e-9:
            break
        chosen.append(best)
        like = np.maximum(like, vectors @ vectors[best])
    return vectors[chosen]


def choose_pivots(classes: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """Pivots by dimension, from a bounded sample in the order of a hash."""
    hashed = classes.select("vec", F.xxhash64("vec").alias("h"))
    rows = hashed.where(lowest(F.col("h"), index.sample, classes.count())).orderBy("h", "vec").limit(index.sample).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r.vec), []).append(r.vec)
    return {size: apart(unit(np.array(vs, np.float64)), index.pivots) for size, vs in by_size.items()}


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :count]


def listed(classes: DataFrame, pivots: dict[int, np.ndarray], index: Index) -> DataFrame:
    """(size, p, q, cid, n, vec, near): every class in each of its lists. Sizes without pivots have one list of their own."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, n = batch.column(0), batch.column(1)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = batch.column(2).offsets.to_numpy()
            sizes = np.diff(ends)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                raw = flat[(ends[own] - ends[0])[:, None] + np.arange(size)]
                points = pivots.get(size)
                near = np.empty((len(own), 0), np.int64) if points is None else nearest_pivots(unit(raw.astype(np.float64)), points, index.nearest)
                low = np.sort(near, axis=1).astype("<i4")
                pairs = list(combinations(range(low.shape[1]), 2)) or [None]
                for pair in pairs:
                    p, q = (np.full(len(own), -1, np.int32),) * 2 if pair is None else (low[:, pair[0]], low[:, pair[1]])
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), size, np.int32)), pa.array(p), pa.array(q), cid.take(take), n.take(take),
                         pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([v.tobytes() for v in low], pa.binary())],
                        ["size", "p", "q", "cid", "n", "vec", "near"])

    return classes.select("cid", "n", "vec").mapInArrow(rows, "size int, p int, q int, cid long, n long, vec binary, near binary")


def compare(i: int, j: int, p: int, chunk: np.ndarray, vectors: np.ndarray, near: np.ndarray, n: np.ndarray, cosine: float,
            q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight of each row, and the edges, of blocks i and j of the list (p, q)."""
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    a, b = np.nonzero(vectors[left] @ vectors[right].T >= cosine)
    a, b = left[a], right[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    if p >= 0 and len(a):
        first = np.ones(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            shared = (near[a[part]][:, :, None] == near[b[part]][:, None, :]).any(axis=2)
            order = np.cumsum(shared, axis=1)
            ids = near[a[part]]
            one, two = ids[np.arange(len(ids)), (order >= 1).argmax(axis=1)], ids[np.arange(len(ids)), (order >= 2).argmax(axis=1)]
            first[part] = (one == p) & (two == q)
        a, b = a[first], b[first]
    weight = np.bincount(a, n[b], len(n)) + np.bincount(b, n[a], len(n))
    return weight.astype(np.int64), a, b


def verified(lists: DataFrame, cosine: float, index: Index, kind: str) -> DataFrame:
    """(cid, links, root): per list and class with links there, the rows linked and the smallest class tied to it."""
    keys = ["size", "p", "q"]
    long = lists.groupBy(*keys).agg(F.count("*").alias("members")).where(F.col("members") > index.block)
    long = long.select(*keys, F.ceil(F.col("members") / index.block).cast("int").alias("blocks"))  # one row per pair of pivots at most
    cut = lists.join(F.broadcast(long), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = cut.withColumn("other", other).select(*keys, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                                                  "chunk", "cid", "n", "vec", "near")
    keys = [*keys, "i", "j"]

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        key = np.stack([table.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        stops = np.r_[starts[1:], table.num_rows]
        cid, n, chunk = (table.column(c).to_numpy() for c in ("cid", "n", "chunk"))
        vec, near = table.column("vec").combine_chunks(), table.column("near").combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(starts.tolist(), stops.tolist(), strict=True):
            if hi - lo < 2:
                continue
            _, p, q, i, j = key[:, lo].tolist()
            raw = np.frombuffer(b"".join(vec[lo:hi].to_pylist()), kind).reshape(hi - lo, -1)
            ids = np.frombuffer(b"".join(near[lo:hi].to_pylist()), "<i4").reshape(hi - lo, -1)
            weight, a, b = compare(i, j, p, chunk[lo:hi], unit(raw.astype(np.float64)), ids, n[lo:hi], cosine, q)
            if len(a):
                names, order = np.unique(cid[lo:hi], return_inverse=True)
                root = forest(order[a], order[b], len(names))
                some = np.flatnonzero(weight)
                out.append((cid[lo:hi][some], weight[some], names[root[order[some]]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["cid", "links", "root"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and sum(b.num_rows for b in held) >= 8 * index.block:
                last = [held[-1].column(k)[-1] for k in keys]
                cut_at = 0
                while cut_at < batch.num_rows and [batch.column(k)[cut_at] for k in keys] == last:
                    cut_at += 1
                held.append(batch.slice(0, cut_at))
                if cut_at < batch.num_rows:
                    yield from solve(held)
                    held = [batch.slice(cut_at)]
            else:
                held.append(batch)
        if held:
            yield from solve(held)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(rows, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, index: Index = Index(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) per row of vectors.

    A pair is linked if its cosine is at least the bound and the index finds it; no other pair ever is.
    Equal vectors are compared once and count as rows. Vectors that are null, zero or hold a null or
    non-finite component, and vectors of different lengths, link with nothing. Rows without a key link
    and count but name no component; a component of such rows alone has a null id, and they aren't kept.
    """
    real = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vec"))
    good = real.where(usable(F.col("vec")))
    grouped = good.groupBy("vec").agg(F.min("key").alias("low"), F.count("*").alias("n"))
    classes = stage(grouped.select(F.monotonically_increasing_id().alias("cid"), "vec", "low", "n"), "vectors")
    kind = "<f4" if classes.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8"
    pivots = choose_pivots(classes, index)
    found = stage(verified(listed(classes, pivots, index), cosine, index, kind), "found")
    tied = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = classes.select("cid", "low", "n").join(links, "cid", "left").join(tied, F.col("cid") == F.col("node"), "left")
    told = stage(told.select("cid", "low", F.coalesce("component", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "told")
    lows = told.groupBy("root").agg(F.min("low").alias("component"))
    named = told.join(lows, "root").join(classes.select("cid", F.col("vec").alias("v")), "cid").select("v", "n_links", "component")
    named = stage(named, "named")
    discard(found, told, classes)
    both = real.join(named, F.col("vec") == F.col("v"), "left")
    component = F.when(F.col("v").isNull(), F.col("key")).otherwise(F.col("component"))
    return both.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
