"""Hard negatives by slot-decomposed selection.

An anchor's negatives for a positive are the best-scored rows of other labels whose score lies in a
window below the positive's score. The windows of one anchor overlap. Their upper limits, largest
first, cut the scores into disjoint slots, so a row belongs to one slot, whatever the number of
windows. Tasks keep the first k rows per anchor and slot, the merge keeps the first k of those, and each
window is then answered from its own slot and those below it: the first k of that suffix, less the rows
below the window's lower limit. The positives are found by the same scan with one slot for all scores.

A scan is a grid. Anchors are dealt to groups of bounded bytes and rows to parts; a cell meets one
group with one part, rows streaming past the group in blocks. No cell depends on labels, so a label of a
third of all rows weighs like any other, and no pair leaves a task but the first k of a slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage

#: Scores are below 2^62 in size, so that limits fit a long beside them.
LEAST, MOST = -(1 << 62), 1 << 62
#: No score; may be negated.
NONE = LEAST - 1


class Grid(NamedTuple):
    #: Bytes of anchors' components (four each) in a group, held by a task.
    group_bytes: int = 16 << 20
    #: Rows of a part; smaller tables are cut further, into parts enough for every core.
    part_rows: int = 1 << 20
    least_rows: int = 2048
    block_anchors: int = 1024
    block_rows: int = 2048


def integer_rows(vectors: DataFrame, scale: int, key: str, vector: str, label: Column, anchor: Column) -> DataFrame:
    """(id, label, asks, vec) of the rows that take part, components as whole numbers; asks tells the anchors."""
    real = vectors.select(F.col(key).cast("long").alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("asks"), F.col(vector).alias("vec"))
    real = real.where("id IS NOT NULL AND label IS NOT NULL")
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = real.where(finite).withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return whole.where(square < float(MOST)).withColumn("vec", F.col("vec").cast("array<int>"))


class Best:
    """The first k rows of each anchor and slot seen so far: higher scores first, then those offered first."""

    def __init__(self, limits: np.ndarray, k: int) -> None:
        self.limits, self.k = limits, k
        self.scores = np.full((limits.size, k), NONE, np.int64)
        self.ids = np.zeros((limits.size, k), np.int64)

    def offer(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows by anchor, those of an anchor in the order in which ties are to be kept."""
        slots = self.limits.shape[1]
        at = anchor * slots + (self.limits[anchor] >= score[:, None]).sum(axis=1) - 1
        better = score > self.scores[at, -1]
        at, score, ids = at[better], score[better], ids[better]
        if not len(at):
            return
        touched = np.unique(at)
        old = np.repeat(touched, self.k)
        at, score, ids = np.r_[old, at], np.r_[self.scores[touched].ravel(), score], np.r_[self.ids[touched].ravel(), ids]
        order = np.lexsort((-score, at))  # stable: earlier rows stay first
        at, score, ids = at[order], score[order], ids[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
        first = rank < self.k
        self.scores[at[first], rank[first]] = score[first]
        self.ids[at[first], rank[first]] = ids[first]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, slot, score, id) of all rows kept."""
        at, rank = np.nonzero(self.scores != NONE)
        return at // self.limits.shape[1], at % self.limits.shape[1], self.scores[at, rank], self.ids[at, rank]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where every partial sum is exact there, else in whole numbers."""
    size = np.sqrt((left.astype(np.float64) ** 2).sum(axis=1).max() * (right.astype(np.float64) ** 2).sum(axis=1).max())
    kind = np.float32 if size < 1 << 23 else np.float64 if size < 1 << 52 else np.int64
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


class Group(NamedTuple):
    """Anchors of one vector size in a cell."""

    number: np.ndarray
    id: np.ndarray
    label: np.ndarray
    least: np.ndarray
    vec: np.ndarray
    best: Best


def grouped(batches: list[pa.RecordBatch], k: int) -> dict[int, Group]:
    table = pa.Table.from_batches(batches).combine_chunks()
    sizes = np.diff(table.column("vec").chunk(0).offsets.to_numpy())
    groups = {}
    for size in np.unique(sizes).tolist():
        own = table.filter(pa.array(sizes == size))
        limits = own.column("limits").to_pylist()
        width = max(map(len, limits))
        padded = np.array([line + [NONE] * (width - len(line)) for line in limits], np.int64)
        vec = own.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, size).astype(np.int64)
        groups[size] = Group(*(own.column(c).to_numpy() for c in ("number", "id", "label", "least")), vec, Best(padded, k))
    return groups


def meet(group: Group, ids: np.ndarray, labels: np.ndarray, vec: np.ndarray, same: bool, grid: Grid) -> None:
    """Offer a block of rows, in the order of their ids, to every anchor of the group."""
    for at in range(0, len(group.id), grid.block_anchors):
        part = slice(at, at + grid.block_anchors)
        score = products(group.vec[part], vec)
        fits = (score <= group.best.limits[part, :1]) & (score >= group.least[part, None])
        if same:
            fits &= (group.label[part, None] == labels) & (group.id[part, None] != ids)
        else:
            fits &= group.label[part, None] != labels
        anchor, row = np.nonzero(fits)
        group.best.offer(anchor + at, score[anchor, row], ids[row])


def scanned(anchors: DataFrame, rows: DataFrame, k: int, same: bool, grid: Grid) -> DataFrame:
    """(number, slot, score, other): the first k rows of each anchor and slot.

    anchors: (number, id, label, vec, limits, least), limits descending. Rows: (id, label, vec). Only rows
    of the anchor's own label but another id count if `same`, else only rows of other labels.
    """
    spark = rows.sparkSession
    held = anchors.agg(F.sum(F.size("vec") * 4).alias("bytes")).first()
    groups = max(1, -(-(held.bytes or 0) // grid.group_bytes))
    n = rows.count()
    parts = max(1, -(-n // grid.part_rows), min(2 * spark.sparkContext.defaultParallelism // groups, n // grid.least_rows))
    of_group, of_part = F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = {"group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))}
    columns = ["group", "part", "kind", "size", "id", "label", "vec", "number", "limits", "least"]
    left = anchors.withColumn("group", of_group).withColumn("part", every["part"]).withColumn("kind", F.lit(0))
    right = rows.withColumn("group", every["group"]).withColumn("part", of_part).withColumn("kind", F.lit(1)).withColumns(
        {"number": F.lit(None).cast("long"), "limits": F.lit(None).cast("array<long>"), "least": F.lit(None).cast("long")})
    cells = left.withColumn("size", F.size("vec")).select(columns).unionByName(right.withColumn("size", F.size("vec")).select(columns))
    cells = cells.repartition(groups * parts, "group", "part").sortWithinPartitions("group", "part", "kind", "size", "id")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, block, met = None, [], [], {}

        def flush() -> None:
            nonlocal block
            if block:
                table = pa.Table.from_batches(block).combine_chunks()
                size = table.column("size")[0].as_py()
                group = met.get(size)
                if group is not None:
                    vec = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, size).astype(np.int64)
                    meet(group, table.column("id").to_numpy(), table.column("label").to_numpy(), vec, same, grid)
            block = []

        def told() -> Iterator[pa.RecordBatch]:
            for group in met.values():
                anchor, slot, score, other = group.best.found()
                yield pa.RecordBatch.from_arrays([pa.array(group.number[anchor]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(other)],
                                                 ["number", "slot", "score", "other"])

        for whole in batches:
            if not whole.num_rows:
                continue
            tags = np.stack([whole.column(c).to_numpy() for c in ("group", "part", "kind", "size")])
            cuts = np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                group, part, kind, size = tags[:, lo].tolist()
                if cell != (group, part):
                    flush()
                    yield from told()
                    cell, waiting, met = (group, part), [], {}
                if kind == 0:
                    waiting.append(whole.slice(lo, hi - lo))
                    continue
                if waiting:
                    met, waiting = grouped(waiting, k), []
                for at in range(lo, hi, grid.block_rows):
                    piece = whole.slice(at, min(grid.block_rows, hi - at))
                    if block and (block[0].column("size")[0].as_py() != size or sum(b.num_rows for b in block) + piece.num_rows > grid.block_rows):
                        flush()
                    block.append(piece)
        flush()
        yield from told()

    kept = cells.mapInArrow(solve, "number long, slot int, score long, other long")
    order = Window.partitionBy("number", "slot").orderBy(F.desc("score"), "other")
    return kept.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def lower_limit(score: Column, share: tuple[int, int]) -> Column:
    """The smallest whole number from that share of a score of zero or more; no step leaves a long."""
    over, of = share
    whole, rest = F.call_function("div", score, F.lit(of)), score % of
    return score - whole * (of - over) - F.call_function("div", rest * (of - over), F.lit(of))


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5),
                   scale: int = 256, key: str = "vec_id", vector: str = "embedding", grid: Grid = Grid()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` and `label` are expressions over the table. Scores are inner products of vectors in whole
    numbers; higher ones come first, then smaller ids. For an anchor and each of its first `positives` rows
    of the same label and another id: the first `negatives` rows of other labels with a score from
    `share` of the positive's up to it. A window below zero is empty. Rows with a null id, label, vector
    or component, a non-finite component, or a squared length of 2^62 or more take no part; vectors of
    unlike lengths don't meet; repeated rows count as rows, repeated anchors too.
    """
    rows = stage(integer_rows(vectors, scale, key, vector, label, anchor), "rows")
    asked = rows.where("asks").drop("asks").withColumn("number", F.monotonically_increasing_id())
    asked = stage(asked.withColumn("limits", F.array(F.lit(MOST))).withColumn("least", F.lit(LEAST)), "anchors")
    rows = rows.drop("asks")
    near = scanned(asked, rows, positives, True, grid).where("score >= 0")  # below zero every window is empty
    near = near.groupBy("number").agg(F.collect_list(F.struct("score", "other")).alias("positives"))
    limits = F.sort_array(F.array_distinct("positives.score"), asc=False)
    near = near.withColumn("limits", limits).withColumn("least", lower_limit(F.array_min("positives.score"), share))
    windows = stage(asked.drop("limits", "least").join(near, "number"), "windows")
    best = scanned(windows.drop("positives"), rows, negatives, False, grid)
    merged = best.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "other"))).alias("merged"))
    told = windows.select("number", "id", "limits", F.explode("positives").alias("p")).join(merged, "number")
    slot = F.array_position("limits", F.col("p.score")).cast("int") - 1
    suffix = F.slice(F.filter("merged", lambda n: n.slot >= F.col("at")), 1, negatives)
    inside = F.filter("suffix", lambda n: -n.down >= lower_limit(F.col("p.score"), share))
    told = told.withColumn("at", slot).withColumn("suffix", suffix).select("id", "p", F.posexplode(inside).alias("rank", "n"))
    return told.select(F.col("id").alias("anchor_id"), F.col("p.other").alias("positive_id"), (F.col("rank") + 1).alias("rank"),
                       F.col("n.other").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("n.down")).alias("negative_score"))
