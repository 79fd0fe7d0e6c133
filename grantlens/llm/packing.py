"""Packing of tokenised documents by patterns of few lengths, fitted with non-negative least squares.

Sequences that hold the same lengths are one pattern with a repeat count. All patterns of two and
three lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram of
piece lengths, rounded, and what the histogram has left is packed best-fit, longest first, still by
counts. The histogram and the plan depend on the sequence length alone, so the driver holds no more
for 100 TB than for one document. Pieces take their places by their rank among pieces of equal length.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, stage

SEQUENCE = 2048
#: Patterns kept of the fit; the lengths of all others go to the residual packing.
MAX_PATTERNS = 20_000
FIT_ROUNDS = 150


class Vocabulary(NamedTuple):
    """Where the merges of a byte-level tokenizer are, twice over: as ranks and as the JSON that defines the ids."""

    ranks: str
    definition: str
    split: str
    special: tuple[tuple[str, int], ...] = ()


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"),
                      public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))


@lru_cache(maxsize=2)
def _encoders(vocabulary: Vocabulary):
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary.ranks, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=vocabulary.split, mergeable_ranks=ranks, special_tokens=dict(vocabulary.special))
    return fast, Tokenizer.from_file(vocabulary.definition), {name for name, _ in vocabulary.special}


def encode(text: str, vocabulary: Vocabulary) -> np.ndarray:
    """The ids that the tokenizer's definition gives, without added special tokens.

    The ranks give the same ids about four times as fast; a text that their splitter can't get
    through goes to the definition itself.
    """
    fast, slow, special = _encoders(vocabulary)
    try:
        return fast.encode_to_numpy(text, allowed_special=special, disallowed_special=())
    except BaseException as failed:  # the splitter reports deep backtracking as a panic, which is no Exception
        if isinstance(failed, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(tokens: int, sequence: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole sequences at the end, the rest first."""
    if tokens <= sequence:
        return [(0, tokens)]
    first = tokens % sequence or sequence
    return [(0, first), *((at, sequence) for at in range(first, tokens, sequence))]


def tokenized_pieces(docs: DataFrame, vocabulary: Vocabulary, sequence: int, separator: int, key: str, with_ids: bool) -> DataFrame:
    """One row per piece, with the task that made it and its rank among that task's pieces of its length."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "piece", "start", "length", "ids_crc32", "_task", "_nth", *["ids"] * with_ids]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(sequence + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, made, ids = batch.slice(at, 500), [], []
                for row, text in enumerate(part.column(1)):
                    tokens = np.append(encode(text.as_py().decode("utf-8", "replace"), vocabulary), separator).astype("<u4")
                    for piece, (start, length) in enumerate(cuts(len(tokens), sequence)):
                        own = tokens[start:start + length]
                        made.append((row, piece, start, length, zlib.crc32(own.tobytes()), task, seen[length]))
                        seen[length] += 1
                        if with_ids:
                            ids.append(own.astype(np.int64))
                if not made:
                    continue
                columns = np.array(made, np.int64).T
                arrays = [part.column(0).take(pa.array(columns[0])), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names)

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, _task long, _nth long" + ", ids array<long>" * with_ids
    return as_bytes(docs, key).mapInArrow(rows, schema)


def patterns_of(lengths: np.ndarray, sequence: int) -> np.ndarray:
    """All ways to fill a sequence with two or three of the lengths, as rows of three ascending lengths (0: none)."""
    there = np.zeros(sequence + 1, bool)
    there[lengths] = True
    found = []
    for low in [0, *lengths[lengths <= sequence // 3].tolist()]:
        middle = np.arange(max(low, 1), (sequence - low) // 2 + 1)
        high = sequence - low - middle
        ok = there[middle] & there[high]
        found.append(np.stack([np.full(ok.sum(), low), middle[ok], high[ok]], axis=1))
    return np.concatenate(found)


def fit(patterns: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths close to the histogram: accelerated projected gradient."""
    size = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(patterns[:, k], weights=x, minlength=size) for k in range(3))
        total[0] = 0
        return total

    def back(r: np.ndarray) -> np.ndarray:
        return r[patterns].sum(axis=1)

    v, top = np.ones(len(patterns)), 1.0
    for _ in range(25):
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    target = histogram.astype(float).copy()
    target[0] = 0
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(used(y) - target) / (1.02 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, sequence: int, max_patterns: int = MAX_PATTERNS) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(repeats, [(length, copies), ...])]: patterns whose pieces are the histogram's, each once.

    Two fits are made, over all patterns and over those with a piece of more than half a sequence,
    which leave the shorter pieces to fill what long ones leave; the one with fewer sequences stands.
    """
    lengths = np.flatnonzero(histogram[:sequence])
    patterns = patterns_of(lengths, sequence) if len(lengths) else np.empty((0, 3), np.int64)
    plans = [rounded(histogram, chosen, sequence, max_patterns) for chosen in (patterns, patterns[patterns.max(axis=1, initial=0) > sequence // 2])]
    return min(plans, key=lambda made: sum(repeats for repeats, _ in made))


def rounded(histogram: np.ndarray, patterns: np.ndarray, sequence: int, max_patterns: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The fit in whole repeats, long pieces first, as far as there are pieces; the residual is packed best-fit."""
    left = histogram.astype(np.int64).copy()
    made: list[tuple[int, list[tuple[int, int]]]] = []
    if len(patterns):
        x = fit(patterns, left)
        order = np.argsort(-x, kind="stable")[:max_patterns]
        order = order[x[order] >= 0.5]
        order = order[np.lexsort((-x[order], -patterns[order].max(axis=1)))]
        for k in order.tolist():
            need = [(n, c) for n, c in zip(*np.unique(patterns[k], return_counts=True), strict=True) if n]
            repeats = min([round(x[k]), *(int(left[n] // c) for n, c in need)])
            if repeats > 0:
                made.append((repeats, [(int(n), int(c)) for n, c in need]))
                for n, c in need:
                    left[n] -= repeats * c
    return made + best_fit(left, sequence)


def best_fit(left: np.ndarray, sequence: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing by counts: equal bins are handled as one entry."""
    full: list[tuple[int, list[tuple[int, int]]]] = []
    rooms: list[int] = []
    bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(room: int, repeats: int, items: list[tuple[int, int]]) -> None:
        if not room:
            full.append((repeats, items))
            return
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append((repeats, items))

    for n in range(len(left) - 1, 0, -1):
        count = int(left[n])
        while count:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = sequence // n
                if count >= each:
                    put(sequence - each * n, count // each, [(n, each)])
                    count %= each
                if count:
                    put(sequence - count * n, 1, [(n, count)])
                break
            room = rooms[at]
            repeats, items = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            each = min(room // n, count)
            take = min(repeats, count // each)
            if take < repeats:
                put(room, repeats - take, items)
            put(room - each * n, take, [*items, (n, each)])
            count -= take * each
    return full + [entry for room in rooms for entry in bins[room]]


def places(made: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, sequence, copies, offset), by length and rank: where pieces of each rank go."""
    found, taken, sequence = [], {}, 0
    for repeats, items in made:
        offset = 0
        for n, copies in items:
            found.append((n, taken.get(n, 0), sequence, copies, offset))
            taken[n] = taken.get(n, 0) + repeats * copies
            offset += n * copies
        sequence += repeats
    rows = np.array(found, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: Vocabulary | None = None, separator: int = 0,
         key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset where each one lies.

    Every row is a document, also repeated rows and rows without a key; a null text is empty and has
    the separator alone. Only documents of more than `sequence` tokens are cut. An empty table gives
    no rows. `with_ids` adds the token ids of each piece.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    pieces = stage(tokenized_pieces(docs, vocabulary, sequence, separator, key, with_ids), "pieces")
    by_task = pieces.groupBy("_task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(sequence + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        histogram[row.length] = row.n
    where = spark.sparkContext.broadcast(places(plan(histogram, sequence)))  # bounded by the sequence length
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("_task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        span = int(table[:, 1].max()) + 1 if len(table) else 1
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            slot = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
            local, copies = rank - table[slot, 1], table[slot, 3]
            put = [pa.array(table[slot, 2] + local // copies), pa.array(table[slot, 4] + local % copies * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *put, *batch.columns[6:]], names)

    ranked = pieces.join(first, ["_task", "length"]).select(
        "key", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_nth")).alias("_rank"), *["ids"] * with_ids)
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(rows, schema + ", ids array<long>" * with_ids)
