"""SimHash near duplicates by a binary trie self-join.

Fingerprints are the leaves of binary tries. A trie is joined with itself by walking pairs of nodes
together from the root: each step down adds the bits in which the two branches differ, and a pair
whose sum exceeds the error budget is dropped with all that lies below it.

One trie over all fingerprints would keep almost every pair of its upper nodes, since few bits have
been seen there. So the bits are cut into `errors + 2` blocks. A pair with at most `errors` differing
bits agrees on at least two whole blocks; for each choice of two blocks there is a trie that has these
blocks on top, where no difference is allowed. The subtries below one top are independent pieces of
work, which Spark deals out; all subtries of a task are walked at once with numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ENCODED, as_bytes, components, discard, forest, stage

BITS = 64
SEED = 42
#: Pairs of nodes that are stepped down together; more of them wait on a stack.
WALK = 1 << 17
#: Fingerprints that a task gathers before it walks their subtries; a group is never cut.
GATHER = 1 << 16


def fingerprint_of(text: bytes, words: int) -> int:
    """SimHash of the word shingles, repeats included; without a word zero."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:last], stops, strict=True)), np.uint64, last)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, last, 1 << 16):
        piece = h[k:k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, fp long) per row, h a hash of the text. A-Z are lowered, words are split at ASCII white space; a null text has no word."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["key", "h", "fp"])

    read = as_bytes(docs, key, text=text).withColumn("h", F.xxhash64(ENCODED))
    made = read.mapInArrow(rows, f"key {kind}, h long, fp long")
    return made.withColumnRenamed("key", key)


def _block(offset: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))


def _tries(errors: int) -> tuple[Column, int]:
    """The fingerprint as a member of each trie: its top, and the bits below it; and how many bits these are at most."""
    n = errors + 2
    widths = [BITS // n + (k < BITS % n) for k in range(n)]
    offsets = np.cumsum([0, *widths[:-1]]).tolist()
    members, most = [], 0
    for trie, top in enumerate(combinations(range(n), 2)):
        head, rest, below = F.lit(0).cast("long"), F.lit(0).cast("long"), 0
        for k in range(n):
            block = _block(offsets[k], widths[k])
            if k in top:
                head = F.shiftleft(head, widths[k]).bitwiseOR(block)
            else:
                rest, below = F.shiftleft(rest, widths[k]).bitwiseOR(block), below + widths[k]
        members.append(F.struct(F.lit(trie).alias("trie"), head.alias("top"), rest.alias("rest")))
        most = max(most, below)
    return F.array(*members), most


def walk(group: np.ndarray, rest: np.ndarray, bits: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the walks reach. Rows are sorted by (group, rest); each group is one subtrie.

    A node is a range of rows. Pairs are stepped down one bit at a time. Where the bits left cannot
    exceed the budget any more, every pair below is a link, and the two ranges are tied together.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    stops = np.r_[starts[1:], len(group)]
    many = stops - starts > 1
    starts, stops = starts[many], stops[many]
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = [(0, starts, stops, starts, stops, np.zeros(len(starts), np.int8))]
    ones = {}
    for depth in range(bits):
        ones[depth] = np.r_[0, np.cumsum((rest >> np.int64(bits - 1 - depth)) & 1)]
    while waiting:
        depth, a, b, c, d, diff = waiting.pop()
        if not len(a):
            continue
        if len(a) > WALK:
            half = len(a) // 2
            waiting += [(depth, a[:half], b[:half], c[:half], d[:half], diff[:half]),
                        (depth, a[half:], b[half:], c[half:], d[half:], diff[half:])]
            continue
        done = diff + (bits - depth) <= errors
        if done.any():
            edges.append((a[done], c[done]))
            for lo, hi in ((a[done], b[done]), (c[done], d[done])):
                wide = hi - lo > 1
                size = (hi - lo)[wide] - 1
                first = np.repeat(lo[wide], size)
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                edges.append((first, first + 1 + step))
            a, b, c, d, diff = a[~done], b[~done], c[~done], d[~done], diff[~done]
        if not len(a):
            continue
        count = ones[depth]
        m, n = b - (count[b] - count[a]), d - (count[d] - count[c])
        same = a == c
        apart = ~same
        parts = [(a, m, c, n, diff), (m, b, n, d, diff), (a, m, n, d, diff + 1),
                 (m[apart], b[apart], c[apart], n[apart], diff[apart] + 1)]
        a, b, c, d, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (b > a) & (d > c) & (diff <= errors) & ~((a == c) & (b - a == 1))
        waiting.append((depth + 1, a[keep], b[keep], c[keep], d[keep], diff[keep].astype(np.int8)))
    if not edges:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])


def trie_links(prints: DataFrame, errors: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that differ in at most `errors` bits.

    Each task returns no more edges than it has members, whatever the number of links between them.
    """
    members, bits = _tries(errors)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(m: np.ndarray) -> pa.RecordBatch:
            change = np.r_[False, (m[0][1:] != m[0][:-1]) | (m[1][1:] != m[1][:-1])]
            left, right = walk(np.cumsum(change), m[2], bits, errors)
            root = forest(left, right, m.shape[1])
            tied = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(m[3][root[tied]]), pa.array(m[3][tied])], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= GATHER:
                m = np.concatenate(held, axis=1)
                change = np.flatnonzero((m[0][1:] != m[0][:-1]) | (m[1][1:] != m[1][:-1]))
                cut = int(change[-1]) + 1 if len(change) else 0
                held = [m[:, cut:]]
                if cut:
                    yield solve(m[:, :cut])
        if held:
            yield solve(np.concatenate(held, axis=1))

    dealt = prints.select("fp", F.inline(members)).select("trie", "top", "rest", "fp")
    return dealt.repartition("trie", "top").sortWithinPartitions("trie", "top", "rest").mapInArrow(rows, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, errors: int = 3, key: str = "doc_id", text: str = "text",
                    with_hash: bool = False) -> DataFrame:
    """(key, fingerprint, component_id) per row of docs: the smallest key reachable over fingerprints that link.

    Null and empty texts have fingerprint zero and link like any other. Rows without a key keep their
    row and take part in links; a component without any key has a null id. Repeated rows each keep a
    row. Copies are one fingerprint, so only distinct fingerprints are joined. `with_hash` adds h, the
    xxhash64 of the text's bytes (null as empty), by which rows of equal key can be told apart, and root,
    one fingerprint of the component: components whose smallest key is the same keep different roots.
    """
    prints = stage(fingerprints(docs, words, key, text), "prints")
    classes = prints.groupBy("fp").agg(F.min(key).alias("low"))
    edges = stage(trie_links(classes.select("fp"), errors), "links")
    found = components(edges)
    roots = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    roots = stage(roots, "roots")
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stage(roots.join(lows, "root").select("fp", "component_id", *["root"] * with_hash), "classes")
    discard(edges, roots)
    return prints.join(named, "fp").select(key, F.format_string("%016x", "fp").alias("fingerprint"), "component_id", *["h", "root"] * with_hash)
