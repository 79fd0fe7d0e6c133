"""Exact repeats of word windows, found by fixed-block anchors.

A window of w words contains a whole block of b = (w + 1) / 2 words at a place that b divides, wherever
it starts. Such blocks of all documents are the reference; every rolling run of b words probes them. A
run is a hit if some place in the corpus has it as an aligned block and some other place has it at all.
Any two equal windows share a hit at the same offset, so only windows around hits remain: these are
compared as a whole, and each maximal stretch of repeated windows is one exact repeat.

Both comparisons work alike. A task hashes the runs of many documents at once, settles those that
repeat among them, and sends one entry per distinct run to the partition of its hash, packed in arrays
of a few bytes per run. So a run that a third of all documents have is sent once per task, not once per
document, and no pairs of occurrences are ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ENCODED, discard, release, stage

WINDOW = 35
#: Words that a task hashes at once, and runs that one partition of hashes is to hold.
WORDS_AT_ONCE = 1 << 20
RUNS_PER_PARTITION = 1 << 22
BYTES_PER_WORD = 6
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_hashes(text: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, text.split()), np.uint64)


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all runs of `size` words, from runs of doubling size, mixed at the end."""
    total, have, power, run = None, 0, 1, words
    while True:
        if size & power:
            piece = run[have:len(words) - size + 1 + have]
            total = piece if total is None else total * np.uint64(pow(base, power, 1 << 64)) + piece
            have += power
        if have == size:
            break
        run = run[:-power] * np.uint64(pow(base, power, 1 << 64)) + run[power:]
        power *= 2
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(29))


def packed(numbers: np.ndarray) -> bytes:
    """Ascending or nearly ascending numbers, as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(numbers.astype(np.int64), prepend=0).astype("<i8").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8"))


#: Rows that tasks exchange: runs by partition of their hash, and settled hits on their way to their document.
SENT = "part int, runs binary, extra binary, ids binary, doc binary, pos binary, flags binary"
SENT_NAMES = ["part", "runs", "extra", "ids", "doc", "pos", "flags"]
MANY, ANCHOR, SETTLED = 1, 2, 4


def exchange(parts: int, ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, runs: np.ndarray, extra: np.ndarray | None,
             anchor: np.ndarray) -> pa.RecordBatch:
    """What one task has to tell of some documents' runs: their ids (rows of `ids`), places, hashes, and which are aligned blocks."""
    part = (runs % np.uint64(parts)).astype(np.int64)
    rest = runs // np.uint64(parts)
    order = np.lexsort((rest, part) if extra is None else (extra, rest, part))
    r, p = runs[order], part[order]
    new = np.r_[True, r[1:] != r[:-1]] if extra is None else np.r_[True, (r[1:] != r[:-1]) | (extra[order][1:] != extra[order][:-1])]
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1
    anchored = np.bincount(group, anchor[order]) > 0
    first = order[new]
    flags = (MANY * many + ANCHOR * anchored).astype(np.uint8)
    rows: list[tuple] = []
    p = p[new]
    bounds = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        place = lo + np.lexsort((pos[first[lo:hi]], doc[first[lo:hi]]))
        own = first[place]
        docs, index = np.unique(doc[own], return_inverse=True)
        wide = rest[own] if extra is not None else (rest[own] & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows.append((int(p[lo]), wide.tobytes(), b"" if extra is None else extra[own].tobytes(), ids[docs].tobytes(),
                     packed(index), packed(pos[own]), flags[place].tobytes()))
    settled = order[many[group]]
    if len(settled):
        settled = settled[np.lexsort((pos[settled], doc[settled]))]
        docs, index = np.unique(doc[settled], return_inverse=True)
        to = ids[docs][:, 0].astype(np.uint64) % np.uint64(parts)
        for k in np.unique(to).tolist():
            mine = np.flatnonzero(to[index] == k)
            there, again = np.unique(index[mine], return_inverse=True)
            rows.append((int(k), b"", b"", ids[docs[there]].tobytes(), packed(again), packed(pos[settled[mine]]), bytes([SETTLED])))
    kinds = [pa.int32(), *[pa.binary()] * 6]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SENT_NAMES)


#: Hits on their way to the partition of their document.
FOUND = "part int, ids binary, doc binary, pos binary"


def addressed(ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, parts: int) -> pa.RecordBatch:
    """Hits of many documents, packed by the partition of their document."""
    docs, index = np.unique(ids, axis=0, return_inverse=True)
    doc = index.reshape(-1)[doc]
    to = (docs[:, 0].astype(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((pos, doc, to[doc]))
    doc, pos = doc[order], pos[order]
    bounds = np.flatnonzero(np.r_[True, np.diff(to[doc]) != 0, True]) if len(doc) else np.zeros(1, np.int64)
    rows = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own, again = np.unique(doc[lo:hi], return_inverse=True)
        rows.append((int(to[doc[lo]]), docs[own].tobytes(), packed(again), packed(pos[lo:hi])))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), *[pa.binary()] * 3], strict=True)], ["part", "ids", "doc", "pos"])


def settle(table: pa.Table, width: int, wide: bool, parts: int) -> pa.Table:
    """The hits of one partition of hashes, addressed to their documents."""
    ids_of, docs_of, places_of, held, offset = [np.empty((0, width), np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], 0
    for row in zip(*(table.column(c).to_pylist() for c in SENT_NAMES[1:]), strict=True):
        runs, extra, ids, doc, pos, flags = row
        ids_of.append(np.frombuffer(ids, "<i8").reshape(-1, width))
        doc, pos = unpacked(doc) + offset, unpacked(pos)
        offset += len(ids_of[-1])
        if not runs:
            docs_of.append(doc)
            places_of.append(pos)
        else:
            held.append((np.frombuffer(runs, "<u8" if wide else "<u4"), np.frombuffer(extra, "<u8"), doc, pos, np.frombuffer(flags, np.uint8)))
    if held:
        runs, extra, doc, pos, flags = (np.concatenate([h[k] for h in held]) for k in range(5))
        order = np.lexsort((extra, runs)) if wide else np.argsort(runs, kind="stable")
        r = runs[order]
        new = np.r_[True, r[1:] != r[:-1]]
        if wide:
            new[1:] |= extra[order][1:] != extra[order][:-1]
        group = np.cumsum(new) - 1
        f = flags[order]
        again = (np.bincount(group) > 1) | (np.bincount(group, f & MANY) > 0)
        hit = again & (np.bincount(group, f & ANCHOR) > 0)
        found = order[hit[group] & (f & MANY == 0)]
        docs_of.append(doc[found])
        places_of.append(pos[found])
    return pa.Table.from_batches([addressed(np.concatenate(ids_of), np.concatenate(docs_of), np.concatenate(places_of), parts)])


def gathered_places(table: pa.Table, width: int) -> pa.Table:
    """One row per document with hits: its ids, and all places once."""
    ids_of, docs_of, places_of, offset = [], [], [], 0
    for ids, doc, pos in zip(*(table.column(c).to_pylist() for c in ("ids", "doc", "pos")), strict=True):
        ids_of.append(np.frombuffer(ids, "<i8").reshape(-1, width))
        docs_of.append(unpacked(doc) + offset)
        places_of.append(unpacked(pos))
        offset += len(ids_of[-1])
    docs, index = np.unique(np.concatenate(ids_of), axis=0, return_inverse=True)
    doc, pos = index.reshape(-1)[np.concatenate(docs_of)], np.concatenate(places_of)
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    keep = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
    doc, pos = doc[keep], pos[keep]
    bounds = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
    places = [packed(pos[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    which = doc[bounds[:-1]]
    return pa.Table.from_arrays([*[pa.array(docs[which, k]) for k in range(width)], pa.array(places, pa.binary())], [*[f"id{k}" for k in range(width)], "places"])


def exchanged(sent: DataFrame, parts: int, width: int, wide: bool) -> DataFrame:
    """(id0 .. , places binary) per document with hits."""
    found = sent.repartitionById(parts, "part").groupBy("part").applyInArrow(lambda t: settle(t, width, wide, parts), FOUND)
    schema = ", ".join(f"id{k} long" for k in range(width)) + ", places binary"
    return found.repartitionById(parts, "part").groupBy("part").applyInArrow(lambda t: gathered_places(t, width), schema)


class Gathered:
    """Documents whose words are hashed together."""

    def __init__(self) -> None:
        self.ids, self.words, self.hits, self.size = [], [], [], 0

    def add(self, ids: tuple, text: bytes, hits: bytes | None = None) -> None:
        words = word_hashes(text)
        self.ids.append(ids)
        self.words.append(words)
        self.hits.append(hits)
        self.size += len(words)

    def places(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, start of a run, its document, its place there) for all runs that end within their document."""
        sizes = np.array([len(w) for w in self.words])
        words = np.concatenate(self.words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = np.flatnonzero(pos + run <= sizes[doc])
        return words, fits, doc[fits], pos[fits]

    def blocks(self, parts: int, block: int) -> pa.RecordBatch:
        words, at, doc, pos = self.places(block)
        runs = rolling(words, block, BASES[0])[at]
        return exchange(parts, np.array(self.ids, np.int64), doc, pos, runs, None, pos % block == 0)

    def windows(self, parts: int, window: int, block: int) -> pa.RecordBatch | None:
        words, at, doc, pos = self.places(window)
        near = np.zeros(len(words) + window + 1, np.int32)
        begin = np.cumsum([0, *[len(w) for w in self.words]])
        for k, places in enumerate(self.hits):
            hit = unpacked(places)
            np.add.at(near, begin[k] + np.maximum(hit - (window - block), 0), 1)
            np.add.at(near, begin[k] + hit + 1, -1)
        keep = np.cumsum(near)[at] > 0
        at, doc, pos = at[keep], doc[keep], pos[keep]
        if not len(at):
            return None
        runs, extra = (rolling(words, window, b)[at] for b in BASES)
        return exchange(parts, np.array(self.ids, np.int64), doc, pos, runs, extra, np.ones(len(at), bool))


def _sender(least: int, width: int, make: Callable[[Gathered], pa.RecordBatch | None]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True))
            for row, text in enumerate(batch.column(width)):
                data = text.as_py()
                if len(data) < 2 * least - 1:
                    continue
                held.add(ids[row], data, batch.column(width + 1)[row].as_py() if batch.num_columns > width + 1 else None)
                if len(held.words[-1]) < least:
                    held.size -= len(held.words.pop())
                    held.ids.pop(), held.hits.pop()
                if held.size >= WORDS_AT_ONCE:
                    if (sent := make(held)) is not None:
                        yield sent
                    held = Gathered()
        if held.size and (sent := make(held)) is not None:
            yield sent

    return rows


def repeated_windows(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id0, id1, places): starts of all windows that also start elsewhere, per text in which there are any.

    id0 and id1 are hashes of key and text. Rows that agree in both have the same places; each still
    counts as an occurrence of its own.
    """
    block = (window + 1) // 2
    read = named(docs, key, text)
    size = read.agg(F.sum(F.octet_length(ENCODED))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (BYTES_PER_WORD * RUNS_PER_PARTITION)))
    sent = read.select("id0", ENCODED).mapInArrow(_sender(window, 1, lambda held: held.blocks(parts, block)), SENT)
    hits = stage(exchanged(sent, parts, 1, False), "hits")
    del sent
    release(docs.sparkSession)
    near = read.join(hits, "id0").select("id0", "id1", ENCODED, "places")
    sent = near.mapInArrow(_sender(window, 2, lambda held: held.windows(parts, window, block)), SENT)
    found = stage(exchanged(sent, parts, 2, True), "repeats")
    del sent, near
    discard(hits)
    release(docs.sparkSession)
    return found


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    read = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).cast("binary").alias(ENCODED))
    return read.select("key", ENCODED, F.xxhash64("key", ENCODED).alias("id0"), F.xxhash64(ENCODED, "key").alias("id1"))


def without_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, repeats array<struct<start, stop>>) per row of docs.

    A word goes if any window of `window` words that covers it starts anywhere else too, in the same
    document or another; windows are judged on the input. repeats are the maximal runs of such words.
    Words are split at ASCII white space and kept as they are; a null text has none. Repeated rows
    repeat each other. `with_text` adds the kept words, joined by one space, as a binary column.
    """
    found = repeated_windows(docs, window, key, text)
    both = named(docs, key, text).join(found, ["id0", "id1"], "left").select("key", ENCODED, "places")
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "n_removed", "kept_sha256", "repeats", *["kept"] * with_text]
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, digests, runs, texts = [], [], [], [], []
            for data, places in zip(batch.column(1), batch.column(2), strict=True):
                words, spans = data.as_py().split(), []
                sizes.append(len(words))
                if places.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = unpacked(places.as_py())
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    cover = np.cumsum(edge)[:-1] > 0
                    ends = np.flatnonzero(np.diff(np.r_[False, cover, False])).reshape(-1, 2)
                    spans = [{"start": a, "stop": b} for a, b in ends.tolist()]
                    words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                kept = b" ".join(words)
                gone.append(sizes[-1] - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                runs.append(spans)
                texts.append(kept)
            made = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(runs, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(made + [pa.array(texts, pa.binary())] * with_text, names)

    schema = f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start: long, stop: long>>"
    return both.mapInArrow(rows, schema + ", kept binary" * with_text)
