"""Scores of whole documents under a gated recurrent language model.

The network predicts a bounded vocabulary: first the class of the next word, then the word within its
class (class-factored softmax). Vocabulary and biases come from the word counts of the whole training corpus.
The network is trained in numpy by truncated backpropagation on every word of the training documents, on the executors: in
each round, workers learn from their shares, starting from the mean of the parameters of the round before. The
state is carried from window to window; scoring carries it through the whole document.
A word outside the vocabulary is the network's unknown word, times its smoothed share of all such words
by the counts of the whole training corpus. The counts also give the unigram score.

Counts travel by batches of documents: a task sends every distinct word of a batch once to the partition
of its hash, with how often the batch's training documents use it; the partition adds up the counts and
sends them back to the batch with their ids in the vocabulary, where they meet all tokens of its documents, in
order and as numbers of the batch's words. So texts are taken apart once, for counts, training and scores. What
travels does not depend on the number of partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import ENCODED, discard, lowest, release, stage
from .langid import held_out

END = b"\n"
MODULUS = 5
#: Tokens that a task counts or scores at once, about; bytes of text for a token.
COUNT_AT_ONCE, SCORE_AT_ONCE, BYTES_PER_TOKEN = 1 << 20, 3 << 20, 6
#: Distinct words that a task of `word_counts` holds before it sends their counts.
HOLD = 1 << 18
#: Bytes of text from which `sample` grows, with the square root of the input.
GROWS_FROM = 1 << 28
#: Words whose probabilities are worked out at once.
SLICE = 1 << 14
#: Words whose powers stay in the cache.
CACHED = 1 << 11
#: Bytes of text per partition of words.
BYTES_PER_PARTITION = 64 << 20
#: Rounds of the training, but of a small corpus; bytes of text that a worker learns from in a round; words of a document
#: that one worker gets; parts in which parameters are averaged.
ROUNDS, BYTES_PER_UNIT, PIECE, CHUNKS = 8, 16 << 20, 1 << 16, 64


class Training(NamedTuple):
    """Bounds of the vocabulary and the fit. documents and bytes_per_document are those of `sample`, which no query uses."""

    documents: int = 3000
    bytes_per_document: int = 4096
    classes: int = 64
    class_size: int = 64
    hidden: int = 16
    streams: int = 512
    window: int = 32
    steps: int = 250
    rate: float = 0.01
    seed: int = 11


class Model(NamedTuple):
    """ids: words of the vocabulary; 0 is the unknown word, 1 the end. Word k is in class k // class_size."""

    ids: dict[bytes, int]
    table: np.ndarray
    recurrent: np.ndarray
    start: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray


class Totals(NamedTuple):
    """Training tokens and distinct ones, of all words and of those outside the vocabulary."""

    n: int
    v: int
    tail_n: int
    tail_v: int


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def grown(training: Training, size: int) -> Training:
    """The size of `sample` for a corpus of so many bytes. Neither is used by `scored`; their tests stay as they were."""
    times = max(1.0, size / GROWS_FROM) ** 0.5
    return training._replace(documents=round(training.documents * times), steps=round(training.steps * times))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all training documents, ends included: the plain way, against which tests hold `summed`. No query uses it."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.update(tokens(data))
                if len(held) >= HOLD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    told = docs.where("NOT held AND key IS NOT NULL").select(ENCODED).mapInArrow(rows, "word binary, n long")
    return told.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, training: Training) -> tuple[dict[bytes, int], np.ndarray]:
    """Ids of the most frequent words, and how often each id is used. Few more words than these reach the driver."""
    room = training.classes * training.class_size
    words = counts.where((F.col("word") != F.lit(END)) & (F.col("n") > 2)).withColumn("digits", F.length(F.bin("n")))
    least, many = 64, 0
    for digits, n in sorted(words.groupBy("digits").count().collect(), reverse=True):
        if many < room - 2:
            least, many = digits, many + n
    rows = words.where(F.col("digits") >= least).orderBy(F.desc("n"), "word").limit(room - 2).collect()
    ids = {END: 1} | {bytes(r.word): k for k, r in enumerate(rows, 2)}
    total = counts.agg(F.sum("n"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n")))).first()
    seen = np.zeros(room)
    seen[1:len(rows) + 2] = [total[1] or 0, *(r.n for r in rows)]
    seen[0] = (total[0] or 0) - seen.sum()
    return ids, seen


def numbered(data: bytes, inside: bool, ends: bool, ids: dict[bytes, int]) -> np.ndarray:
    """Word ids of a slice of a document. A word that a cut may have hit is left out; only a document's end is an end."""
    words = data.lower().split()[1 if inside else 0:]
    return np.array([ids.get(w, 0) for w in (words + [END] if ends else words[:-1])], "<i4")


def sample(docs: DataFrame, training: Training, ids: dict[bytes, int]) -> list[tuple[np.ndarray, bool]]:
    """Word ids of a sample of training documents, from hashed places of long ones; and whether a slice starts inside its document."""
    kind = docs.schema["key"].dataType.simpleString()
    keys = docs.where("NOT held AND key IS NOT NULL").select("key")
    low = keys.where(lowest(F.xxhash64("key"), training.documents, keys.count()))
    chosen = low.orderBy(F.xxhash64("key"), "key").limit(training.documents).distinct()
    most = training.bytes_per_document
    at = F.pmod(F.xxhash64("key"), F.greatest(F.octet_length(ENCODED) - most + 1, F.lit(1))).cast("int") + 1
    cut = docs.join(F.broadcast(chosen), "key", "left_semi").select(
        "key", F.substr(ENCODED, at, F.lit(most)).alias("t"), (at > 1).alias("inside"), (at + most > F.octet_length(ENCODED)).alias("ends"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [numbered(*x, ids).tobytes() for x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], ["key", "ids", "inside"])

    found = cut.mapInArrow(rows, f"key {kind}, ids binary, inside boolean")
    found = found.orderBy(F.xxhash64("key"), "key", "ids").limit(training.documents).select("ids", "inside").collect()
    return [(np.frombuffer(bytes(r.ids), "<i4"), r.inside) for r in found]


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)


def bounded(h: np.ndarray, *weights: np.ndarray) -> bool:
    """Whether no power of products of such states, with a one added, and weights can overflow."""
    return max(1.0, float(np.abs(h).max(initial=0))) * max(float(np.abs(w).sum(axis=-1).max()) for w in weights) < 80


def powers(x: np.ndarray, weights: np.ndarray, column: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """exp(x @ weights.T) but for a factor of each row, the sums of its rows, the places of each row's column in it, and the logarithms of their shares."""
    p = x @ weights.T
    at = np.arange(0, p.size, p.shape[1]) + column
    logs = p.ravel()[at]
    if not safe:
        off = p.max(axis=1)
        p -= off[:, None]
        logs -= off
    np.exp(p, out=p)
    sums = p @ np.ones(len(weights), p.dtype)
    logs -= np.log(sums)
    return p, sums, at, logs


def in_order(want: np.ndarray, room: int) -> np.ndarray:
    """The order of words by their ids; that of short integers takes no comparison."""
    return np.argsort(want.astype(np.uint16) if room <= 1 << 16 else want, kind="stable")


def blocks(which: np.ndarray, classes: int) -> Iterator[tuple[int, slice]]:
    """The classes of words in order of their ids, some words at once, which stay in the cache."""
    bounds = np.searchsorted(which, np.arange(classes + 1)).tolist()
    for c in range(classes):
        for lo in range(bounds[c], bounds[c + 1], CACHED):
            yield c, slice(lo, min(lo + CACHED, bounds[c + 1]))


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where a new value starts."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def softmax_step(model: dict[str, np.ndarray], h: np.ndarray, want: np.ndarray, size: int) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss, gradients and the gradient of the states (N, H) for the words wanted after them.

    Words are put in order of their ids, so that classes and words are slices.
    """
    outer, inner = np.column_stack([model["to_class"], model["class_bias"]]), np.concatenate([model["to_word"], model["word_bias"][..., None]], axis=2)
    n, classes, safe = max(len(want), 1), len(outer), bounded(h, outer, inner)
    order = in_order(want, classes * size)
    ids, own = want[order].astype(np.int64), with_ones(np.take(h, order, axis=0))
    which, within = np.divmod(ids, size)
    d, d_outer, d_inner = np.empty((len(ids), h.shape[1]), h.dtype), np.zeros_like(outer), np.zeros_like(inner)
    loss = 0.0

    def spread(weights: np.ndarray, part: slice, column: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p, sums, at, logs = powers(own[part], weights, column[part], safe)
        p *= (1 / sums)[:, None]
        p.ravel()[at] -= 1
        return float(logs.sum()), p @ weights[:, :-1], p.T @ own[part]

    for part in (slice(lo, lo + CACHED) for lo in range(0, len(ids), CACHED)):
        logs, d[part], grad = spread(outer, part, which)
        d_outer += grad
        loss -= logs
    for c, part in blocks(which, classes):
        logs, d_x, grad = spread(inner[c], part, within)
        d[part] += d_x
        d_inner[c] += grad
        loss -= logs
    d_h = np.empty_like(h)
    d_h[order] = d
    for x in (d_h, d_outer, d_inner):
        x /= n
    return loss / n, {"to_class": d_outer[:, :-1], "class_bias": d_outer[:, -1], "to_word": d_inner[..., :-1], "word_bias": d_inner[..., -1]}, d_h


def train(texts: list[list[bytes]], training: Training) -> Model:
    """A model of whole documents that are all there is."""
    counts = Counter(w for text in texts for w in text if w != END)
    common = sorted((w for w, c in counts.items() if c > 2), key=lambda w: (-counts[w], w))[:training.classes * training.class_size - 2]
    ids = {END: 1} | {w: k for k, w in enumerate(common, 2)}
    slices = [(np.array([ids.get(w, 0) for w in text], np.int64), False) for text in texts if text]
    seen = np.bincount(np.concatenate([t for t, _ in slices]), minlength=training.classes * training.class_size) if slices else None
    return fit(slices, ids, seen, training)


def fit(slices: list[tuple[np.ndarray, bool]], ids: dict[bytes, int], seen: np.ndarray | None, training: Training) -> Model:
    """The network for a vocabulary and how often each id is used, learned in one place."""
    params = begun(seen, training)
    learn(params, slices, training, passes(sum(len(t) for t, _ in slices), training))
    return finished(params, ids)


def begun(seen: np.ndarray | None, training: Training) -> dict[str, np.ndarray]:
    """Parameters before any text: the biases give each word its share."""
    rng = np.random.default_rng(training.seed)
    size, room, hidden = training.class_size, training.classes * training.class_size, training.hidden
    share = ((np.zeros(room) if seen is None else seen) + 0.1).reshape(training.classes, size)
    params = {k: rng.normal(0, 0.15, shape).astype(np.float32) for k, shape in {
        "table": (room + 1, 3 * hidden), "recurrent": (3 * hidden, hidden), "to_class": (training.classes, hidden), "to_word": (training.classes, size, hidden)}.items()}
    params["class_bias"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    params["word_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return params


def finished(params: dict[str, np.ndarray], ids: dict[bytes, int]) -> Model:
    table, recurrent = gru.halved(params["table"].T, params["recurrent"])
    start = np.zeros(recurrent.shape[1], np.float32)
    return Model(ids, table, recurrent, start, params["to_class"], params["class_bias"], params["to_word"], params["word_bias"])


def passes(words: int, training: Training) -> int:
    """How often a corpus of so many words is read: once, and a small one as often as `steps` steps take."""
    return max(1, -(-training.steps * training.streams * training.window // max(words, 1))) if words else 1


def laid_out(slices: list[tuple[np.ndarray, bool]], training: Training, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int]:
    """Words before and words wanted (T, streams), and how many of the streams reach the last row.

    All slices one after the other, shuffled, cut into equal streams. The word before is `room` at the start of a
    document; of a slice from inside one, the first word is context only.
    """
    room = training.classes * training.class_size
    slices = [(text, int(inside)) for text, inside in slices if len(text) > inside]
    slices = [slices[k] for k in rng.permutation(len(slices))]
    if not slices:
        return np.zeros((0, 1), np.uint16), np.zeros((0, 1), np.uint16), 1
    wanted = np.concatenate([text[inside:] for text, inside in slices])
    before = np.concatenate([text[:-1] if inside else np.r_[room, text[:-1]] for text, inside in slices])
    streams = min(training.streams, len(wanted))
    length, last = -(-len(wanted) // streams), len(wanted) % streams or streams
    # The first `last` streams are a word longer than the others.
    starts = np.arange(streams) * length - np.maximum(np.arange(streams) - last, 0)
    at = np.minimum(starts + np.arange(length)[:, None], len(wanted) - 1)
    return before.astype(np.uint16)[at], wanted.astype(np.uint16)[at], last


def learn(params: dict[str, np.ndarray], slices: list[tuple[np.ndarray, bool]], training: Training, times: int = 1, since: float = 0.0, until: float = 1.0) -> int:
    """Truncated backpropagation over all words of the slices, `times` times, changing the parameters in place; the number of words.

    The state is carried from window to window. since and until say how far the whole training is before and after,
    by which the rate falls.
    """
    rng = np.random.default_rng(training.seed)
    adam = gru.Adam(params, training.rate)
    hidden, table = training.hidden, params["table"]
    words = 0
    for time in range(times):
        before, wanted, last = laid_out(slices, training, rng)
        length, streams = before.shape
        words = length * streams - (streams - last)
        h = np.zeros((hidden, streams), np.float32)
        for at in range(0, length, training.window):
            adam.rate = training.rate * (1 - 0.9 * (since + (until - since) * (time + at / length) / times))
            x, want = before[at:at + training.window], wanted[at:at + training.window]
            states, cache = gru.forward(np.take(table, x, axis=0).transpose(0, 2, 1), params["recurrent"], h)
            h = states[-1]
            flat = states[1:].transpose(0, 2, 1).reshape(-1, hidden)
            many = len(flat) - (streams - last if at + training.window >= length else 0)
            d_flat = np.zeros_like(flat)
            _, grads, d_flat[:many] = softmax_step(params, flat[:many], want.ravel()[:many], training.class_size)
            d_states = np.ascontiguousarray(d_flat.reshape(*x.shape, hidden).transpose(0, 2, 1))
            d_x, grads["recurrent"] = gru.backward(d_states, states, cache, params["recurrent"])
            order = np.argsort(x, axis=None, kind="stable")
            ids = x.ravel()[order]
            starts = runs(ids)
            grads["table"] = np.zeros_like(table)
            by_gate = np.take(d_x.transpose(1, 0, 2).reshape(3 * hidden, -1), order, axis=1)
            grads["table"][ids[starts]] = np.add.reduceat(by_gate, starts, axis=1).T
            adam.update(grads)
    return words


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters that `flat` put one after the other."""
    names = sorted(like)
    parts = np.split(values.astype(np.float32), np.cumsum([like[k].size for k in names])[:-1])
    return {k: part.reshape(like[k].shape) for k, part in zip(names, parts, strict=True)}


def units(size: int) -> tuple[int, int]:
    """Rounds, and workers of a round, for a corpus of so many bytes."""
    many = max(1, -(-size // BYTES_PER_UNIT))
    return min(ROUNDS, many), -(-many // ROUNDS)


def pieces(batches: Iterator[pa.RecordBatch], workers: int) -> Iterator[pa.RecordBatch]:
    """(worker, place, ids, inside) of whole documents (id0, ids). A long one is cut, so that many workers share it.

    Equal rows of a batch are told apart by their number, so that copies of one row are shared as well.
    """
    for batch in batches:
        nth: Counter[int] = Counter()
        rows = []
        for id0, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = np.frombuffer(_spread(data), "<u2")
            for lo in range(0, len(text), PIECE):
                place = xxhash.xxh64_intdigest(np.array([id0, lo, nth[id0]], "<i8").tobytes())
                rows.append((place % workers, place >> 1, _squeezed(text[max(lo - 1, 0):lo + PIECE].tobytes()), lo > 0))
            nth[id0] += 1
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["worker", "place", "ids", "inside"])


def work(begin: dict[str, np.ndarray], training: Training, times: int, since: float, until: float) -> Callable[[pa.Table], pa.Table]:
    """What a worker makes of its pieces: parameters, in chunks."""
    def made(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "inside", "ids", "worker")), strict=True))
        own = {k: v.copy() for k, v in begin.items()}
        words = learn(own, [(np.frombuffer(_spread(r[2]), "<u2"), r[1]) for r in rows], training, times, since, until)
        chunks = [(k, rows[0][3], words, chunk.astype("<f4").tobytes()) for k, chunk in enumerate(np.array_split(flat(own), CHUNKS))]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*chunks, strict=True), kinds, strict=True)], ["chunk", "worker", "words", "params"])

    return made


def averaged(table: pa.Table) -> pa.Table:
    """The mean of one chunk of all workers' parameters, by the words that each has read."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "worker", "words", "params")), strict=True))
    words = sum(r[2] for r in rows)
    mean = sum(np.frombuffer(r[3], "<f4").astype(float) * (r[2] / words) for r in rows)
    return pa.Table.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([mean.astype("<f4").tobytes()], pa.binary())], ["chunk", "params"])


def trained(encoded: DataFrame, size: int, seen: np.ndarray, training: Training) -> dict[str, np.ndarray]:
    """Parameters learned from every word of the documents (id0, learned, ids) that are to be learned from.

    Each round has its own share of the documents. Its workers begin with the same parameters, each learns from its
    share of the round, and their mean begins the next round. Only parameters leave a task, and only their mean reaches the driver.
    """
    rounds, workers = units(size)
    times, params = passes(int(seen.sum()), training), begun(seen, training)
    share = F.pmod(F.xxhash64("id0"), F.lit(rounds))
    for number in range(rounds):
        told = encoded.where(F.col("learned") & (share == number)).select("id0", "ids").mapInArrow(
            lambda batches: pieces(batches, workers), "worker int, place long, ids binary, inside boolean")
        learned = told.repartitionById(workers, "worker").groupBy("worker").applyInArrow(
            work(params, training, times, number / rounds, (number + 1) / rounds), "chunk int, worker int, words long, params binary")
        mean = learned.groupBy("chunk").applyInArrow(averaged, "chunk int, params binary").collect()
        if mean:
            params = shaped(np.concatenate([np.frombuffer(bytes(r.params), "<f4") for r in sorted(mean)]), params)
    return params


def word_values(states: np.ndarray, want: np.ndarray, model: Model) -> np.ndarray:
    """Natural log-probabilities of the wanted words after states (N, H)."""
    classes, size, _ = model.to_word.shape
    outer, inner = np.column_stack([model.to_class, model.class_bias]), np.concatenate([model.to_word, model.word_bias[..., None]], axis=2)
    order, safe = in_order(want, classes * size), bounded(states, outer, inner)
    ids, own = want[order].astype(np.int64), with_ones(np.take(states, order, axis=0))
    which, within = np.divmod(ids, size)
    value = np.zeros(len(ids))
    for part in (slice(lo, lo + CACHED) for lo in range(0, len(ids), CACHED)):
        value[part] = powers(own[part], outer, which[part], safe)[3]
    for c, part in blocks(which, classes):
        value[part] += powers(own[part], inner[c], within[part], safe)[3]
    out = np.empty(len(want))
    out[order] = value
    return out


def log_likelihoods(texts: list[np.ndarray], model: Model, window: int = 64) -> np.ndarray:
    """Natural log-probability of each whole sequence of word ids; the state is carried across windows.

    A sequence starts as in training, where documents follow each other, but from a zero state.
    """
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    classes, size, hidden = model.to_word.shape
    begin = np.cumsum(sizes[order]) - sizes[order]
    flat = np.concatenate([texts[k] for k in order])
    lengths = sizes[order]
    total, rows = np.zeros(len(texts)), np.ascontiguousarray(model.table.T)
    h = np.zeros((hidden, len(texts)), np.float32)
    before = np.full(len(texts), classes * size)
    for at in range(0, int(lengths[0]), window):
        live = int(np.searchsorted(-lengths, -at, "left"))
        steps = min(window, int(lengths[0]) - at)
        h, before = np.ascontiguousarray(h[:, :live]), before[:live]
        there = at + np.arange(steps)[:, None] < lengths[:live]
        ids = flat[np.minimum(begin[:live] + at + np.arange(steps)[:, None], len(flat) - 1)]
        states = np.empty((steps, hidden, live), np.float32)
        for t in range(steps):
            h = states[t] = gru.step(np.ascontiguousarray(np.take(rows, before, axis=0).T), model.recurrent, h)
            before = ids[t]
        doc = np.nonzero(there)[1]
        want = ids[there]
        known = states.transpose(0, 2, 1).reshape(-1, hidden)
        known = known if there.all() else known[there.ravel()]
        value = np.concatenate([word_values(known[k:k + SLICE], want[k:k + SLICE], model) for k in range(0, len(want), SLICE)])
        total[:live] += np.bincount(doc, value, live)
    out = np.empty(len(texts))
    out[order] = total
    return out


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


#: Rows that tasks exchange. Of each batch of documents: its words by partition of their hash, with the counts
#: they add; and once, on its way to the batch's own partition, its documents, how many tokens each has, and all tokens in order.
ASKED = "part int, batch long, first int, words binary, trained binary, ids binary, learned binary, sizes binary, flat binary"
ASKED_NAMES = ["part", "batch", "first", "words", "trained", "ids", "learned", "sizes", "flat"]
#: Counts of a batch's words on their way back and their ids in the vocabulary, the batch's own row, and the totals of a partition of words.
REPLY = "part int, batch long, first int, counts binary, known binary, ids binary, learned binary, sizes binary, flat binary, totals array<long>"
REPLY_NAMES = ["part", "batch", "first", "counts", "known", "ids", "learned", "sizes", "flat", "totals"]
ANSWER = "id0 long, id1 long, learned boolean, ids binary, n_tokens long, unknown long, logs double, tail_logs double, known long, totals array<long>"
ANSWER_NAMES = ["id0", "id1", "learned", "ids", "n_tokens", "unknown", "logs", "tail_logs", "known", "totals"]


def home(batch: int, parts: int) -> int:
    """The partition that a batch's own row passes through. By hash: batches are numbered from high bits, so their remainders would be few."""
    return xxhash.xxh64_intdigest(batch.to_bytes(8, "little")) % parts


def cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows anew in tables of about `most` bytes of the last column, an end included; no row is cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy().astype(np.int64) + BYTES_PER_TOKEN)
        lo = 0
        while lo < len(ends):
            before = int(ends[lo - 1]) if lo else 0
            hi = min(int(np.searchsorted(ends, before + most - size)) + 1, len(ends))
            held.append(batch.slice(lo, hi - lo))
            size += int(ends[hi - 1]) - before
            lo = hi
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def told_apart(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of texts (UTF-8 bytes), all tokens as their numbers, and how many each text has; as `tokens` gives them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    found = lists.flatten().dictionary_encode()
    names, flat = found.dictionary.cast(pa.binary()).to_pylist(), found.indices.to_numpy()
    # White space at either end of a text leaves an empty word, whose number becomes the end's.
    end = names.index(b"") if b"" in names else len(names)
    names[end:end + 1] = [END]
    there = flat != end
    words = np.bincount(np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[there], minlength=len(texts))
    return names, np.insert(flat[there], np.cumsum(words), end), words + 1


def asked(parts: int, batch: int, ids: np.ndarray, learned: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """What one task tells of a batch of documents. Words are numbered by partition, so each partition has a range of them."""
    names, flat, sizes = told_apart(texts)
    part_of = (np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)) % np.uint64(parts)).astype(np.int64)
    by_part = np.argsort(part_of, kind="stable")
    place = np.empty(len(names), "<i4")
    place[by_part] = np.arange(len(names))
    flat = place[flat]
    trained = np.bincount(flat[np.repeat(learned, sizes)], minlength=len(names)).astype("<i4")
    ordered = part_of[by_part]
    bounds = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
    rows = [(int(ordered[lo]), batch, lo, _squeezed(b" ".join([names[k] for k in by_part[lo:hi].tolist()])), _squeezed(trained[lo:hi].tobytes()), *[None] * 4)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    # Of the numbers' bytes, first all lowest ones, and so on: they take less room.
    planes = flat.view(np.uint8).reshape(-1, 4).T
    rows.append((home(batch, parts), batch, None, None, None, ids.astype("<i8").tobytes(), learned.astype(np.uint8).tobytes(), _squeezed(sizes.astype("<i8").tobytes()), _squeezed(planes.tobytes())))
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ASKED_NAMES)


def asking(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """ASKED of documents (id0, id1, learned, text)."""
    number = TaskContext.get().partitionId() << 32
    for number, table in enumerate(cut(batches, COUNT_AT_ONCE * BYTES_PER_TOKEN), number):
        id0, id1, learned, texts = (c.combine_chunks() for c in table.columns)
        yield asked(parts, number, np.column_stack([id0.to_numpy(), id1.to_numpy()]), learned.to_numpy(zero_copy_only=False), texts)


def added(rows: list[tuple[bytes, bytes]]) -> tuple[dict[bytes, int], list[np.ndarray], np.ndarray]:
    """Of rows (words, trained) of one partition of words: the words' numbers, the words of each row as numbers, and the counts of all."""
    number: dict[bytes, int] = {}
    read = []
    for words, _ in rows:
        names = _spread(words).split(b" ")
        read.append(np.fromiter((number.setdefault(w, len(number)) for w in names), np.int64, len(names)))
    count = np.zeros(len(number), np.int64)
    for index, (_, trained) in zip(read, rows, strict=True):
        count[index] += np.frombuffer(_spread(trained), "<i4")  # the words of one batch are distinct
    return number, read, count


def often(table: pa.Table) -> pa.Table:
    """(word, n) of the words of one partition that may come into the vocabulary; under null how often all others are used."""
    number, _, count = added(list(zip(*(table.column(c).to_pylist() for c in ("words", "trained")), strict=True)))
    rows = [(w, n) for w, n in zip(number, count.tolist(), strict=True) if n > 2 or w == END]
    rows.append((None, int(count.sum()) - sum(n for _, n in rows)))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.binary(), pa.int64()], strict=True)], ["word", "n"])


def summed(told: DataFrame, parts: int) -> DataFrame:
    """(word, n) as `vocabulary` needs them, from what tasks told of their documents."""
    words = told.where("words IS NOT NULL").select("part", "words", "trained")
    return words.repartitionById(parts, "part").groupBy("part").applyInArrow(often, "word binary, n long")


def counted(table: pa.Table, vocabulary: dict[bytes, int], parts: int) -> pa.Table:
    """The counts of one partition of words, addressed to the batches that asked, and the partition's totals."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ASKED_NAMES), strict=True))
    words = [row for row in rows if row[3] is not None]
    number, read, count = added([row[3:5] for row in words])
    known = np.fromiter((vocabulary.get(w, 0) for w in number), "<u2", len(number))
    seen, tail = count > 0, known == 0
    totals = [int(x) for x in (count.sum(), seen.sum(), count[tail].sum(), (seen & tail).sum())]
    out = [(row[0], row[1], None, None, None, *row[5:], None) for row in rows if row[3] is None]
    out += [(home(row[1], parts), row[1], row[2], _squeezed(count[index].astype("<i8").tobytes()), _squeezed(known[index].tobytes()), *[None] * 5)
            for row, index in zip(words, read, strict=True)]
    if words:
        out.append((0, -1, *[None] * 7, totals))
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], REPLY_NAMES)


def answered(table: pa.Table) -> pa.Table:
    """Sums per document of one batch, and its tokens as ids of the vocabulary; of the rows of totals, their sum."""
    rows = list(zip(*(table.column(c).to_pylist() for c in REPLY_NAMES[2:]), strict=True))
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
    if rows[0][-1] is not None:
        total = np.sum([r[-1] for r in rows], axis=0).tolist()
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip([*[None] * 9, total], kinds, strict=True)], ANSWER_NAMES)
    own = next(r for r in rows if r[3] is not None)
    replies = sorted((r for r in rows if r[3] is None), key=lambda r: r[0])
    count = np.concatenate([np.frombuffer(_spread(r[1]), "<i8") for r in replies])
    known = np.concatenate([np.frombuffer(_spread(r[2]), "<u2") for r in replies])
    keys = np.frombuffer(own[3], "<i8").reshape(-1, 2)
    sizes = np.frombuffer(_spread(own[5]), "<i8")
    flat = np.frombuffer(_spread(own[6]), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
    doc, ids, ends = np.repeat(np.arange(len(keys)), sizes), known[flat], np.cumsum(sizes)
    logs = np.log10(count + 0.5)
    sums = [np.bincount(doc, x[flat], len(keys)) for x in (known == 0, logs, logs * (known == 0), count > 0)]
    texts = [_squeezed(ids[end - size:end].tobytes()) for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]
    columns = [keys[:, 0], keys[:, 1], np.frombuffer(own[4], np.uint8).astype(bool), texts, sizes, sums[0].astype(np.int64), sums[1], sums[2], sums[3].astype(np.int64), [None] * len(keys)]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ANSWER_NAMES)


def scored(docs: DataFrame, training: Training = Training(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, unknown) per row of docs.

    Learned are the network, vocabulary, biases and counts from all documents that have a key and are not held out. A null text is empty and has the end alone. Repeated rows count each and get equal scores.
    `unknown` is the number of words outside the network's vocabulary. Scores are base-10 logarithms.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).cast("binary").alias(ENCODED)).select(
        "key", F.xxhash64("key", ENCODED).alias("id0"), F.xxhash64(ENCODED, "key").alias("id1"), held_out("key", MODULUS).alias("held"), ENCODED)
    size = read.agg(F.sum(F.octet_length(ENCODED))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_PER_PARTITION))
    told = stage(read.select("id0", "id1", F.expr("NOT held AND key IS NOT NULL").alias("learned"), ENCODED).mapInArrow(lambda batches: asking(batches, parts), ASKED), "told")
    counts = stage(summed(told, parts), "counts")
    word_ids, seen = vocabulary(counts, training)
    discard(counts)
    replies = told.repartitionById(parts, "part").groupBy("part").applyInArrow(lambda t: counted(t, word_ids, parts), REPLY)
    answers = stage(replies.repartition(parts, "batch").groupBy("batch").applyInArrow(answered, ANSWER), "answers")
    discard(told)
    del replies
    release(spark)
    total = answers.where("totals IS NOT NULL").agg(*[F.sum(F.col("totals")[k]).alias(c) for k, c in enumerate(("n", "v", "tail_n", "tail_v"))]).first()
    totals = Totals(*(x or 0 for x in total))
    encoded = answers.where("totals IS NULL")
    model = finished(trained(encoded, size, seen, training), word_ids)
    names = ["id0", "id1", "n_tokens", "unknown", "logs", "tail_logs", "known", "network"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        many = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(log_likelihoods(texts, model) / np.log(10))], names)

        for batch in batches:
            rows, ids, lo = batch.select(names[:-1]), batch.column(batch.num_columns - 1).to_pylist(), 0
            for k, data in enumerate(ids, 1):
                texts.append(np.frombuffer(_spread(data), "<u2").astype(np.int32))
                many += len(texts[-1])
                if many >= SCORE_AT_ONCE or k == len(ids):
                    held.append(rows.slice(lo, k - lo))
                    lo = k
                if many >= SCORE_AT_ONCE:
                    yield flush()
                    held, texts, many = [], [], 0
        if texts:
            yield flush()

    network = encoded.select(*names[:-1], "ids").mapInArrow(
        score, "id0 long, id1 long, n_tokens long, unknown long, logs double, tail_logs double, known long, network double")
    network = stage(network, "network")
    # Equal rows have equal values, but for rounding.
    sums = stage(network.groupBy("id0", "id1").agg(*[F.min(c).alias(c) for c in names[2:]]), "sums")
    discard(answers, network)
    both = read.select("key", "id0", "id1", "held").join(sums, ["id0", "id1"])
    base = float(np.log10(totals.n + 0.5 * (totals.v + 1)))
    tail = float(np.log10(totals.tail_n + 0.5 * (totals.tail_v + 1)))
    return both.select(
        F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(int(totals.n)).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("network") + F.col("tail_logs") - F.col("unknown") * tail).alias("score"), "unknown")
