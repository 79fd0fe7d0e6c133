"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of bytes. One network reads each window forwards, one backwards; the two
states at a byte give the language probabilities of that position. A document's probabilities are the
mean over all its positions. The network is trained in numpy by backpropagation through time on a
bounded sample of windows, every position of which is to have the document's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import gru
from .common import ENCODED, lowest

UNDETERMINED = "und"
WINDOW = 64
PAD = 256


class Training(NamedTuple):
    """Bounds of the labelled sample and of the fit; they do not depend on the corpus."""

    documents_per_language: int = 400
    windows_per_document: int = 8
    hidden: int = 8
    batch: int = 256
    steps: int = 300
    rate: float = 0.02
    seed: int = 7


class Model(NamedTuple):
    languages: tuple[str, ...]
    forward: tuple[np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def held_out(key: str, modulus: int = 3, remainder: int = 1) -> Column:
    """Whether a row is kept from training; one without key is never held out, and never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, training: Training, key: str, text: str, lang: str) -> list:
    """(lang, bytes) windows of documents that may be learned from.

    The documents are the first of each language in the order of a hash; windows start at hashed
    places of the whole text. At most documents_per_language * windows_per_document per language.
    """
    ids = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & ~held_out(key)).select(
        F.col(key).alias("id"), F.col(lang).alias("lang"))
    most = training.documents_per_language
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    low = ids.join(ids.groupBy("lang").agg(F.count("*").alias("rows")), "lang").where(lowest(F.xxhash64("id"), most, F.col("rows")))
    chosen = low.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("id").distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("b")).join(F.broadcast(chosen), "id", "left_semi")
    starts = F.transform(F.sequence(F.lit(1), F.lit(training.windows_per_document)),
                         lambda k: F.pmod(F.xxhash64("id", k), F.greatest(F.octet_length("b") - WINDOW + 1, F.lit(1))).cast("int") + 1)
    windows = texts.where("octet_length(b) > 0 AND lang IS NOT NULL").select("lang", "b", F.explode(starts).alias("at"))
    return windows.select("lang", F.expr(f"substring(b, at, {WINDOW})").alias("w")).orderBy("lang", "w").collect()


def train(rows: list, training: Training) -> Model | None:
    """None if nothing is labelled."""
    languages = tuple(sorted({r.lang for r in rows}))
    if not languages:
        return None
    rng = np.random.default_rng(training.seed)
    data = np.full((WINDOW, len(rows)), PAD, np.int64)
    for k, r in enumerate(rows):
        data[:len(r.w), k] = np.frombuffer(bytes(r.w), np.uint8)
    label = np.array([languages.index(r.lang) for r in rows])
    members = [np.flatnonzero(label == k) for k in range(len(languages))]
    size, many = training.hidden, len(languages)
    params = {name: rng.normal(0, 0.3, shape).astype(np.float32) for name, shape in {
        "in_f": (3 * size, PAD + 1), "in_b": (3 * size, PAD + 1), "u_f": (3 * size, size), "u_b": (3 * size, size), "out": (many, 2 * size)}.items()}
    params["bias"] = np.zeros((many, 1), np.float32)
    adam = gru.Adam(params, training.rate)
    for number in range(training.steps):
        adam.rate = training.rate * (1 - 0.9 * number / training.steps)
        pick = np.concatenate([rng.choice(m, max(1, training.batch // many)) for m in members])
        x, want = data[:, pick], label[pick]
        h = np.zeros((size, len(pick)), np.float32)
        states_f, cache_f = gru.forward(params["in_f"][:, x].transpose(1, 0, 2), params["u_f"], h)
        states_b, cache_b = gru.forward(params["in_b"][:, x[::-1]].transpose(1, 0, 2), params["u_b"], h)
        both = np.concatenate([states_f[1:], states_b[1:][::-1]], axis=1)
        logits = params["out"] @ both + params["bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, want, np.arange(len(pick))] -= 1
        p *= (x != PAD)[:, None, :] / max(1, (x != PAD).sum())
        d_both = params["out"].T @ p
        grads = {"out": np.einsum("tlb,thb->lh", p, both, optimize=True), "bias": p.sum(axis=(0, 2))[:, None]}
        for way, d, states, cache, seen in (("f", d_both[:, :size], states_f, cache_f, x), ("b", d_both[::-1, size:], states_b, cache_b, x[::-1])):
            d_x, grads[f"u_{way}"] = gru.backward(d, states, cache, params[f"u_{way}"])
            into = np.zeros((PAD + 1, 3 * size), np.float32)
            np.add.at(into, seen.ravel(), d_x.transpose(0, 2, 1).reshape(-1, 3 * size))
            grads[f"in_{way}"] = into.T
        adam.update({k: g.astype(np.float32) for k, g in grads.items()})
    return Model(languages, gru.halved(params["in_f"], params["u_f"]), gru.halved(params["in_b"], params["u_b"]), params["out"], params["bias"])


def position_sums(windows: np.ndarray, model: Model) -> np.ndarray:
    """For windows of bytes (T, B), PAD where there is none, the summed position probabilities (languages, B)."""
    length, many = windows.shape
    size = model.forward[1].shape[1]
    ahead = np.empty((length, size, many), np.float32)
    table, recurrent = model.forward
    h = np.zeros((size, many), np.float32)
    for t in range(length):
        h = ahead[t] = gru.step(np.take(table, windows[t], axis=1), recurrent, h)
    table, recurrent = model.backward
    h = np.zeros((size, many), np.float32)
    total = np.zeros((len(model.languages), many), np.float32)
    out_f, out_b = model.out[:, :size], model.out[:, size:]
    for t in range(length - 1, -1, -1):
        h = gru.step(np.take(table, windows[t], axis=1), recurrent, h)
        p = out_f @ ahead[t]
        p += out_b @ h
        p += model.bias
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        if t:
            p *= windows[t] != PAD  # a window has at least one byte
        total += p
    return total


def probabilities(texts: list[bytes], model: Model, windows_at_once: int = 4096) -> np.ndarray:
    """(document, language): the mean over all positions of each whole text; no text may be empty."""
    sizes = np.array([len(t) for t in texts])
    counts = -(-sizes // WINDOW)
    sums = np.zeros((len(texts), len(model.languages)))
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.concatenate([np.frombuffer(t.ljust(n * WINDOW, b"\0"), np.uint8) for t, n in zip(texts, counts.tolist(), strict=True)])
    flat = flat.reshape(-1, WINDOW)
    last = np.cumsum(counts) - 1
    rest = sizes - (counts - 1) * WINDOW
    filled = np.full(len(flat), WINDOW)
    filled[last] = rest
    for at in range(0, len(flat), windows_at_once):
        part = flat[at:at + windows_at_once].astype(np.int64)
        part[np.arange(WINDOW) >= filled[at:at + windows_at_once, None]] = PAD
        got = position_sums(np.ascontiguousarray(part.T), model)
        for k in range(got.shape[0]):
            sums[:, k] += np.bincount(owner[at:at + windows_at_once], weights=got[k], minlength=len(texts))
    return sums / sizes[:, None]


def predict(docs: DataFrame, model: Model | None, key: str, text: str, carry: bool = False, bytes_at_once: int = 1 << 22) -> DataFrame:
    """(key, held_out, lang_pred, score) per row; with `carry` also the whole row as a struct."""
    schema = StructType([StructField("key", docs.schema[key].dataType), StructField("held_out", BooleanType()),
                         StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    if carry:
        schema.add("row", docs.schema)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(model is not None)
    read = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), F.when(letters, F.col(text).cast("binary")).alias(ENCODED),
                       *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            names, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            held: list[int] = []
            weight = 0
            for row in range(batch.num_rows + 1):
                if row < batch.num_rows and texts[row].is_valid:
                    held.append(row)
                    weight += len(texts[row].as_buffer())
                if held and (row == batch.num_rows or weight >= bytes_at_once):
                    p = probabilities([texts[k].as_py() for k in held], model)
                    scores[held] = np.clip(p.max(axis=1), 0, 1)
                    for k, best in zip(held, p.argmax(axis=1).tolist(), strict=True):
                        names[k] = model.languages[best]
                    held, weight = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), *batch.columns[3:]], schema.names)

    return read.mapInArrow(rows, schema).withColumnRenamed("key", key)


def identify(docs: DataFrame, training: Training = Training(), key: str = "doc_id", text: str = "text", lang: str = "lang",
             carry: bool = False) -> DataFrame:
    """(key, held_out, lang_pred, score) per row of docs: the language of each whole text.

    Learned from documents that have a key, a text and a language and are not held out. A text that is
    null or has no letter is `und` with score 0, as is every text where nothing is labelled. Language,
    source and key are no input of a prediction, so repeated texts get the same one.
    """
    return predict(docs, train(sample(docs, training, key, text, lang), training), key, text, carry)
