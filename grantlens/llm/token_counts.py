"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content and a tokenizer by the SHA-256 of its file,
its library and the normal form. Counts are kept in a table by these two digests. A run joins the
distinct contents of its documents to the stored counts, encodes each content that has none once, adds
these counts to the table, and gives every document the count of its content. A run that is stopped
leaves whole counts or none, and two runs that add the same content add the same number.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import reduce_by
from .common import discard, stage

LIMIT = 2048
CACHE = "content binary, n_tokens long, tokenizer string"
SPACE = r"[\x20\x09-\x0D]+"
#: Characters encoded in one call of the library; a longer text is a call of its own.
AT_ONCE = 1 << 18
#: Splits that no white space belongs to: what they find in a text they find in its words.
SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: Words whose counts a worker keeps, and the bytes of the longest of them.
KEEP, WORD_BYTES = 1 << 19, 64
#: Missing digests of at most this many bytes travel to every task; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def folds_space(path: str) -> bool:
    """Whether the tokenizer itself makes one space of every run of white space, before it does anything that could tell runs apart.

    Just then may a run be folded ahead of the digest. Letters are never folded ahead: composed forms
    exist of some small letters whose capitals have none, so lower-casing first can change the tokens.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        definition = json.load(file)
    if any(token.get("normalized") or any(c.isspace() for c in token["content"]) for token in definition.get("added_tokens") or []):
        return False
    steps = (definition.get("normalizer") or {}).get("normalizers", [])
    for step in steps:
        if step["type"] == "Replace":
            return step.get("pattern") == {"Regex": r"\s+"} and step.get("content") == " "
        if step["type"] != "NFC":
            return False
    return False


def counts_by_words(path: str) -> bool:
    """Whether a text has the tokens of its words, ASCII white space between them.

    So it is where white space is folded and then removed by a split that keeps none of it, so that no token,
    composed letter or added token reaches across.
    """
    if not folds_space(path):
        return False
    with open(path, encoding="utf-8") as file:
        definition = json.load(file)
    if any(token.get("single_word") for token in definition.get("added_tokens") or []):
        return False
    steps = definition.get("pre_tokenizer") or {}
    first, *rest = steps.get("pretokenizers") or [steps]
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern", {}).get("Regex") in SPLITS
    follow = [step["type"] for step in definition["normalizer"]["normalizers"]]
    return bool(kept) and set(follow[follow.index("Replace") + 1:]) <= {"Lowercase"} and all(
        step["type"] == "ByteLevel" and not step["add_prefix_space"] and not step["use_regex"] for step in rest)


def version(path: str) -> str:
    """The tokenizer's digest: another file, library version or normal form never meets the counts of this one."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    digest = hashlib.sha256(f"{library.__name__} {library.__version__} {folds_space(path)}\n".encode())
    digest.update(Path(path).read_bytes())
    return digest.hexdigest()


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from texts to their token counts: nothing added, cut or padded, special strings as the library has them."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in pieces.encode(texts, add_bos=False, add_eos=False, num_threads=1)]


def in_calls(count, texts: list) -> list[int]:
    """The counts of texts, in calls of bounded size."""
    counts, held, size = [], [], 0
    for text in texts:
        if held and size + len(text) > AT_ONCE:
            counts += count(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    return counts + (count(held) if held else [])


@lru_cache(maxsize=2)
def byte_counter(path: str):
    """The same for texts in UTF-8. Where a text has the tokens of its words, the library gets each word once."""
    count, known = counter(path), {}

    def by_texts(texts: list[bytes]) -> list[int]:
        return in_calls(count, [t.decode("utf-8", "replace") for t in texts])

    def by_words(texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]
        new = list(set().union(*words) - known.keys())
        known.update(zip(new, by_texts(new), strict=True))
        counts = [sum(map(known.__getitem__, w)) for w in words]
        if len(known) > KEEP or any(len(w) > WORD_BYTES for w in new):
            # The first words of a corpus are its frequent ones.
            for w in new:
                if len(known) > KEEP or len(w) > WORD_BYTES:
                    del known[w]
        return counts

    return by_words if counts_by_words(path) else by_texts


def normalised(text: Column, path: str) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.regexp_replace(whole, SPACE, " ") if folds_space(path) else whole


def encoded(contents: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of a table (content, text as bytes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start a thread for each of the machine's
        count = byte_counter(path)
        for batch in batches:
            counts = in_calls(count, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return contents.mapInArrow(rows, "content binary, n_tokens long")


def open_cache(spark: SparkSession, cache: str) -> None:
    """Make the table if there is none yet."""
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer; a content that two runs added counts once."""
    own = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return reduce_by(own, ["content"], F.max("n_tokens").alias("n_tokens"))


def add_missing(docs: DataFrame, told: DataFrame, cache: str, path: str, text: str) -> int:
    """Encode every distinct content of the documents that the cache lacks, append the counts, and say how many they were."""
    spark, tokenizer = docs.sparkSession, version(path)
    missing = stage(told.select("content").distinct().join(stored(spark, cache, tokenizer), "content", "left_anti"), "missing")
    n = missing.count()
    if n:
        texts = docs.select(F.col(text).alias("text")).select(normalised(F.col("text"), path).alias("text"))
        texts = texts.select(F.unhex(F.sha2("text", 256)).alias("content"), F.col("text").cast("binary").alias("text"))
        if n * 48 <= BROADCAST_BYTES:
            # Only texts to encode travel, each once from a task.
            wanted = texts.join(F.broadcast(missing), "content", "left_semi").dropDuplicates(["content"])
        else:
            # Copies are dropped inside each task first, so that a text of a third of all rows doesn't gather.
            wanted = texts.dropDuplicates(["content"]).join(missing, "content", "left_semi")
        encoded(wanted, path).withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    discard(missing)
    return n


def token_counts(docs: DataFrame, cache: str, path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row of docs.

    `cache` names the table of counts, in a folder that driver and executors share; it is made if
    absent and grows by the contents it lacked. `path` names the tokenizer: a .json of `tokenizers`
    or a .model of `sentencepiece`. A null text is an empty one. Every row gets its row, rows without
    a key too; equal texts get equal counts; other columns are not read.
    """
    path = path or default_tokenizer()
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    told = docs.select(F.col(key).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"),
                       F.unhex(F.sha2(normalised(F.col(text), path), 256)).alias("content"))
    told = stage(told, "contents")
    open_cache(spark, cache)
    add_missing(docs, told, cache, path, text)
    counts = stored(spark, cache, version(path))
    return told.join(counts, "content").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
