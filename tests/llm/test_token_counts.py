"""Token counts against the library, and what the cache keeps."""

import random

import pytest
from tokenizers import Tokenizer

from grantlens.llm import token_counts as tc
from grantlens.session import shared_path

SF_DIR = "/root/testdata/sf0.001"
PATH = tc.default_tokenizer()
TEXTS = [None, "", " ", "One two", "One  two", "One\n\ttwo ", "ONE TWO", "́ x", "W̊ ẘ", "Ǆ ΟΔΟΣ Σ", "İstanbul K", "<|startoftext|>a<|endoftext|>",
         "<|STARTOFTEXT|>", "a  b\u0085c​", "naïve\x00\x1c", "don't 12 345", "😀🏽 é", "word " * 3000, "x" * 200_000, "\n" * 5000]


def want(texts):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def counted(spark, texts, cache=None, **more):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'x' AS content", "2 AS tokenizer")
    return sorted(tuple(r) for r in tc.token_counts(df, cache or shared_path(spark, "counts"), **more).collect())


def test_counts(spark):
    n = want(TEXTS)
    assert counted(spark, TEXTS) == [(k, len((t or "").encode()), c, c > 2048) for k, (t, c) in enumerate(zip(TEXTS, n, strict=True))]
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((tuple(r) for r in tc.token_counts(df, shared_path(spark, "counts")).collect()), key=repr) == sorted([(None, 3, 2, False)] * 2 + [(1, 3, 2, False)], key=repr)
    assert tc.token_counts(df.limit(0), shared_path(spark, "counts")).count() == 0


def test_counts_of_a_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n = want([t for _, t in rows])
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(docs, shared_path(spark, "counts")).collect()}
    assert got == {k: (len((t or "").encode()), c, c > 2048) for (k, t), c in zip(rows, n, strict=True)}


@pytest.mark.parametrize("broadcast", [0, tc.BROADCAST_BYTES])
def test_only_distinct_misses_are_encoded(spark, monkeypatch, broadcast):
    monkeypatch.setattr(tc, "BROADCAST_BYTES", broadcast)
    cache = shared_path(spark, "counts")
    first = ["alpha beta", "alpha  beta", "gamma", None, ""] * 3
    assert counted(spark, first, cache) == counted(spark, first)
    rows = spark.read.parquet(cache)
    assert rows.count() == 3  # a run of spaces is one space: three contents
    counted(spark, [*first, "delta", "delta"], cache)
    assert spark.read.parquet(cache).count() == 4
    counted(spark, [*first, "delta"], cache)
    assert spark.read.parquet(cache).count() == 4


def test_stored_counts_are_used_and_twice_stored_ones_count_once(spark):
    cache = shared_path(spark, "counts")
    counted(spark, ["alpha"], cache)
    spark.read.parquet(cache).selectExpr("content", "CAST(77 AS long) AS n_tokens", "tokenizer").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert [r[2] for r in counted(spark, ["alpha", "alpha"], cache)] == [77, 77]
    spark.read.parquet(cache).selectExpr("content", "CAST(99 AS long) AS n_tokens", "'another' AS tokenizer").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert [r[2] for r in counted(spark, ["alpha"], cache)] == [77]  # another tokenizer's counts are never met


def test_sentence_pieces(spark):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    texts = ["One  two", "One two", " é😀", "</s> <s>", ""]
    assert not tc.folds_space(path) and tc.version(path) != tc.version(PATH)
    assert [r[2] for r in counted(spark, texts, path=path, limit=3)] == [len(library.encode(t)) for t in texts]


def test_folding_space_changes_no_count():
    import re

    rng = random.Random(3)
    library = Tokenizer.from_file(PATH)
    assert tc.folds_space(PATH)
    pieces = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", " ", " ", "́", "̊", "a", "W", "Å", "é", "'s", "'", "<|endoftext|>", "<|", "7", "한", "ᄒ", "ᅡ", "!"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        folded = re.sub(tc.SPACE, " ", text)
        assert library.encode(text, add_special_tokens=False).ids == library.encode(folded, add_special_tokens=False).ids, text


def test_each_word_is_encoded_once(monkeypatch):
    rng = random.Random(5)
    pieces = [" ", "  ", "\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u0301", "\u030a", "a", "W", "\u00c5", "\u03a3", "'s", "'", "<|endoftext|>", "<|", "7", "\u1112", "\u1161", "!", "\u0130"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(3000)] + [t or "" for t in TEXTS] + ["bytes \ufffd"]
    assert tc.counts_by_words(PATH)
    asked, library = [], tc.counter(PATH)
    monkeypatch.setattr(tc, "counter", lambda path: lambda batch: asked.extend(batch) or library(batch))
    for keep in (1 << 19, 10):
        monkeypatch.setattr(tc, "KEEP", keep)
        count = tc.byte_counter.__wrapped__(PATH)
        got = [c for at in range(0, len(texts), 100) for c in count([t.encode() for t in texts[at:at + 100]])]
        assert got == want(texts)
    asked.clear()
    count = tc.byte_counter.__wrapped__(PATH)
    monkeypatch.setattr(tc, "KEEP", 100)
    assert [count([b"one two one"] * 50), count([b"two  one"])] == [[3] * 50, [2]] and sorted(asked) == ["one", "two"]
    assert count([b"bad \xff\xfe x"]) == want(["bad \ufffd\ufffd x"])


def test_words_stand_alone_only_under_a_known_split(tmp_path):
    import json

    definition = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"pre_tokenizer": None}, {"normalizer": None}, {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": r"\s?\p{L}+"}, "behavior": "Removed", "invert": True}}):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(definition | change), encoding="utf-8")
        assert not tc.counts_by_words(str(path))
