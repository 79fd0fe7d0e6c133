"""Packing against the tokenizer's definition, archives against a plain reader, and the whole pipeline."""

import base64
import hashlib
import random

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from grantlens.llm import langid, packing, queries, stages, warc

SF_DIR = "/root/testdata/sf0.001"


def tokens_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary().definition)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def brute_pieces(docs, sequence=2048):
    for (doc_id, _), ids in zip(docs, tokens_of([t for _, t in docs]), strict=True):
        first = len(ids) if len(ids) <= sequence else len(ids) % sequence or sequence
        bounds = [0, *range(first, len(ids) + 1, sequence)]
        for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            yield doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def check_layout(rows, sequence=2048):
    """Gapless sequences; how many there are, and the least there could be."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= sequence
    return len(held), -(-sum(r.length for r in rows) // sequence)


def check_packed(rows, docs):
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    assert got == sorted(brute_pieces(docs), key=repr)
    return check_layout(rows)


def test_packing_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    many, least = check_packed(queries.op1_best_fit_packing(spark, SF_DIR).collect(), docs)
    assert many <= 1.02 * least + 1


def test_packing_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "x <|endoftext|> y"), (4, "word " * 30000), (4, "word " * 30000), (None, "no key"), (5, "a" * 100000), (6, " " * 50000),
            (7, "é\n\n\t" * 2000), (8, "tail\0zero")] + [(100 + k, "w " * (k * 13 % 1500)) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS `key`", "3 AS _task").repartition(4)
    rows = packing.pack(df, with_ids=True).collect()
    check_packed(rows, docs)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize(("seed", "sequence"), [(1, 64), (2, 64), (3, 512), (4, 7)])
def test_plan_uses_every_piece_once(seed, sequence):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(sequence + 1, np.int64)
    for _ in range(sequence // 2 + 1):
        histogram[rng.integers(1, sequence + 1)] += int(rng.integers(1, 10 ** rng.integers(1, 6)))
    made = packing.plan(histogram, sequence)
    used, size = np.zeros_like(histogram), 0
    for repeats, items in made:
        assert repeats > 0 and sum(n * c for n, c in items) <= sequence
        for n, c in items:
            used[n] += repeats * c
        size += repeats
    assert (used == histogram).all()
    assert size <= sum(r for r, _ in packing.best_fit(histogram, sequence)) * 1.02 + 1


def test_rounding_keeps_most_of_the_fit():
    histogram = np.zeros(129, np.int64)
    histogram[[28, 40, 60, 64, 100]] = [5000, 1000, 1000, 800, 4000]
    made = packing.plan(histogram, 128)
    assert sum(r for r, items in made if sum(n * c for n, c in items) == 128) >= 5300


# --- archives ---------------------------------------------------------------------------------

PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://é", "<p>ünïcode</p>" * 2000),
         (5, "http://é", "<p>ünïcode</p>" * 2000), (None, "http://none", "<p>same</p>"), (0, "http://0", "<p>same</p>"), (6, "http://6", "x" * 200000), (7, "http://7", "WARC/1.1\r\n\r\n")]


def brute_pages(pages, least=0):
    first = defaultdict(list)
    for page_id, _, html in pages:
        if page_id is not None:
            first[html or ""].append(page_id)
    for page_id, _, html in pages:
        data = (html or "").encode()
        low = min(first[html or ""], default=None)
        again = page_id is not None and low < page_id and len(data) >= least
        yield page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", low if again else None


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, tmp_path, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS hex", "2 AS `first`", "3 AS refers_to").repartition(2)
    path = str(tmp_path / "w")
    warc.write(df, path, warc.Writing(archive_bytes=300), least_bytes=least)
    got = warc.read(spark, path, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(brute_pages(PAGES, least), key=repr)
    texts = {(k, (h or "").encode()) for k, _, h in PAGES}
    assert all(r.payload is None if r.record_type == "revisit" else (r.page_id, bytes(r.payload)) in texts for r in got)
    files = sorted(Path(path).rglob("part-*"))
    assert len(files) > 2
    for file in files:
        data = file.read_bytes()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY
        size = int.from_bytes(data[4:8], "little")
        shared = zstandard.ZstdCompressionDict(data[8:8 + size])
        plain = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(data[8 + size:], read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")


def test_archives_without_rows(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").limit(0)
    assert warc.archived(df).count() == 0


def test_a_changed_payload_is_found(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(1, "u", "p" * 10)], "page_id long, url string, html string"), path)
    file = next(Path(path).rglob("part-*"))
    fields = list(warc.records_of(file.read_bytes()))
    assert len(fields) == 1 and fields[0][0]["WARC-Type"] == "response"
    bad = warc.record(1, "u", b"other", "AAAA", None, warc.UNDATED)
    file.write_bytes(zstandard.ZstdCompressor().compress(bad))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="not what was archived"):
        warc.read(spark, path).collect()


# --- pipeline ---------------------------------------------------------------------------------


def brute_stages(docs, items, languages):
    from test_duplicates import brute_contamination, brute_simhash
    from test_native_text import base_spans, entropy_spans

    docs = [d for d, (name, score) in zip(docs, languages, strict=True) if name != "und" and score >= stages.least_score(len({n for n, _ in languages} - {"und"})) - 1e-9]
    yield docs
    kept, seen = [], set()
    for d, (doc_id, _, low) in zip(docs, brute_simhash([(d[0], d[1]) for d in docs]), strict=True):
        if doc_id is None or doc_id == low and doc_id not in seen:
            kept.append(d)
            seen.add(doc_id)
    docs = kept
    yield docs
    docs = [d for d, row in zip(docs, brute_contamination([(d[0], d[1]) for d in docs], items), strict=True) if not row[-1]]
    yield docs
    clean = []
    for d in docs:
        text, at, out = d[1], 0, ""
        for a, _, _, b in sorted(base_spans(text) + entropy_spans(text)):
            if a >= at:
                out += text[at:a] + "<secret>"
            at = max(at, b)
        clean.append((d[0], out + text[at:] if out else text, d[2]))
    yield clean


def check_stages(spark, docs, items, sf_dir, read=lambda df: df):
    df = docs
    texts = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    told = {(r.row.doc_id, r.row.text): (r.lang_pred, r.score) for r in langid.identify(docs, carry=True).collect()}
    languages = [told[d[0], d[1]] for d in texts]
    for (name, step), want in zip(stages.STAGES[:-1], brute_stages(texts, items, languages), strict=True):
        df = step(spark, df, sf_dir)
        assert df.columns == docs.columns, name
        path = corpus_pipeline.stage(df)
        assert sorted(((r.doc_id, r.text, r.lang) for r in path.collect()), key=repr) == sorted(want, key=repr), name
        df = path
    rows = stages.STAGES[-1][1](spark, df, sf_dir).collect()
    check_packed(rows, [(d[0], d[1]) for d in want])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    check_stages(spark, docs, items, SF_DIR)
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    many, least = check_layout(rows)
    assert many <= 1.02 * least + 1


def test_pipeline_edge_cases(spark, tmp_path):
    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choice("aehinorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    base = fresh(120)
    docs = [(k, fresh(60), "en") for k in range(40)] + [
        (50, base, "en"), (51, base, "en"), (51, base, "en"), (49, base + " more", "en"), (49, base + " more", "en"), (None, base, "en"), (52, None, "en"), (53, "", None),
        (54, "123 456 !!", "en"), (55, "api_key = '0123456789abcdefXYZ' " + fresh(40), None), (56, fresh(5) + " " + base[:90] + " " + fresh(200), "en"), (57, fresh(15000), "en")]
    items = [(1, " ".join(docs[3][1].split()[5:40])), (2, None), (3, fresh(13))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "CAST(length(text) AS bigint) AS n_chars", "1 AS row", "2 AS h", "3 AS _llm_n2")
    check_stages(spark, df, items, str(tmp_path))
    empty = df.limit(0)
    for _, step in stages.STAGES:
        empty = corpus_pipeline.stage(step(spark, empty, str(tmp_path)))
        assert empty.count() == 0


def test_groups_that_share_their_smallest_id_keep_a_row_each(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join("".join(rng.choice("aehinorstu") for _ in range(6)) for _ in range(80)) for _ in range(4))
    docs = [(51, a), (51, b), (60, b), (61, a), (70, c), (70, d), (70, d), (71, d), (None, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = stages.one_per_group(spark, df, SF_DIR).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(51, a), (51, b), (70, c), (70, d), (None, a)], key=repr)


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]


def test_language_bound_follows_the_number_of_languages():
    assert [round(stages.least_score(n), 3) for n in (1, 2, 4, 10)] == [1.0, 0.533, 0.3, 0.16]
    assert all(1 / n < stages.least_score(n) < 1 for n in range(2, 300))  # above a guess, within reach
