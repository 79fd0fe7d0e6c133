"""Near duplicates, repeated substrings, pivots and contamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from grantlens.llm import decontam, pivots, simhash, substrings
from grantlens.llm.common import components, forest

SF_DIR = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def reach(n, edges):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# --- fingerprints -----------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_simhash(docs):
    prints = [brute_fingerprint(t) for _, t in docs]
    edges = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = reach(len(docs), edges)
    for k, (doc_id, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root[j] == root[k] and docs[j][0] is not None]
        yield doc_id, f"{prints[k]:016x}", min(ids) if ids else None


BASE = " ".join(f"w{k}é" for k in range(300))
DOCS = [(1, None), (2, ""), (3, " \t\n"), (4, BASE), (5, BASE.replace("w7é", "x")), (9, BASE + " tail"), (9, BASE + " tail"), (None, BASE), (6, "One"),
        (7, "ONE"), (8, "one two"), (10, "alone " * 5000), (11, "Alone " * 5001), (12, BASE.replace(" ", " "))]


def test_fingerprints_edge_cases(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS component_id")
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(brute_simhash(DOCS), key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprints_of_a_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = sorted(brute_simhash([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("seed", range(3))
def test_trie_finds_every_link(spark, seed):
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
            x ^= 1 << b
        prints.append(x)
    prints += [0, 7, (1 << 64) - 1]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.trie_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    at = {p: k for k, p in enumerate(signed)}
    got = reach(len(prints), [(at[e.a], at[e.b]) for e in edges])
    assert got == reach(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, k) for k in range(250, 300)] + [(400 + k, 401 + k) for k in range(40)]
    root = reach(500, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root[n] for e in edges for n in e if e[0] != e[1] or n in got}
    a, b = np.array(edges).T
    assert forest(a, b, 500).tolist() == root


# --- embeddings -------------------------------------------------------------------------------


def brute_links(vectors, bound=0.9):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, edges = len(vectors), []
    unit = [pivots.unit(np.array([v], np.float64))[0] if good(v) else None for _, v in vectors]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= bound:
                edges.append((i, j))
    root = reach(n, edges)
    for k, (vec_id, _) in enumerate(vectors):
        if unit[k] is None:
            yield vec_id, 0, vec_id, vec_id is not None
            continue
        ids = [vectors[j][0] for j in range(n) if unit[j] is not None and root[j] == root[k] and vectors[j][0] is not None]
        low = min(ids) if ids else None
        yield vec_id, sum(k in e for e in edges), low, vec_id is not None and vec_id == low


def test_embeddings_edge_cases(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.99, 0.1]), (2, [0.99, 0.1]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [None, 1.0]),
               (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [0.0, 5.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS vec", "3 AS cid")
    want = sorted(brute_links([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in vectors]), key=repr)
    assert rows(pivots.near_duplicates(df), "vec_id", "n_links", "component_id", "kept") == want
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def clustered(seed, clusters, size, noise, loose):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 32))
    points = [centres[k] + rng.normal(size=(size, 32)) * noise for k in range(clusters)] + [rng.normal(size=(loose, 32))]
    return [(k, v.astype(np.float32).astype(float).tolist()) for k, v in enumerate(np.concatenate(points))]


def test_embeddings_blocks_count_every_pair_once(spark):
    """Lists of many blocks, and so many shared pivots that every pair meets in many lists."""
    vectors = clustered(3, 3, 60, 0.05, 40)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = rows(pivots.near_duplicates(df, index=pivots.Index(pivots=16, nearest=7, sample=64, block=8)), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(brute_links(vectors), key=repr)


def test_embeddings_recall(spark):
    """Pairs spread down to the bound itself."""
    vectors = clustered(4, 60, 8, 0.3, 300)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(df).collect()}
    want = {r[0]: r[1] for r in brute_links(vectors)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0


# --- substrings -------------------------------------------------------------------------------


def brute_substrings(docs, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i:i + window]), []).append((k, i))
    gone = {(k, i + j) for places in seen.values() if len(places) > 1 for k, i in places for j in range(window)}
    for k, (doc_id, _) in enumerate(docs):
        kept = [x for i, x in enumerate(words[k]) if (k, i) not in gone]
        yield doc_id, len(words[k]), len(words[k]) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def spliced(seed):
    rng = random.Random(seed)
    fresh = iter(range(10**9))
    passages = [[f"p{next(fresh)}" for _ in range(n)] for n in (34, 35, 36, 52, 53, 70, 200)]
    docs = []
    for k in range(80):
        words = []
        for _ in range(rng.randrange(5)):
            words += [f"u{next(fresh)}" for _ in range(rng.randrange(40))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a:a + rng.choice([20, 34, 35, 40, 300])]
        docs.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    docs += [(100, None), (101, ""), (102, "a " * 300), (103, "Ä " * 34), (104, docs[5][1]), (104, docs[5][1]), (None, docs[6][1]), (None, None), (105, "z y " * 20000)]
    return docs


@pytest.mark.parametrize(("seed", "at_once"), [(1, 1 << 20), (2, 500), (3, 3000)])
def test_substrings(spark, monkeypatch, seed, at_once):
    docs = spliced(seed)
    monkeypatch.setattr(substrings, "WORDS_AT_ONCE", at_once)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS places", "2 AS id0").repartition(3)
    got = substrings.without_repeats(df, with_text=True)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute_substrings(docs), key=repr)
    for r in got.collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(s.stop - s.start for s in r.repeats) == r.n_removed
    assert substrings.without_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_substrings_other_windows(spark, window):
    rng = random.Random(window)
    docs = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(40)))) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substrings.without_repeats(df, window), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute_substrings(docs, window), key=repr)


# --- benchmark --------------------------------------------------------------------------------


def brute_contamination(docs, items, window=13):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            for s in range(max(1, len(iw) - window + 1)) if iw else ():
                k = iw[s:s + window]
                for i in range(len(w) - len(k) + 1):
                    if w[i:i + len(k)] == k:
                        hit |= set(range(i, i + len(k)))
                        names.add("" if item_id is None else str(item_id))
        yield doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


ITEMS = [(1, " ".join(f"q{k}" for k in range(20))), (2, "Short ITEM é"), (3, None), (4, "..."), (5, "one"), (6, " ".join(["dup"] * 15)), (None, "null item words here now"),
         (7, " ".join(f"q{k}" for k in range(3, 17))), (7, "Short ITEM é"), (8, "ÉCOLE x y z v w")]
TEXTS = [(1, ITEMS[0][1]), (2, "q0 q1 q2"), (3, None), (4, "a short, item É! SHORT item é"), (5, "dup " * 40), (5, "dup " * 40), (6, "nothing " * 3000 + " ".join(f"Q{k}." for k in range(2, 16))),
         (None, "null-item words; here now one"), (7, ""), (8, "école x y z v w ÉCOLE X Y Z V W"), (9, "x" * 100000)]


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_contamination(spark, broadcast_rows):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS h", "3 AS wid", "4 AS item")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS words")
    got = decontam.digest(decontam.contamination(docs, items, broadcast_rows=broadcast_rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute_contamination(TEXTS, ITEMS), key=repr)


def test_contamination_without_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.digest(decontam.contamination(docs, items.limit(0))).collect()
    assert len(got) == len(TEXTS) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert decontam.contamination(docs.limit(0), items).count() == 0


def test_contamination_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").coalesce(1)
    plan = decontam.contamination(spark.read.parquet(f"{SF_DIR}/documents.parquet"), docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
