"""Benchmark decontamination in SQL functions: a prefix-filtered join of item windows with documents.

Every window of an item is a set of word shingles. Ordered by how often they occur in the corpus, the
rarest first, a window that is wholly contained in a document shares its first shingle with it, so that
one is the necessary prefix and the only one joined. The shingle's place in the window gives the place
where the window would have to start; it must start and end within the document (position and length
bounds) and be word for word the same there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WINDOW = 13
SHINGLE = 5
#: Up to so many prefix entries, of a few hundred bytes each, are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words; a null text has none."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN, -1), "")


def item_windows(items: DataFrame, key: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words, len) of the distinct windows, and (wid, item) of the items that have them.

    An item of fewer words than the window, but not none, is one window.
    """
    words = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda s: F.slice("all", s, F.lit(window)))).alias("words")).distinct()
    windows = stage(each.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words"), "windows")
    owners = stage(each.join(windows, "words").select("wid", "item"), "owners")
    return windows.withColumn("len", F.size("words")), owners


def shingled(words: str, size: int) -> Column:
    """Hashes of all runs of `size` words; equal hashes are only candidates."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64({parts})) ELSE array() END")


def corpus(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, words): rows with equal id and text are one document here; they have the same result."""
    return docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), words_of(F.col(text)).alias("words"))


def _fits(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int, broadcast_rows: int) -> DataFrame:
    """(id, h, wid, start, len) of every place in the documents where a window occurs."""
    found = None
    sized = windows.withColumn("size", F.least("len", F.lit(shingle)))
    for size in sorted(r["size"] for r in sized.select("size").distinct().collect()):  # at most `shingle` values
        own = sized.where(F.col("size") == size)
        tokens = stage(own.select("wid", F.posexplode(shingled("words", size)).alias("at", "token")), "tokens")
        narrow = docs.select("id", "h", F.size("words").alias("n"), "words", F.posexplode(shingled("words", size)).alias("pos", "token"))
        vocabulary = tokens.select("token").distinct()
        small = _fits(tokens, broadcast_rows)
        known = narrow.select("token").join(F.broadcast(vocabulary) if small else vocabulary, "token", "left_semi")
        counts = stage(known.groupBy("token").agg(F.count("*").alias("n_corpus")), "counts")
        order = Window.partitionBy("wid").orderBy("n_corpus", "token", "at")
        ranked = tokens.join(counts, "token", "left").withColumn("rank", F.row_number().over(order))
        prefix = ranked.where("rank = 1 AND n_corpus > 0").select("wid", "at", "token").join(own.select("wid", "len", "words"), "wid")
        prefix = stage(prefix.select("token", "at", "len", "wid", F.col("words").alias("item_words")), "prefix")
        start = F.col("pos") - F.col("at")
        bound = (F.col("pos") >= F.col("at")) & (start + F.col("len") <= F.col("n"))
        if small:
            near = narrow.join(F.broadcast(prefix), "token").where(bound)
        else:
            near = narrow.drop("words").join(prefix, "token").where(bound)
            again = docs.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "words").dropDuplicates(["id2", "h2"])
            near = near.join(again, F.col("id").eqNullSafe(F.col("id2")) & F.col("h").eqNullSafe(F.col("h2")))
        exact = F.slice("words", start + 1, F.col("len")) == F.col("item_words")
        hits = near.where(exact).select("id", "h", "wid", start.alias("start"), "len")
        found = hits if found is None else found.unionByName(hits)
    return found


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS,
                  with_hash: bool = False) -> DataFrame:
    """(key, n_words, n_hit, items array<string>, spans array<struct<start, stop>>) per row of docs.

    n_hit counts the words inside any occurrence of an item's window, items are the ids (as strings,
    sorted; a null id is empty) of the items with occurring windows. Null texts have no words.
    Repeated rows each get their result; without items or documents nothing is hit. `with_hash` adds h,
    the xxhash64 of the text, by which rows of equal key can be told apart.
    """
    read = corpus(docs, key, text)
    windows, owners = item_windows(items, item_key, item_text, window)
    hits = occurrences(read, windows, shingle, broadcast_rows)
    sizes = read.select("id", "h", F.size("words").cast("long").alias("n_words"))
    spans, names = F.array().cast("array<struct<start:int,stop:int>>"), F.array().cast("array<string>")
    if hits is None:
        return sizes.select(F.col("id").alias(key), "n_words", F.lit(0).cast("long").alias("n_hit"), names.alias("items"), spans.alias("spans"), *["h"] * with_hash)
    owned = hits.distinct().join(owners, "wid")
    by_doc = owned.groupBy(F.col("id").alias("id2"), F.col("h").alias("h2")).agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop")))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.expr("""aggregate(spans, named_struct('upto', 0, 'n', 0L), (a, s) -> named_struct(
        'upto', greatest(a.upto, s.stop), 'n', a.n + greatest(0, s.stop - greatest(a.upto, s.start))), a -> a.n)""")
    both = sizes.join(by_doc, F.col("id").eqNullSafe(F.col("id2")) & F.col("h").eqNullSafe(F.col("h2")), "left")
    return both.select(F.col("id").alias(key), "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
                       F.coalesce("items", names).alias("items"), F.coalesce("spans", spans).alias("spans"), *["h"] * with_hash)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
