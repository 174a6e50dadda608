"""Benchmark decontamination by winnowing, in DataFrame and SQL functions alone.

Each text's words give hashes of every 5 consecutive words; of each 4 consecutive hashes the least is a
fingerprint. Two texts that share 8 words in a row share the 4 hashes inside them, so they share a
fingerprint: that is certain, not likely. Training fingerprints are joined with the benchmark's (Spark
broadcasts these if they are small when it gets there, and shuffles both sides otherwise); texts with a hit
are extended exactly, by the words themselves, to all windows of 8 words. Items of fewer than 8 words are
one window each, looked up by all consecutive words of the same number.

Texts are worked on once per distinct text, under a 160-bit name, so that copies of one text are no hot
group. Defined results: null texts and item texts without words match nothing; rows of the benchmark
without an item_id are left out; several rows of one item_id are one item; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Scratch, ascii_lower, text_key

WINDOW, GRAM = 8, 5
#: Windows of the benchmark (some 100 bytes each) that are broadcast at most; beyond it, tasks that one window is dealt over.
BROADCAST_WINDOWS, SALT = 200_000, 32
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, array<string>; a null text has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS, -1)
    return F.filter(parts, lambda w: w != "")


def _grams(array: Column, n: int) -> Column:
    """Hashes of every n consecutive elements of an array, array<long>; empty if it has fewer."""
    at = F.sequence(F.lit(1), F.size(array) - (n - 1))
    return F.when(F.size(array) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(array, i + (j - 1)) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def held(df: DataFrame, name: str, column: Column, *keep: str) -> DataFrame:
    """df's columns `keep` and the column, computed once a row: later expressions cannot be merged into it."""
    return df.select(*keep, F.explode(F.array(column)).alias(name))


def hashed(df: DataFrame, *keep: str) -> DataFrame:
    """hashes: one for each of the words."""
    return held(df, "hashes", F.transform("words", lambda w: F.xxhash64(w)), *keep)


def fingerprints(df: DataFrame, *keep: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """From the column hashes, rows (keep, hash) of each text's winnowed fingerprints."""
    span = window - gram + 1
    df = held(df, "grams", _grams(F.col("hashes"), gram), *keep).where(F.size("grams") >= span)
    least = F.transform(F.sequence(F.lit(0), F.size("grams") - span), lambda i: F.least(*[F.get("grams", i + j) for j in range(span)]))
    return df.select(*keep, F.explode(F.array_distinct(least)).alias("hash"))


def short_grams(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """Rows (keep, hash) of every `size` consecutive words."""
    return df.select(*keep, F.explode(F.array_distinct(_grams(F.col("hashes"), size))).alias("hash"))


def _windows(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """Rows (keep, at, window) of all `size` consecutive words of the column words."""
    at = F.sequence(F.lit(0), F.size("words") - size)
    spans = F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, size), " ").alias("window")))
    return df.where(F.size("words") >= size).select(*keep, F.explode(spans).alias("w")).select(*keep, "w.at", "w.window")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, id (text name), n_words, n_hit, n_items, items (sorted strings), items_sha256."""
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    items = held(benchmark.where("item_id is not null"), "words", words(F.col("text")), "item_id").where("size(words) > 0")
    items = scratch.write(items, "items")
    short = sorted(r[0] for r in items.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect())  # under `window` values

    rows = docs.select("doc_id", text_key(F.col("text")).alias("id"), "text")
    split = held(rows, "words", words(F.col("text")), "doc_id", "id")

    itemised = hashed(items, "item_id", "words")
    known = fingerprints(itemised.where(F.size("words") >= window), "item_id", window=window, gram=gram)
    for n in short:
        known = known.unionByName(short_grams(itemised.where(F.size("words") == n), n, "item_id"))
    known = scratch.write(known.select("hash").distinct(), "known")

    marked = hashed(split, "id")
    prints = fingerprints(marked, "id", window=window, gram=gram)
    for n in short:
        prints = prints.unionByName(short_grams(marked, n, "id"))
    hits = scratch.write(prints.join(known, "hash", "left_semi").select("id").distinct(), "hits")
    found = scratch.write(split.select("id", "words").join(hits, "id", "left_semi").dropDuplicates(["id"]), "found")

    sizes = [window, *sorted(short)]
    table = None
    for n in sizes:
        part = items.where(F.size("words") >= window) if n == window else items.where(F.size("words") == n)
        part = _windows(part, n, "item_id").select("item_id", F.lit(n).alias("n"), "window").distinct()
        table = part if table is None else table.unionByName(part)
    # a window once, with the set of all its items: a passage that many items share is no more rows than any other
    table = table.groupBy("n", "window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    table = scratch.write(table.withColumn("set", F.sha1(F.to_json("items").cast("binary"))), "windows")
    sets = scratch.write(table.groupBy("set").agg(F.first("items").alias("items")), "sets")
    size = table.agg(F.count("*").alias("windows"), F.sum(F.size("items")).alias("items")).first()
    few = size["windows"] <= BROADCAST_WINDOWS and (size["items"] or 0) <= 4 * BROADCAST_WINDOWS
    met = None
    for n in sizes:
        known_here = table.where(F.col("n") == n).select("window", "set")
        here = _windows(found, n, "id")
        if few:
            here = here.join(F.broadcast(known_here), "window")
        else:  # a window that a third of all texts hold is dealt over SALT tasks
            here = here.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT))).join(known_here.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["window", "salt"])
        here = here.select("id", "at", "set", F.lit(n).alias("n"))
        met = here if met is None else met.unionByName(here)
    met = scratch.write(met, "met")
    covered = met.groupBy("id").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    covered = covered.select("id", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))).cast("long").alias("n_hit"))
    named = met.select("id", "set").distinct().join(F.broadcast(sets) if few else sets, "set")
    named = named.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    results = scratch.write(covered.join(named, "id"), "results")
    scratch.drop("known", "hits", "found", "met", "sets")

    sized = split.select("doc_id", "id", F.size("words").cast("long").alias("n_words"))
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return sized.join(results, "id", "left").select(
        "doc_id", "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
        items_col.alias("items"), F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"), (F.size(items_col) >= 2).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """The documents without those that hold windows of min_items benchmark items or more."""
    bad = contamination(docs, benchmark).where(F.col("n_items") >= min_items).select(F.col("id").alias("_tilewright_id")).distinct()
    return docs.join(bad, text_key(docs["text"]) == F.col("_tilewright_id"), "left_anti")
