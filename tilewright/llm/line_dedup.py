"""Fuzzy line deduplication over a whole corpus.

Every line gets a MinHash signature over its 8-character shingles, cut into bands; lines that share a
band are held together by exact Jaccard similarity of their shingle sets (0.8 or more), and of each
component of such links, found by distributed union-find, one line stays: the least by
(doc_id, hash of its text, line number). Equal lines are one node and are never paired; lines are told apart by 128
bits of hash, and lines that share the first 64 with another are not linked, so that no hash removes an unlike line.

Defined results: a line of white space alone is never removed; a line shorter than a shingle is like its
equals only; a null text has no lines and stays null; rows alike in doc_id and text are treated alike
(the line that stays does so in each); a null doc_id counts as the least; an empty table gives no rows.
Lines are kept whole however long they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tilewright.llm.columns import byte_sizes
from tilewright.llm.common import Scratch, chunks, mix64, tidy
from tilewright.llm.graph import components
from tilewright.llm.links import verified_links

SHINGLE, ROWS, BANDS, SIMILAR = 8, 3, 8, 0.8
PHASES = ((0, 1, 2), (3, 4, 5, 6, 7))
#: Characters signed at a time: their arrays stay in a core's cache.
CHUNK_CHARS = 300_000
#: What a line of white space alone is made of.
BLANK = " \t\r\x0b\x0c"
#: Candidate ids up to this number (24 bytes each in memory) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_SEEDS = mix64(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64)).astype(np.uint32)


def line_bands(lines: list[str], rows: int = ROWS, bands: int = BANDS, k: int = SHINGLE) -> np.ndarray:
    """MinHash band values, one row a line; lines under k characters get none that another can share (all 0)."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(lines), bands), np.uint64)
    counts = np.maximum(size - k + 1, 0)
    if not counts.any():
        return out
    h, step, p = chars, 1, 0x85EBCA6B
    while step < k:  # hashes of 2, 4, ... characters from those of half as many
        h = h[: len(h) - step] * np.uint32(pow(p, step, 2**32)) + h[step:]
        step *= 2
    valid = np.repeat(np.cumsum(size) - size, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    h = h[valid]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    for b in range(bands):
        value = np.full(len(starts), b + 1, np.uint64)
        for r in range(rows):
            i = 2 * (b * rows + r)
            least = np.minimum.reduceat((h ^ _SEEDS[i % len(_SEEDS)]) * (_SEEDS[(i + 1) % len(_SEEDS)] | np.uint32(1)), starts)
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + least)
        out[some, b] = value
    return out


def _sign(batches):
    """(doc_id, th, text) -> a row a line: doc_id, th, line_no, k1, k2, and bands at the line's first place in the task."""
    seen: set[int] = set()
    for batch in batches:
        docs, hashes = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
        for a, b in chunks(byte_sizes(batch.column("text")), CHUNK_CHARS):
            owner, number, k1, k2, size, fresh, new = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").slice(a, b - a).to_pylist(), a):
                for n, line in enumerate(text.split("\n")):
                    if not line.strip(BLANK):
                        continue
                    data = line.encode("utf-8", "surrogatepass")
                    key = xxh64_intdigest(data, 42)
                    if key not in seen and len(line) >= SHINGLE:
                        seen.add(key)
                        fresh.append(len(owner))
                        new.append(line)
                    owner.append(i)
                    number.append(n)
                    k1.append(key)
                    k2.append(xxh64_intdigest(data, 43))
                    size.append(len(line))
            count = np.zeros(len(owner), np.int32)
            count[fresh] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(line_bands(new).view(np.int64).ravel(), pa.int64()))
            whole = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in owner], pa.int64()), pa.array([hashes[i] for i in owner], pa.int64()), pa.array(number, pa.int32()), whole(k1), whole(k2), bands, pa.array(size, pa.int64())], ["doc_id", "th", "line_no", "k1", "k2", "bands", "size"])


def line_codes(line: str, k: int = SHINGLE) -> tuple[str, np.ndarray]:
    """A line and the sorted distinct 64-bit codes of its shingles."""
    h, step, p = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 1, 0x9E3779B97F4A7C15
    if len(h) < k:
        return line, np.zeros(0, np.uint64)
    while step < k:  # a polynomial in an odd number, of 2, 4, ... characters
        h = h[: len(h) - step] * np.uint64(pow(p, step, 2**64)) + h[step:]
        step *= 2
    h.sort()
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return line, h[new]


def line_jaccard(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    """Exact Jaccard similarity of two lines' shingle codes; below SIMILAR it may be 0."""
    if a[0] == b[0]:
        return 1.0
    x, y = a[1], b[1]
    if not len(x) or not len(y) or min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return 0.0
    whole = np.concatenate([x, y])
    whole.sort(kind="stable")
    both = int(np.count_nonzero(whole[1:] == whole[:-1]))
    return both / (len(whole) - both)


def similar_lines(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> bool:
    return line_jaccard(a, b) >= SIMILAR


def removed_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, th, removed array<int>) of the documents that lose lines; th is xxhash64 of the text."""
    docs = docs.select("doc_id", "text")
    lines = docs.where("text is not null").select(F.explode(F.split("text", "\n", -1)).alias("line")).select(F.xxhash64("line").alias("k1"), "line")
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    signed = scratch.write(rows.mapInArrow(tidy(_sign), "doc_id long, th long, line_no int, k1 long, k2 long, bands array<long>, size long"), "signed")

    def texts(ids: DataFrame) -> DataFrame:
        ids = scratch.write(ids.withColumnRenamed("id", "k1"), "ids")
        few = ids.count() <= BROADCAST_IDS
        return lines.join(F.broadcast(ids) if few else ids, "k1", "left_semi").groupBy(F.col("k1").alias("id")).agg(F.max("line").alias("text"))

    links = verified_links(signed.where("size(bands) > 0").select(F.col("k1").alias("id"), "bands", (8 * F.col("size")).alias("size")), texts, line_codes, similar_lines, scratch, PHASES, lambda x: x[1], SIMILAR)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    classes = signed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th", "line_no")).alias("first"), F.count("*").alias("n"))
    classes = scratch.write(classes.join(roots, classes.k1 == roots.node, "left").where("n > 1 or root is not null").select("k1", "k2", "first", "root"), "classes")
    # a line is named by 128 bits; links name it by the first 64, and hold for lines that share these with no other
    shared = classes.where("root is not null").groupBy("k1").agg(F.count("*").alias("lines")).where("lines > 1").select("k1", F.lit(True).alias("unlike"))
    classes = classes.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, "k1", "left").withColumn("root", F.when(F.col("unlike").isNull(), F.col("root")))
    classes = classes.select("k1", "k2", "first", F.coalesce("root", "k1").alias("c1"), F.when(F.col("root").isNull(), F.col("k2")).otherwise(F.lit(0).cast("long")).alias("c2"), F.col("root").isNotNull().alias("fuzzy"))
    owners = classes.groupBy("c1", "c2", "fuzzy").agg(F.min("first").alias("owner"))
    owned = scratch.write(classes.join(owners, ["c1", "c2", "fuzzy"]).select("k1", "k2", "owner"), "owned")
    gone = signed.select("doc_id", "th", "line_no", "k1", "k2").join(owned, ["k1", "k2"]).where(~F.struct("doc_id", "th", "line_no").eqNullSafe(F.col("owner")))
    gone = scratch.write(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "gone")
    scratch.drop("signed", "classes", "owned", "ids", "links")
    return gone


def dedup_lines(docs: DataFrame, report: bool = True) -> DataFrame:
    """docs with their text less the removed lines; with report, and n_lines, n_kept, removed (line numbers from 0).

    Columns of docs that are named like those of the report give way to them; without report all stay.
    """
    gone = removed_lines(docs, Scratch(docs.sparkSession, "lines")).toDF("_tilewright_doc", "_tilewright_text", "_tilewright_gone")
    size = gone.agg(F.count("*").alias("n"), F.sum(F.size("_tilewright_gone")).alias("lines")).first()
    if size["n"] <= BROADCAST_IDS // 4 and (size["lines"] or 0) <= 2 * BROADCAST_IDS:  # else the texts are shuffled
        gone = F.broadcast(gone)
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_tilewright_doc")) & (F.xxhash64(docs["text"]) == F.col("_tilewright_text")), "left")
    parts, removed = F.split("text", "\n", -1), F.col("_tilewright_gone")
    kept = F.when(removed.isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(removed, i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    added = [n.alias("n_lines"), (n - F.when(removed.isNull(), 0).otherwise(F.size(removed))).alias("n_kept"), F.coalesce(removed, F.array().cast("array<int>")).alias("removed")] if report else []
    return rows.select(*[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns if not report or c not in ("n_lines", "n_kept", "removed")], *added)
