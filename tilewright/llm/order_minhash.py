"""Near-duplicate documents by order MinHash.

Words by the contracts' rule; k-mers of 5 words, each labelled with its occurrence number in the
document. One sketch takes the 3 least labelled k-mers under its own hash and keeps them in text order,
so it is sensitive to edit similarity, not only to what is shared; 16 sketches are the bands. Candidates
are verified by a banded alignment of the two k-mer sequences: with m aligned k-mers of |A| and |B|,
similar means m / (|A| + |B| - m) >= 0.8. That leaves at most a ninth of |A| + |B| unaligned, which bounds
the band. The measure is a metric's complement, and equals the Jaccard similarity of the 5-word shingles
where what is shared stands in the same order.

Equal texts are one node named by a 160-bit hash. Components of links are classes. Defined results: null
counts as the empty text; documents without words are alike only if their texts are equal; a document of
under 5 words has one k-mer, all its words. The class id is the least doc_id of the class (null only where
all are), and the row with that doc_id is the one kept; rows alike in doc_id and text are kept alike by
`near_duplicates`, while `drop_near_duplicates` leaves one; an empty table gives no rows; other columns of the
documents are kept by `drop_near_duplicates`, and may have any names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.columns import byte_sizes, shingles, text_bytes, word_hashes
from tilewright.llm.common import Scratch, chunks, mix64, text_key, tidy, words_of
from tilewright.llm.graph import components
from tilewright.llm.links import verified_links

#: Characters signed at a time.
CHUNK_CHARS = 300_000
WORDS, LEAST, SKETCHES, SIMILAR = 5, 3, 16, 0.8
PHASES = (range(4), range(4, SKETCHES))
BROADCAST_KEYS = 500_000


def sketch(kmers: np.ndarray, bounds: np.ndarray, least: int = LEAST, sketches: int = SKETCHES) -> np.ndarray:
    """Order-MinHash band values, one row a document of at least one k-mer (others: 0)."""
    n = np.diff(bounds)
    out = np.zeros((len(n), sketches), np.uint64)
    if not len(kmers):
        return out
    doc = np.repeat(np.arange(len(n)), n)
    own = mix64(kmers + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    run = np.flatnonzero(new)
    label = np.empty(len(kmers), np.uint64)
    label[order] = np.arange(len(kmers)) - np.repeat(run, np.diff(np.concatenate([run, [len(kmers)]])))
    labelled = mix64(kmers + label * np.uint64(0xA24BAED4963EE407))
    seeds = mix64(np.arange(1, 2 * sketches + 1, dtype=np.uint64) + np.uint64(0x5851F42D))
    # all but about `wanted` of a long document's values lie above this bound and need not be ordered
    wanted = 40.0
    limit = np.where(n > wanted, np.minimum(wanted / np.maximum(n, 1), 1.0) * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
    limits = limit[doc]
    for s in range(sketches):
        x = (labelled ^ seeds[2 * s]) * (seeds[2 * s + 1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        low = np.flatnonzero(x <= limits)
        few = np.bincount(doc[low], minlength=len(n)) < np.minimum(n, least)
        if few.any():
            low = np.flatnonzero((x <= limits) | few[doc])
        d = doc[low]
        by = np.lexsort((x[low], d))
        d, low = d[by], low[by]
        start = np.searchsorted(d, np.arange(len(n)))
        take = np.arange(len(d)) - start[d] < least
        d, low = d[take], np.sort(low[take])  # documents follow one another, so this is text order in each
        d = doc[low]
        place = (np.arange(len(d)) - np.searchsorted(d, np.arange(len(n)))[d]).astype(np.uint64)
        terms = labelled[low] * (mix64(place + np.uint64(31)) | np.uint64(1))
        some = np.flatnonzero(n)
        out[some, s] = mix64(np.add.reduceat(terms, np.searchsorted(d, some)) + np.uint64(s))
    return out


def _sign(batches):
    seen: set[bytes] = set()
    for batch in batches:
        keys, column = batch.column("id").to_pylist(), batch.column("text")
        fresh = [i for i, key in enumerate(keys) if not (key in seen or seen.add(key))]
        column, keys = column.take(pa.array(fresh, pa.int64())), [keys[i] for i in fresh]
        for a, b in chunks(byte_sizes(column), CHUNK_CHARS):
            values, words = word_hashes(*text_bytes(column.slice(a, b - a)))
            kmers, bounds = shingles(values, words, WORDS)
            some = np.flatnonzero(np.diff(bounds))
            bands = sketch(kmers, bounds).view(np.int64)[some]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * SKETCHES, pa.int32()), pa.array(bands.ravel(), pa.int64()))
            size = 8 * np.diff(bounds)[some]
            yield pa.RecordBatch.from_arrays([pa.array([keys[a + i] for i in some], pa.string()), flat, pa.array(size, pa.int64())], ["id", "bands", "size"])


def kmer_list(text: str | None) -> list:
    words = words_of(text)
    if len(words) < WORDS:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(WORDS))))


def aligned(a: list, b: list, similar: float = SIMILAR) -> float:
    """Similarity by a banded alignment (longest common subsequence, bit-parallel); below `similar` it may be 0.

    The time is that of len(b) operations on 2 * band + 1 bits.
    """
    total = len(a) + len(b)
    if not total:
        return 1.0
    most = min(len(a), len(b))
    if most < similar * (total - most):
        return 0.0
    head = 0
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    same = head + tail
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y:
        band = int((total - 2 * similar * total / (1 + similar)) + 1)  # diagonals a similar pair can leave
        places: dict = {}
        for j, v in enumerate(x):
            places.setdefault(v, []).append(j)
        # bit k of the state is place low + k of x: only the 2 * band + 1 places around the diagonal are held
        low, width, same_here = -band, 2 * band + 1, 0
        state = full = (1 << width) - 1
        for i, v in enumerate(y):
            if i:  # the window moves on by a place; what leaves it is settled
                same_here += not state & 1
                state, low = state >> 1 | 1 << (width - 1), low + 1
            found = places.get(v)
            if found:
                near = found if len(found) < 8 else found[bisect_left(found, low) : bisect_left(found, low + width)]
                mask = 0
                for j in near:
                    if low <= j < low + width:
                        mask |= 1 << (j - low)
                if hit := state & mask:
                    state = ((state + hit) | (state - hit)) & full
        same += same_here + width - state.bit_count()
    value = same / (total - same)
    return value if value >= similar else 0.0


def kmer_codes(batches):
    """(id, text) -> (id, text): each document's k-mers as 64-bit hashes, 8 bytes a k-mer."""
    for batch in batches:
        ids, column = batch.column("id"), batch.column("text")
        for a, b in chunks(byte_sizes(column), CHUNK_CHARS):
            kmers, bounds = shingles(*word_hashes(*text_bytes(column.slice(a, b - a))), WORDS)
            flat, ends = kmers.tobytes(), (8 * bounds).tolist()
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([flat[x:y] for x, y in zip(ends, ends[1:])], pa.binary())], ["id", "text"])


def prepared(codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A document's k-mers in order, and its labelled k-mers sorted."""
    kmers = np.frombuffer(codes, np.uint64)
    ranked = np.sort(kmers)
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    label = np.arange(len(ranked)) - np.repeat(run, np.diff(np.concatenate([run, [len(ranked)]])))
    return kmers, np.sort(mix64(ranked + label.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def similar_documents(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """What the two share in any order bounds what can be aligned; only pairs above that bound are aligned."""
    need = SIMILAR / (1 + SIMILAR) * (len(a[0]) + len(b[0])) - 1e-9
    if min(len(a[0]), len(b[0])) < need:
        return False
    both = np.concatenate([a[1], b[1]])
    both.sort(kind="stable")
    if np.count_nonzero(both[1:] == both[:-1]) < need:
        return False
    return aligned(a[0].tolist(), b[0].tolist()) >= SIMILAR


def document_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): id is the 160-bit text name; only texts that are near copies of another text."""
    texts = docs.select(text_key(F.col("text")).alias("id"), "text")
    signed = scratch.write(texts.mapInArrow(tidy(_sign), "id string, bands array<long>, size long"), "signed")

    def held(ids: DataFrame) -> DataFrame:
        ids = scratch.write(ids, "ids")
        few = ids.count() <= BROADCAST_KEYS
        return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")).mapInArrow(tidy(kmer_codes), "id string, text binary")

    links = verified_links(signed, held, prepared, similar_documents, scratch, PHASES, lambda x: x[1], SIMILAR)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    scratch.drop("signed", "ids", "links")
    return roots.select(F.col("node").alias("id"), "root")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, id (text name), class_id, class_size (rows), kept."""
    scratch = scratch or Scratch(docs.sparkSession, "omh")
    docs = docs.select("doc_id", "text")
    rows = scratch.write(docs.select("doc_id", text_key(F.col("text")).alias("id")), "rows")
    roots = document_classes(docs, scratch)
    rows_of = rows.join(roots, "id", "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))
    heads = rows_of.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    named = rows_of.groupBy("root", "doc_id").agg(F.min("id").alias("least")).join(heads, "root")
    heads = named.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("root", "class_id", "class_size", "least")
    return rows_of.join(heads, "root").select("doc_id", "id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("id") == F.col("least"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents less all but one of each class, whole rows."""
    scratch = Scratch(docs.sparkSession, "omh")
    classes = scratch.write(near_duplicates(docs, scratch).groupBy("doc_id", "id", "kept").agg(F.count("*").alias("n")), "classes")
    gone = classes.where("not kept").select(F.col("doc_id").alias("_tilewright_doc"), F.col("id").alias("_tilewright_id"))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_tilewright_doc")) & (text_key(docs["text"]) == F.col("_tilewright_id")), "left_anti")
    if not classes.where("kept and n > 1").isEmpty():
        left = left.withColumn("_tilewright_id", text_key(F.col("text"))).dropDuplicates(["doc_id", "_tilewright_id"]).drop("_tilewright_id")
    return left
