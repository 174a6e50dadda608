"""From banded signatures to verified links, without pairing every two members of a bucket.

A bucket is a band value that at least two items share. A bucket of up to SMALL items gives all its pairs,
each verified once however many bands propose it. A bucket of up to GROUP items is worked off in one task
that holds an item against the members of components it is not linked with yet, so it finds the bucket's
exact components. In a larger one every member is held against the bucket's leader (its least id): one pair
a member, in a join that Spark can split. Buckets whose items are larger than GROUP_BYTES together count as larger.

Bands are taken in phases. After a phase the components of what is linked so far are known, and in the next one
only items of different components are held against each other: buckets inside one component need no work. At
last, large buckets that still hold several components are finished: the items outside the leader's component
(the rest) are cut into blocks, the others too, and each block of the rest is held against every block in a task of
its own. Items of buckets in which that would be more than WIDE pairs are dealt anew instead, by a prefix filter: codes
are ordered from rare to common, and two items that are similar enough share one of the first few of each, so every such
code is a bucket, worked off like the others. No bucket is capped or dropped, no pair that shares a band is lost, and no
task gathers more than about GROUP items or GROUP_BYTES, or two items if these are larger.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import Scratch, tidy
from tilewright.llm.graph import components

SMALL, GROUP = 8, 512
#: Shared buckets up to this number (8 bytes each) are broadcast.
BROADCAST_BUCKETS = 3_000_000
#: What the items of a group may take together.
GROUP_BYTES = 32_000_000
#: The items of buckets with more pairs than this between the rest and all are dealt anew by their rare codes.
WIDE = 64 * GROUP * GROUP


def possible_pairs(codes: list[np.ndarray], similar: float, width: int = 8192) -> np.ndarray:
    """Which pairs of sorted distinct code arrays share enough for a Jaccard similarity of `similar`, by a matrix product."""
    n = len(codes)
    size = np.array([len(c) for c in codes])
    flat, owner = np.concatenate(codes) if n else np.zeros(0, np.uint64), np.repeat(np.arange(n), size)
    _, name, times = np.unique(flat, return_inverse=True, return_counts=True)
    held = times[name] > 1
    place = (np.cumsum(times > 1) - 1)[name[held]]
    owner, shared = owner[held], np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], place[a:b] - low] = 1
        shared += part @ part.T
    return shared >= similar / (1 + similar) * (size[:, None] + size) - 1e-3


def group_links(items: list, known: list, similar: Callable) -> list[tuple[int, int]]:
    """Links (positions, the lesser first) that complete the components of a few items; items of equal `known` are linked."""
    whole: dict = {}
    for i, name in enumerate(known):
        whole.setdefault(name, []).append(i)
    parts: list[list[int]] = []
    links = []
    for new in whole.values():
        met, rest = list(new), []
        for part in parts:
            pair = next(((j, i) for j in part for i in new if similar(items[j], items[i])), None)
            if pair is None:
                rest.append(part)
            else:
                links.append((min(pair), max(pair)))
                met = part + met
        parts = [*rest, met]
    return links


def verified_links(signed: DataFrame, texts: Callable[[DataFrame], DataFrame], prepare: Callable, similar: Callable, scratch: Scratch, phases: Sequence[Sequence[int]], codes: Callable, least: float) -> DataFrame:
    """(a, b) links between similar items, written to the shared folder; a < b.

    signed: (id, bands array<long>, size: bytes that the prepared item takes); rows of the same id are alike. texts: ids -> (id, text), one row an id;
    text may be anything that prepare takes. similar(prepare(text), prepare(text)) tells whether two items are
    alike. phases: the numbers of the bands of each phase. codes(prepared) gives sorted distinct codes, whose
    Jaccard similarity is at least that of the items; where it is below `least`, items of a group aren't compared.
    """
    spark, kind = signed.sparkSession, signed.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        ready = lru_cache(maxsize=1024)(prepare)  # leaders are in many pairs
        return pa.array([similar(ready(p.as_py()), ready(q.as_py())) for p, q in zip(x, y)], pa.bool_())

    def linked_rows(rows: pa.Table, found: list[tuple[int, int]]) -> pa.Table:
        ids = rows.column("id").combine_chunks()
        take = lambda k: ids.take(pa.array([f[k] for f in found], pa.int64()))
        return pa.table({"a": take(0), "b": take(1)})

    def in_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        items = [prepare(t) for t in rows.column("text").to_pylist()]
        near = possible_pairs([codes(x) for x in items], least)
        return linked_rows(rows, group_links(list(enumerate(items)), rows.column("comp").to_pylist(), lambda x, y: near[x[0], y[0]] and similar(x[1], y[1])))

    def in_blocks(rows: pa.Table) -> pa.Table:
        """Two blocks of a bucket: only pairs across them, or one block with itself."""
        rows = rows.sort_by("id")
        blocks = rows.column("block").to_pylist()
        one = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        items = [prepare(t) for t in rows.column("text").to_pylist()]
        near = possible_pairs([codes(x) for x in items], least)
        return linked_rows(rows, group_links(list(enumerate(items)), rows.column("comp").to_pylist(), lambda x, y: near[x[0], y[0]] and (one or blocks[x[0]] != blocks[y[0]]) and similar(x[1], y[1])))

    same = F.arrow_udf(alike, T.BooleanType(), F.ArrowUDFType.SCALAR)

    def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
        x, y = held.select(F.col("id").alias("a"), F.col("text").alias("x")), held.select(F.col("id").alias("b"), F.col("text").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(same("x", "y")).select("a", "b")

    def code_lists(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                lists = [c.view(np.int64) if len(c) else np.zeros(1, np.int64) for c in (codes(prepare(t)) for t in part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lists, pa.list_(pa.int64()))], ["id", "codes"])

    def rare_codes(ids: DataFrame) -> DataFrame:
        """(bucket, id): two of the items whose codes have a Jaccard similarity of `least` share one of these buckets at least.

        Let x have no more codes than y. They share at least 2 least / (1 + least) of x's codes and `least` of y's, so
        the rarest code that they share is among the first of x (`first`) and among the somewhat more first of y.
        """
        lists = T.StructType([T.StructField("id", kind), T.StructField("codes", T.ArrayType(T.LongType()))])
        named = scratch.write(ids.join(held, "id").mapInArrow(tidy(code_lists), lists), "codes")
        flat = named.select("id", F.size("codes").alias("total"), F.explode("codes").alias("code"))
        often = flat.groupBy("code").agg(F.count("*").alias("times")).where("times > 1")  # others come first, and no two items share them
        ranked = flat.join(often, "code").groupBy("id", "total").agg(F.array_sort(F.collect_list(F.struct("times", "code"))).alias("held"))
        placed = ranked.select("id", "total", (F.col("total") - F.size("held")).alias("alone"), F.posexplode("held").alias("place", "one"))
        room = lambda share: F.col("total") - F.ceil(share * F.col("total") - 1e-6)
        place = F.col("alone") + F.col("place")
        placed = placed.where(place <= room(least)).select(F.col("one.code").alias("bucket"), "id", "total", (place <= room(2 * least / (1 + least))).alias("first"))
        placed = scratch.write(placed, "placed")
        useful = placed.groupBy("bucket").agg(F.max("first").alias("some"), F.count("*").alias("n")).where("some and n > 1")
        return placed.select("bucket", "id", (8 * F.col("total")).cast("long").alias("size")).join(useful.select("bucket"), "bucket", "left_semi")

    exploded = signed.select("id", "size", F.posexplode("bands").alias("band", "value"))
    rows = exploded.select("band", F.xxhash64("band", "value").alias("bucket"), "id", "size")
    half = max(1, GROUP // 2)
    two = rows.groupBy("bucket").agg(F.min("id").alias("c0"), F.max("id").alias("c1")).where("c1 > c0").select("bucket")
    two = scratch.write(two, "two")
    two = F.broadcast(two) if two.count() <= BROADCAST_BUCKETS else two  # else both sides are shuffled
    shared = scratch.write(rows.join(two, "bucket", "left_semi").distinct(), "shared")
    held = scratch.write(texts(shared.select("id").distinct()), "texts")
    found: list[DataFrame] = []
    roots, step = None, 0

    def linked() -> DataFrame:
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def members_of(rows: DataFrame, name: str, over: int = 1) -> DataFrame:
        """(bucket, id, size, comp, lead, n, wide) of the buckets of more than `over` items that hold several components; wide: too large for a task."""
        named = rows.withColumn("comp", F.col("id")) if roots is None else rows.join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
        heads = named.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct("id", "comp")).alias("lead"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
        heads = heads.withColumn("wide", (F.col("n") > SMALL) & ((F.col("n") > GROUP) | (F.col("bytes") > GROUP_BYTES)))
        heads = heads.where((F.col("c1") > F.col("c0")) & ((F.col("n") > over) | (F.col("wide") & F.lit(over > 1))))
        return scratch.write(named.join(heads.select("bucket", "lead", "n", "wide"), "bucket"), name)

    def grouped(members: DataFrame, name: str) -> DataFrame:
        some = members.where((F.col("n") > SMALL) & ~F.col("wide")).join(held, "id").select("bucket", "id", "comp", "text")
        return scratch.write(some.groupBy("bucket").applyInArrow(in_group, schema), name)

    def pairs_of(members: DataFrame) -> DataFrame:
        few = members.where(F.col("n") <= SMALL)
        return few.select("bucket", F.col("id").alias("a"), F.col("comp").alias("ca")).join(few.select("bucket", F.col("id").alias("b"), F.col("comp").alias("cb")), "bucket").where("a < b and ca != cb").select("a", "b")

    def known() -> DataFrame:
        return scratch.write(components(linked().select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).select(F.col("node").alias("id"), "root").distinct(), f"roots{step}")

    outside = F.col("comp") != F.col("lead.comp")
    for phase in phases:
        step += 1
        members = members_of(shared.where(F.col("band").isin(list(phase))).select("bucket", "id", "size"), f"members{step}")
        star = members.where(F.col("wide") & outside).select(F.col("lead.id").alias("a"), F.col("id").alias("b"))
        found.append(scratch.write(verified(pairs_of(members).unionByName(star).distinct(), held), f"links{step}"))
        found.append(grouped(members, f"group{step}"))
        scratch.drop(f"members{step}")
        roots = known()

    # large buckets have met their leaders only; those of rare codes are new
    rows, rare = shared.select("bucket", "id", "size"), False
    while rows is not None:
        step += 1
        members = members_of(rows, f"members{step}", 1 if rare else GROUP)
        if rare:
            found.append(scratch.write(verified(pairs_of(members).distinct(), held), f"links{step}"))
            found.append(grouped(members, f"group{step}"))
        large = members.where("wide")
        part = lambda what, which: F.sum(F.when(which, what).otherwise(0)).cast("long")
        sizes = large.groupBy("bucket").agg(part(F.lit(1), outside).alias("rest"), part(F.lit(1), ~outside).alias("main"), part(F.col("size"), outside).alias("rest_bytes"), part(F.col("size"), ~outside).alias("main_bytes"))
        sizes = scratch.write(sizes, f"sizes{step}")
        many = (F.col("rest") * (F.col("rest") + F.col("main")) > WIDE) if not rare else F.lit(False)
        todo = large.join(sizes.where(~many), "bucket")
        m, o = (F.greatest(F.ceil(F.col(n) / half), F.ceil(F.col(f"{n}_bytes") / (GROUP_BYTES // 2))).cast("int") for n in ("main", "rest"))
        block = F.when(outside, m + F.pmod(F.xxhash64("id"), o)).otherwise(F.pmod(F.xxhash64("id"), m)).cast("int")
        cut = todo.select("bucket", "id", "comp", block.alias("block"), F.explode(F.sequence(F.when(outside, F.lit(0)).otherwise(m), m + o - 1)).alias("other"))
        cut = cut.select("bucket", "id", "comp", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).join(held, "id")
        found.append(scratch.write(cut.groupBy("bucket", "low", "high").applyInArrow(in_blocks, schema), f"blocks{step}"))
        rows = None
        anew = sizes.where(many)
        if not rare and not anew.isEmpty():
            roots, rare = known(), True
            rows = rare_codes(members.join(anew.select("bucket"), "bucket", "left_semi").select("id").distinct())
    out = scratch.write(linked().distinct(), "links")
    scratch.drop("texts", "shared", "two", "codes", "placed", *(f"{x}{j}" for x in ("links", "group", "blocks", "roots", "members", "sizes") for j in range(step + 1)))
    return out
