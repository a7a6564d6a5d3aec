"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked.  Every document starts in a shard by hash.  In rounds,
the linked documents of a group move towards the shards where most of their group is (its
homes): moves are ranked by the number of documents they bring home and admitted up to each
shard's quota, the room that linked documents leave there (documents without links are free to
make way).  A group larger than a shard has as many homes as it needs.  Rounds work on one row
for each group and shard, not on documents, so a group that holds a third of all rows is some
forty rows.  At the end free documents fill what is left, and shards differ by one row at most
(the law is ``rows``).

Ranks that would need one big window are taken in two steps: within buckets of documents, and a
sum over the buckets before.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch

#: Bytes each document counts besides its text.
OVERHEAD = 16
#: Buckets that split hot groups; rows for each bucket that shares a shard's quota.
BUCKETS, QUOTA_ROWS = 64, 50_000


def _propagate(spark: SparkSession, pieces: DataFrame, quotas: list[int], scratch: Scratch) -> DataFrame:
    """(g, shard, n) after label propagation of (g, shard, n); linked rows of a shard stay in its quota.

    Rounds go on until none has a move.  A move takes rows of a group to a shard that has at least as
    many of it, so the sum of squares of n rises with each round and they come to an end.
    """
    n_shards = len(quotas)
    smallest = max(1, min(quotas))
    buckets = max(1, min(4096, sum(quotas) // QUOTA_ROWS))
    group = W.partitionBy("g")
    for step in count():
        linked = {r.shard: r.n for r in pieces.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        room = F.array(*[F.lit(max(0, quotas[s] - linked.get(s, 0))) for s in range(n_shards)])
        ranked = pieces.withColumns({
            "total": F.sum("n").over(group),
            "place": F.row_number().over(group.orderBy(F.desc("n"), "shard")),
            "homes": F.collect_list("shard").over(group.orderBy(F.desc("n"), "shard").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        }).withColumn("needs", F.ceil(F.col("total") / smallest).cast("int"))
        moving = ranked.filter("place > needs").withColumn(
            "to", F.element_at("homes", (F.col("needs") - (F.col("place") - 1) % F.col("needs")).cast("int"))  # the emptiest home first
        ).withColumn("bucket", F.pmod(F.xxhash64("g", "shard"), F.lit(buckets)).cast("int"))
        # Each bucket has its part of the shard's quota; the parts add up to it.
        part = F.floor((F.element_at(room, F.col("to") + 1) + F.col("bucket")) / buckets)
        before = W.partitionBy("to", "bucket").orderBy(F.desc("n"), "g", "shard")
        admitted = scratch.save(
            moving.withColumn("sum", F.sum("n").over(before.rowsBetween(W.unboundedPreceding, W.currentRow)))
            .withColumn("moved", F.least("n", F.greatest(part - F.col("sum") + F.col("n"), F.lit(0))).cast("long"))
            .filter("moved > 0").select("g", "shard", "to", "moved"),
            f"moves-{step}",
        )
        if not admitted.limit(1).count():
            break
        changed = (
            pieces.unionByName(admitted.select("g", F.col("to").alias("shard"), F.col("moved").alias("n")))
            .unionByName(admitted.select("g", "shard", (-F.col("moved")).alias("n")))
        )
        pieces = scratch.save(changed.groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), f"pieces-{step}")
    return pieces


def _bucket_starts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, before): rows of the same keys in smaller buckets; at most BUCKETS rows a key."""
    earlier = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return df.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before")
    )


def shard_documents(spark: SparkSession, docs: DataFrame, *, n_shards: int = 40) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes count UTF-8 bytes plus OVERHEAD (null text: OVERHEAD alone, and a crc32 of 0).  The law
    is ``rows``: shards differ by one row at most, the larger ones first.  ``slot`` counts a
    shard's rows from 0 without gaps; ``grown_shard`` belongs to another law and is null.  Equal
    texts share a shard as far as the quotas allow; null texts are not linked.  Rows that repeat
    a doc_id are rows of their own.  Other columns are ignored.  The result depends on the rows
    alone, except that rows equal in doc_id and text may change places.
    """
    scratch = Scratch(spark, "sharding")
    raw = F.encode("text", "UTF-8")
    doc_id = F.col("doc_id").cast("long")
    base = docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("g"),
        F.pmod(F.xxhash64(F.lit(7), doc_id, "text"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.pmod(F.xxhash64(F.lit(11), doc_id, "text"), F.lit(n_shards)).cast("int").alias("shard"),
    )
    rows = scratch.save(base, "rows")
    pieces = rows.filter("g is not null").groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
    totals = W.partitionBy("g")
    linked = scratch.save(pieces.withColumn("total", F.sum("n").over(totals)).filter("total > 1").select("g", "shard", "n"), "linked")
    total = rows.count()
    quotas = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]

    # Groups whose first places hold more than the quota go through the quota as moves do: start from none.
    placed = scratch.save(_fit(linked, quotas, scratch), "fitted")
    final = scratch.save(_propagate(spark, placed, quotas, scratch), "final")

    # Ranks within groups, bucket by bucket; a group's ranks are dealt to its shards' counts.
    deal = final.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("deal"))  # n_shards entries at most
    grouped = rows.join(linked.select("g").distinct(), "g", "left_semi")
    starts = scratch.save(_bucket_starts(grouped, ["g"]).join(deal, "g"), "starts")
    rank = F.row_number().over(W.partitionBy("g", "bucket").orderBy("doc_id")) - 1
    ranked = rows.filter("g is not null").withColumn("rank", rank).join(
        starts.withColumnRenamed("bucket", "b").withColumnRenamed("g", "gg"), (F.col("g") == F.col("gg")) & (F.col("bucket") == F.col("b")), "left"
    )
    step = F.aggregate(
        "deal",
        F.struct((F.col("before") + F.col("rank")).cast("long").alias("left"), F.lit(-1).alias("shard")),
        lambda acc, d: F.struct(
            (acc["left"] - F.when(acc["shard"] < 0, d["n"]).otherwise(F.lit(0))).cast("long").alias("left"),
            F.when((acc["shard"] < 0) & (acc["left"] < d["n"]), d["shard"]).otherwise(acc["shard"]).alias("shard"),
        ),
    )["shard"]
    columns = ["doc_id", "size", "text_crc32", "bucket", "shard"]
    dealt = ranked.filter("deal is not null").withColumn("shard", step).select(*columns)
    free = ranked.filter("deal is null").select(*columns).unionByName(rows.filter("g is null").select(*columns))
    free = scratch.save(free, "free")

    held = {r.shard: r.n for r in final.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    room = [quotas[s] - held.get(s, 0) for s in range(n_shards)]
    ends = [sum(room[: s + 1]) for s in range(n_shards)]
    fine = free.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(16 * BUCKETS)).cast("int")).withColumn("one", F.lit(1))
    order = F.row_number().over(W.partitionBy("bucket").orderBy("doc_id", "text_crc32")) - 1
    spots = fine.withColumn("rank", order).join(_bucket_starts(fine, ["one"]).select(F.col("bucket").alias("b"), "before"), F.col("bucket") == F.col("b"))
    at = F.col("rank") + F.col("before")
    filled = spots.withColumn("shard", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= at)).cast("int")).select(*columns)

    whole = scratch.save(dealt.unionByName(filled).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int")), "whole")
    slots = _bucket_starts(whole, ["shard"]).select(F.col("shard").alias("s"), F.col("bucket").alias("b"), "before")
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    return whole.withColumn("rank", within).join(slots, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _fit(pieces: DataFrame, quotas: list[int], scratch: Scratch) -> DataFrame:
    """Pieces cut so that no shard starts with more linked rows than its quota.

    What is above goes to the shards with room, side by side in one order of (shard, g).  Sums
    are over one row for each group and shard; only shards over their quota are ordered.
    """
    n_shards = len(quotas)
    held = {r.shard: r.n for r in pieces.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    over = {s: held.get(s, 0) - quotas[s] for s in range(n_shards) if held.get(s, 0) > quotas[s]}
    if not over:
        return pieces
    room = [max(0, quotas[s] - held.get(s, 0)) for s in range(n_shards)]
    room_ends = [sum(room[: s + 1]) for s in range(n_shards)]
    base, start = {}, 0
    for s in sorted(over):
        base[s] = start
        start += over[s]
    limit = F.create_map(*[F.lit(x) for s in over for x in (s, over[s])])
    offset = F.create_map(*[F.lit(x) for s in base for x in (s, base[s])])
    order = W.partitionBy("shard").orderBy(F.desc("n"), "g").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = (
        pieces.filter(F.col("shard").isin(*over)).withColumn("sum", F.sum("n").over(order))
        .withColumn("out", F.least("n", F.greatest(F.lit(0), limit[F.col("shard")] - F.col("sum") + F.col("n"))).cast("long"))
        .filter("out > 0").withColumn("at", offset[F.col("shard")] + F.col("sum") - F.col("n"))
    )
    cut = scratch.save(cut.select("g", "shard", "out", "at"), "over")
    spans = F.array(*[F.struct(F.lit(s).alias("to"), F.lit(room_ends[s] - room[s]).alias("lo"), F.lit(room_ends[s]).alias("hi")) for s in range(n_shards)])
    spread = cut.withColumn("span", F.explode(spans)).withColumn(
        "n", F.least(F.col("at") + F.col("out"), F.col("span.hi")) - F.greatest("at", F.col("span.lo"))
    ).filter("n > 0").select("g", F.col("span.to").alias("shard"), F.col("n").cast("long").alias("n"))
    back = cut.select("g", "shard", (-F.col("out")).alias("n"))
    return pieces.unionByName(back).unionByName(spread).groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
