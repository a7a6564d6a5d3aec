"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

* Targets: sources in order of code point (null last) have the weights 5, 2, 1, repeating, and
  share all words.  A target stops at ``limit`` times its source's words; what is above goes to
  the others by weight until none is above (rounds of one small aggregate each).
* A source takes all its words as often as its target holds them whole; the rest of its target
  is taken in blocks of ``block`` words.  Sainte-Lague (highest quotients target / (2k + 1))
  gives each source its number of blocks, and within a source gives each shard its quota, the
  shards' words being the votes.
* A shard's documents stand in seeded order (a hash of seed and doc_id) as one row of words; the
  quota's blocks are its first ones.  A document takes the words that lie in them.

Highest quotients are found among few candidates: with m parties and S seats, a party's seats
lie within (v / V) * m / 2 + 1/2 of its share v / V * S, so only quotients in that range are
ranked.  A source has a shard for each ``shard_words`` of its words, ``max_shards`` at most, so
neither a hot source nor a shard is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, pack, unpack

WEIGHTS = (5, 2, 1)
LIMIT = 3
#: Words in a block, words for a shard, and shards of a source at most.
BLOCK, SHARD_WORDS, MAX_SHARDS = 16, 16_384, 4096
#: Ranges in which rows of a global order are numbered side by side.
RANGES = 16


def words(text: str) -> Column:
    """The number of runs of characters other than space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``number``, its place from 0 in ascending ``order``, without one big window.

    Ranges are ordered side by side; a range's first number is the count of those before it.
    """
    ranged = scratch.save(
        df.repartitionByRange(RANGES, *order).withColumn("_range", F.spark_partition_id()), name
    )
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # RANGES rows at most
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_place", place).join(F.broadcast(starts), "_range")
        .withColumn("number", F.col("_start") + F.col("_place") - 1).drop("_range", "_place", "_start")
    )


def _candidates(parties: DataFrame, keys: list[str], votes: str, seats: str) -> DataFrame:
    """Parties (with _m parties and _all votes of their group) and the seats they surely have."""
    share = F.col(votes) / F.col("_all")
    spread = share * F.col("_m") / 2 + F.lit(0.5)
    some = F.col(votes) > 0
    return parties.withColumns({
        "_low": F.when(some, F.greatest(F.floor(share * F.col(seats) - spread - 1e-6), F.lit(0))).otherwise(0),
        "_high": F.when(some, F.ceil(share * F.col(seats) + spread + 1e-6)).otherwise(-1),
    })


def _quotients(shares: DataFrame, keep: list[str], votes: str) -> DataFrame:
    """A row for each seat in doubt, ``_quotient`` negative so that the highest come first."""
    seats = F.explode(F.expr("sequence(_low, _high)")).alias("_k")
    return shares.filter("_high >= _low").select(*keep, votes, seats).withColumn(
        "_quotient", -F.col(votes) / (2 * F.col("_k") + 1)
    )


def _won(shares: DataFrame, won: DataFrame, on: list[str]) -> DataFrame:
    return (
        shares.join(won.groupBy(*on).agg(F.count(F.lit(1)).alias("_won")), on, "left")
        .withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_m", "_all", "_low", "_high", "_won")
    )


def sainte_lague(parties: DataFrame, votes: str, seats: int, scratch: Scratch) -> DataFrame:
    """``parties`` (a row for each ``key``) with ``quota``: the seats by highest quotients of votes.

    Ties go to the smaller key.  Parties without votes get none.
    """
    m, all_votes = parties.agg(F.count(F.lit(1)), F.sum(votes)).first()
    counted = parties.withColumns({"_m": F.lit(m), "_all": F.lit(all_votes), "_seats": F.lit(seats)})
    shares = scratch.save(_candidates(counted, ["key"], votes, "_seats"), "shares")
    given = shares.agg(F.sum("_low")).first()[0] or 0
    ranked = numbered(_quotients(shares, ["key"], votes), ["_quotient", "key", "_k"], scratch, "quotients")
    return _won(shares, ranked.filter(F.col("number") < seats - given), ["key"]).drop("_seats")


def sainte_lague_within(parties: DataFrame, group: str, votes: str, seats: str) -> DataFrame:
    """The same for each ``group`` alone, whose number of parties is bounded."""
    of = W.partitionBy(group)
    shares = _candidates(
        parties.withColumns({"_m": F.count(F.lit(1)).over(of), "_all": F.sum(votes).over(of)}), [group, "key"], votes, seats
    ).withColumn("_open", F.col(seats) - F.sum("_low").over(of))
    ranked = _quotients(shares, [group, "key", "_open"], votes).withColumn(
        "_rank", F.row_number().over(of.orderBy("_quotient", "key", "_k"))
    )
    return _won(shares, ranked.filter("_rank <= _open"), [group, "key"]).drop("_open")


def _targets(spark: SparkSession, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, source_size, target): water filling; the driver holds sums only."""
    ordered = numbered(sources.withColumn("_null", F.col("src").isNull()), ["_null", "src"], scratch, "ranged")
    weighted = scratch.save(ordered.drop("_null"), "numbered").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int")).cast("double")
    )
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > LIMIT * F.col("source_size")
        held, free = weighted.agg(
            F.sum(F.when(above, LIMIT * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        now = (total - (held or 0)) / free if free else level
        if now <= level:
            break
        level = now
    target = F.least(F.col("weight") * F.lit(level), (LIMIT * F.col("source_size")).cast("double"))
    return weighted.select("src", "source_size", target.alias("target"))


def mix_sources(spark: SparkSession, docs: DataFrame, *, seed: int = 42) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source, source_size, target, taken, doc_key.

    ``size`` counts words, null text has none; ``taken`` counts the words the mix takes, repeats
    included, 3 * size at most.  Rows that share a doc_id are documents of their own.  A null
    source is a source.  ``doc_key`` (hash of doc_id, text and source) finds the row again.
    Other columns are ignored.  Equal tables give equal results, however they are partitioned.
    """
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("src"), words("text").alias("size"),
            F.xxhash64(F.col("doc_id").cast("long"), "text", F.col("source").cast("string")).alias("doc_key"),
        ),
        "sized",
    )
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    targets = scratch.save(_targets(spark, sources, scratch), "targets")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    plan = targets.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(LIMIT))).otherwise(0)
    ).withColumn("rest", F.greatest(rest, F.lit(0.0)))
    # All sources' blocks in one apportionment; the shards' quotas in one for each source.
    seats = plan.agg(F.round(F.sum("rest") / BLOCK).cast("long")).first()[0] or 0
    shared = sainte_lague(plan.withColumn("key", F.coalesce(F.concat(F.lit("s"), "src"), F.lit("~"))), "rest", int(seats), scratch)
    n_shards = F.least(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(MAX_SHARDS))
    blocks = scratch.save(
        shared.select(
            F.col("src").alias("b_src"), "key", "source_size", "target", "whole", F.col("quota").alias("blocks"),
            F.greatest(n_shards, F.lit(1)).cast("int").alias("n_shards"),
        ),
        "blocks",
    )
    chance = F.xxhash64(F.lit(seed), "doc_id", "doc_key")
    placed = scratch.save(
        sized.join(blocks, F.col("src").eqNullSafe(F.col("b_src"))).select(
            "doc_id", "src", "size", "doc_key", "source_size", "target", "whole", "blocks", F.col("key").alias("src_key"),
            F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "doc_key"), F.col("n_shards")).alias("key"),
            chance.alias("chance"),
        ),
        "placed",
    )
    shards = placed.groupBy("src_key", "key").agg(F.sum("size").alias("votes"), F.first("blocks").alias("blocks"))
    quotas = scratch.save(
        sainte_lague_within(shards, "src_key", "votes", "blocks").select("src_key", "key", (F.col("quota") * BLOCK).alias("quota")),
        "quotas",
    )
    inside = W.partitionBy("src_key", "key").orderBy("chance", "doc_id", "doc_key").rowsBetween(W.unboundedPreceding, -1)
    laid = placed.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(quotas, ["src_key", "key"])
    part = F.least("size", F.greatest(F.col("quota") - F.col("at"), F.lit(0)))
    taken = F.least(F.col("whole") * F.col("size") + part, LIMIT * F.col("size"))
    return laid.select("doc_id", "size", F.col("src").alias("source"), "source_size", "target", taken.cast("long").alias("taken"), "doc_key")


def _numbered_within(rows: DataFrame, key: str, number: str, order: Column, several: DataFrame) -> DataFrame:
    """``rows`` numbered from 1 among those of a key that ``several`` lists; the others aren't moved by a window."""
    of_key = (F.col(f"{key}.id").eqNullSafe(F.col("_several.id"))) & (F.col(f"{key}.hash") == F.col("_several.hash"))
    again = rows.join(several, of_key, "left_semi").withColumn(number, F.row_number().over(W.partitionBy(key).orderBy(order)))
    return rows.join(several, of_key, "left_anti").unionByName(again)


def mixed_documents(spark: SparkSession, docs: DataFrame, *, seed: int = 42) -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``.

    A document taken whole n times has n rows; one taken in part has one more, whose text is the
    original text up to the end of the last word taken.  Documents without words stay as they
    are, once.  Rows that repeat doc_id, text and source are numbered in the order of their other
    columns and have a decision each.
    """
    scratch = Scratch(spark, "mixed")
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    key = F.struct(doc_id.alias("id"), F.xxhash64(doc_id, "text", source).alias("hash"))
    plan = mix_sources(spark, docs, seed=seed).select(F.struct(F.col("doc_id").alias("id"), F.col("doc_key").alias("hash")).alias("key"), "size", "taken")
    plan = scratch.save(plan.withColumn("number", F.lit(1)), "plan")
    keyed = pack(docs, ["doc_id", "text", "source"]).withColumns({"_key": key, "_number": F.lit(1)})
    several = plan.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(F.col("key").alias("_several"))
    if several.limit(1).count():
        several = scratch.save(several, "several")
        plan = _numbered_within(plan, "key", "number", F.col("taken"), several)
        keyed = _numbered_within(keyed, "_key", "_number", F.to_json(F.struct("_rest")), several)
    part = F.col("taken") % F.col("size")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size")))
    takes = F.concat(
        F.array_repeat(F.lit(0).cast("long"), copies.cast("int")),
        F.when((F.col("size") > 0) & (part > 0), F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    decided = plan.withColumn("take", F.explode(takes)).select("key", "number", "take")
    same = F.col("_key.id").eqNullSafe(F.col("key.id")) & (F.col("_key.hash") == F.col("key.hash")) & (F.col("_number") == F.col("number"))
    joined = keyed.join(decided, same)
    # Each word with the white space before it.
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("take").cast("int")), "")
    shaped = joined.withColumn("text", F.when(F.col("take") > 0, first).otherwise(F.col("text")))
    return unpack(shaped, docs.columns, ["doc_id", "text", "source"])
