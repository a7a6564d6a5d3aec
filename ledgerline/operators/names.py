"""Deployed-name matching and narrowing resolution over a jobs table.

A job matches a wanted name when its raw name equals it, or its name without
the deploy prefix (the *base*) equals it, or the base starts with
``wanted + "_"``.  That is a theta condition; written as such it plans as a
cartesian product.  Here every job instead emits its *match keys* -- the raw
name, the base, and every prefix of the base that ends just before an
underscore -- and the match becomes an equi-join on ``key = wanted``.  A name
with u underscores emits at most u + 2 keys.

Resolution narrows each wanted name's candidates: bundle-managed jobs win if
any match; then jobs owned by the caller win if any survive; one survivor is
RESOLVED, none NOT_FOUND, more AMBIGUOUS.  Because each filter applies only
if something survives it, the outcome follows from four counts (all, managed,
owned, managed-and-owned).  These are counted *before* anything is joined: by
match key, and by match key and owner.  Both are partial aggregates, so a name
that matches a third of all jobs costs one row per task; requests then join
one row per key.  A request is resolved alone, by its name and its caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.text import deployed_base
from ledgerline.operators.joins import counted, repeated, spread_join, spread_nulls

NOT_FOUND, RESOLVED, AMBIGUOUS = "NOT_FOUND", "RESOLVED", "AMBIGUOUS"
# --- fixed values: candidate listing line ---------------------------------------
CANDIDATE_LINE = "     - %s (ID: %d)"


def normalize_names(jobs: DataFrame) -> DataFrame:
    """``job_id, name, base_name`` with the deploy prefix stripped."""
    return jobs.select("job_id", "name", deployed_base(F.col("name")).alias("base_name"))


def match_keys(name: Column) -> Column:
    """Distinct strings ``w`` for which ``name`` matches wanted name ``w``."""
    base = deployed_base(name)
    parts = F.split(base, "_", -1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"),
    )
    return F.array_distinct(F.concat(F.array(name), prefixes))


def match_names(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Every (request, job) pair whose names match; null/empty job names never match.

    ``requests`` needs a ``wanted`` column; its other columns are carried along.
    """
    keyed = (
        jobs.filter(F.col("name").isNotNull() & (F.col("name") != F.lit("")))
        .select("*", F.explode(match_keys(F.col("name"))).alias("_key"))
    )
    return keyed.join(requests, keyed["_key"] == requests["wanted"], "inner").drop("_key")


def _caller(principal: Column) -> Column:
    """What owners are compared with; null and empty callers own nothing."""
    return F.lower(F.coalesce(principal, F.lit("")))


def _owners() -> Column:
    names = F.array(F.lower(F.col("creator_user_name")), F.lower(F.col("run_as_user_name")))
    return F.array_distinct(F.filter(names, lambda o: o.isNotNull() & (o != F.lit(""))))


def _keyed(jobs: DataFrame) -> DataFrame:
    """A row per job and match key."""
    named = jobs.filter(F.col("name").isNotNull() & (F.col("name") != F.lit("")))
    return named.select("job_id", "name", F.col("deployment_kind").isNotNull().alias("managed"), _owners().alias("owners"),
                        F.explode(match_keys(F.col("name"))).alias("key"))


def key_counts(jobs: DataFrame) -> DataFrame:
    """``key, n, n_m, pick, pick_m``: jobs and managed jobs that match a key, and the smallest id of each."""
    managed = F.col("managed")
    return _keyed(jobs).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(managed).alias("n_m"),
        F.min("job_id").alias("pick"), F.min(F.when(managed, F.col("job_id"))).alias("pick_m"))


def owner_counts(jobs: DataFrame) -> DataFrame:
    """``key, caller, n_o, n_mo, pick_o, pick_mo``: the same by key and owner."""
    managed = F.col("managed")
    return _keyed(jobs).withColumn("caller", F.explode("owners")).groupBy("key", "caller").agg(
        F.count(F.lit(1)).alias("n_o"), F.count_if(managed).alias("n_mo"),
        F.min("job_id").alias("pick_o"), F.min(F.when(managed, F.col("job_id"))).alias("pick_mo"))


def _narrowed(jobs: DataFrame, callers: DataFrame) -> DataFrame:
    """Per (key, caller) that matches a job: which filters apply, how many candidates survive, and the smallest id."""
    counted = callers.join(key_counts(jobs), "key").join(owner_counts(jobs), ["key", "caller"], "left")
    by_managed = F.col("n_m") > 0
    owned_left = F.coalesce(F.when(by_managed, F.col("n_mo")).otherwise(F.col("n_o")), F.lit(0))
    by_owned = owned_left > 0
    survivors = F.when(by_owned, owned_left).when(by_managed, F.col("n_m")).otherwise(F.col("n"))
    pick = (F.when(by_managed & by_owned, F.col("pick_mo")).when(by_managed, F.col("pick_m"))
            .when(by_owned, F.col("pick_o")).otherwise(F.col("pick")))
    return counted.select("key", "caller", by_managed.alias("by_managed"), by_owned.alias("by_owned"),
                          survivors.cast("bigint").alias("n_candidates"), pick.alias("pick_id"))


def _with_caller(requests: DataFrame, principal: str | None) -> DataFrame:
    who = F.col("principal") if "principal" in requests.columns else F.lit(principal).cast("string")
    return requests.withColumns({"key": F.col("wanted"), "caller": _caller(who)})


def resolve_requests(jobs: DataFrame, requests: DataFrame, principal: str | None = None) -> DataFrame:
    """``requests`` with ``status, n_candidates, job_id, job_name``; its own columns must not have these names.

    ``principal`` (or a ``principal`` column on ``requests``) is the caller; null or empty disables
    the ownership filter.  ``job_id`` is the key of ``jobs``; the resolved job's name is attached
    to the distinct (name, caller) pairs, before the requests meet them.  Equal requests are
    answered once and repeated in the answer; a name that a third of all others want is dealt
    into shares, if they have other columns than name and caller.
    """
    asked = counted(_with_caller(requests, principal))
    sizes = asked.groupBy("key", "caller").agg(F.count(F.lit(1)).alias("n"))
    narrowed = _narrowed(jobs, sizes.select("key", "caller"))
    resolved = F.col("n_candidates") == 1
    names = jobs.select(F.col("job_id").alias("pick_id"), F.col("name").alias("job_name"))
    outcome = spread_nulls(
        sizes.select("key", "caller").join(narrowed, ["key", "caller"], "left").withColumn("pick_id", F.when(resolved, F.col("pick_id"))),
        names, "pick_id", by=["key", "caller"],
    ).select(
        "key", "caller",
        F.when(F.col("n_candidates").isNull(), F.lit(NOT_FOUND)).when(resolved, F.lit(RESOLVED)).otherwise(F.lit(AMBIGUOUS)).alias("status"),
        F.coalesce(F.col("n_candidates"), F.lit(0)).cast("bigint").alias("n_candidates"),
        F.col("pick_id").alias("job_id"), "job_name")
    columns = [*requests.columns, "status", "n_candidates", "job_id", "job_name"]
    # Null names match no job; an equality would lose them.
    nameless = asked.filter(F.col("key").isNull()).withColumns({
        "status": F.lit(NOT_FOUND), "n_candidates": F.lit(0).cast("bigint"),
        "job_id": F.lit(None).cast("bigint"), "job_name": F.lit(None).cast("string")})
    if set(requests.columns) <= {"wanted", "principal"}:  # then only spellings of the caller share a (name, caller)
        met = asked.join(outcome, ["key", "caller"])
    else:
        met = spread_join(asked, outcome, ["key", "caller"], sizes, by=requests.columns)
    return repeated(met.select(*columns, "_times").unionByName(nameless.select(*columns, "_times")))


def resolve_jobs(jobs: DataFrame, requests: DataFrame, principal: str | None = None) -> DataFrame:
    """One row per request: ``wanted, status, n_candidates, job_id, job_name``."""
    asked = requests.select("wanted", *[c for c in ("principal",) if c in requests.columns])
    return resolve_requests(jobs, asked, principal).select("wanted", "status", "n_candidates", "job_id", "job_name")


def ambiguous_candidates(jobs: DataFrame, requests: DataFrame, principal: str | None = None) -> DataFrame:
    """The surviving candidates of every AMBIGUOUS (name, caller), one row each.

    Rows rather than one collected list per name: a name may match an
    unbounded number of jobs.  ``candidate_line`` is the listing text.  The
    jobs of a heavy name are dealt into shares.
    """
    callers = _with_caller(requests, principal).select("key", "caller").distinct()
    flags = _narrowed(jobs, callers).filter(F.col("n_candidates") > 1).select("key", "caller", "by_managed", "by_owned")
    keep = ((~F.col("by_managed") | F.col("managed"))
            & (~F.col("by_owned") | F.array_contains("owners", F.col("caller"))))
    return (
        spread_join(_keyed(jobs), flags, ["key"], key_counts(jobs), by=["job_id"]).filter(keep)
        .select(F.col("key").alias("wanted"), "job_id", "name",
                F.format_string(CANDIDATE_LINE, F.col("name"), F.col("job_id")).alias("candidate_line"))
    )
