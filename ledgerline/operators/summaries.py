"""Flatten deploy-summary JSON ``{"resources": {"jobs": {key: info}}}`` into rows.

The document is read once, the values of the jobs object as VARIANT, which keeps what kind of
JSON value each is: ``0`` and ``"0"``, ``false`` and ``"false"`` differ.  Per entry: name =
``info.name`` unless it is falsy, else the key; id = ``info.id`` as text, omitted when falsy (null,
false, a zero, an empty text, array or object); a non-object ``info`` gives (key, null); text that
is not JSON, or whose ``jobs`` is not an object, gives no rows.  A key repeated inside one object
keeps its last value, as a JSON object read into a dict does: Spark's parsed map keeps every
duplicate entry, so the entries are filtered per row before exploding, and an ``info`` that VARIANT
refuses for its repeated keys is read as a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SUMMARY_SCHEMA = "struct<resources:struct<jobs:map<string,variant>>>"
#: The same with raw JSON values, for documents that VARIANT refuses.
TEXT_SCHEMA = "struct<resources:struct<jobs:map<string,string>>>"


def truthy_variant(value: Column) -> Column:
    """The value as text, or null where Python would read it as false."""
    kind, text = F.schema_of_variant(value), value.try_cast("string")
    empty = (
        F.when(kind == F.lit("STRING"), text == F.lit(""))
        .when(kind == F.lit("BOOLEAN"), text == F.lit("false"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), text.isin("[]", "{}"))
        .when(kind == F.lit("VOID"), F.lit(True))
        .otherwise(text.try_cast("double") == 0)
    )
    return F.when(value.isNotNull() & ~F.coalesce(empty, F.lit(False)), text)


def _last_wins(entries: Column) -> Column:
    """Map entries without those whose key comes again."""
    return F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda later: later["key"] == e["key"]),
    )


def _entries(jobs: Column) -> Column:
    # The per-entry filter is an interpreted lambda; run it only on the rare objects that repeat a key.
    repeats_key = F.size(F.array_distinct(F.map_keys(jobs))) < F.size(jobs)
    return F.when(repeats_key, _last_wins(F.map_entries(jobs))).otherwise(F.map_entries(jobs))


def _info_as_variant(raw: Column) -> Column:
    """An info object from its raw text, its repeated keys reduced to the last; null if it isn't an object."""
    plain = F.try_parse_json(raw)
    members = F.from_json(raw, "map<string,variant>")
    last = F.map_from_entries(_last_wins(F.map_entries(members)))
    return F.coalesce(plain, F.to_variant_object(last))


def flatten_summary(summaries: DataFrame, json_col: str = "summary_json") -> DataFrame:
    """``<other columns>, job_key, job_name, job_id`` per job entry of each summary."""
    keep = [c for c in summaries.columns if c != json_col]
    jobs = F.from_json(F.col(json_col), SUMMARY_SCHEMA).getField("resources").getField("jobs")
    raw = F.from_json(F.col(json_col), TEXT_SCHEMA).getField("resources").getField("jobs")
    # A select of its own: inside the generator nothing would share the parsed map.
    parsed = summaries.select(*keep, jobs.alias("_jobs"), F.when(jobs.isNull(), raw).alias("_raw"))
    typed = F.transform(_entries(F.col("_jobs")), lambda e: F.struct(e["key"].alias("job_key"), e["value"].alias("_info")))
    refused = F.transform(_entries(F.col("_raw")), lambda e: F.struct(e["key"].alias("job_key"), _info_as_variant(e["value"]).alias("_info")))
    entries = parsed.select(*keep, F.inline(F.coalesce(typed, refused)))
    # A member of anything but an object is null.
    members = entries.select(*keep, "job_key", *[F.try_variant_get("_info", f"$.{m}", "variant").alias(f"_{m}") for m in ("name", "id")])
    return members.select(*keep, "job_key", F.coalesce(truthy_variant(F.col("_name")), F.col("job_key")).alias("job_name"),
                          truthy_variant(F.col("_id")).alias("job_id"))
