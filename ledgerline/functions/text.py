"""String helpers for names, durations, termination details and traces."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values ---------------------------------------------------------------
# Deploy prefix such as "[dev someone] ".  (?U) makes \s Unicode-aware like
# Python's; \x1c-\x1f are whitespace to Python but not to Java, so they are listed.
DEPLOY_PREFIX = r"(?U)^\[[^\]]*\][\s\x1c-\x1f]*"
TERMINATION_SEPARATOR = " - "
DURATION_FORMAT = "%dm %ds"


def deployed_base(name: Column) -> Column:
    """The name without its leading ``[...]`` deploy prefix and the blanks after it."""
    return F.regexp_replace(name, DEPLOY_PREFIX, "")


def truthy_text(value: Column) -> Column:
    """Null for null or empty strings (Python truthiness of a str)."""
    return F.nullif(value, F.lit(""))


def tail(text: Column, n: int) -> Column:
    """Last ``n`` characters; shorter strings whole."""
    return F.right(text, F.lit(n))


def minutes_seconds_text(seconds: Column) -> Column:
    """'{m}m {s}s' of whole seconds, with floor-division semantics."""
    s = seconds.cast("bigint")
    rem = F.pmod(s, F.lit(60))
    text = F.format_string(DURATION_FORMAT, ((s - rem) / 60).cast("bigint"), rem)
    return F.when(s.isNotNull(), text)


def duration_text(duration_ms: Column) -> Column:
    """'{m}m {s}s' of a millisecond duration; seconds are truncated."""
    return minutes_seconds_text((duration_ms.cast("bigint") / 1000).cast("bigint"))


def termination_summary(code: Column, message: Column) -> Column:
    """'code - message' skipping null/empty parts; null when both are absent."""
    return F.nullif(
        F.concat_ws(TERMINATION_SEPARATOR, truthy_text(code), truthy_text(message)),
        F.lit(""),
    )


def iso_text(ts_ntz: Column) -> Column:
    """ISO-8601 text the way Python's ``isoformat`` writes it: microseconds only if non-zero."""
    micros = F.date_format(ts_ntz, "SSSSSS")
    return F.concat(
        F.date_format(ts_ntz, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros != F.lit("000000"), F.concat(F.lit("."), micros)).otherwise(F.lit("")),
    )
