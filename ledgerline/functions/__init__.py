"""Column-expression helpers: all built-in Spark functions, no UDFs."""

from ledgerline.functions.money import fits_report, gross_amount, net_amount, report_money, wide_sum
from ledgerline.functions.text import (
    deployed_base,
    duration_text,
    iso_text,
    minutes_seconds_text,
    tail,
    termination_summary,
    truthy_text,
)
from ledgerline.functions.time import epoch_millis, from_epoch_millis

__all__ = [
    "gross_amount", "net_amount", "wide_sum", "report_money", "fits_report",
    "deployed_base", "duration_text", "iso_text", "minutes_seconds_text", "tail",
    "termination_summary", "truthy_text",
    "epoch_millis", "from_epoch_millis",
]
