"""Number, size, duration and date formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_readable_size(size: Column) -> Column:
    """`512 B`, `13.4 KB`, … `PB`, base 1024, ties to even; a negative size is an error."""
    number = size.cast("double")
    out = F.when(size < 0, F.raise_error(F.concat(F.lit("size must be non-negative, got "),
                                                  size.cast("string"))).cast("string"))
    out = out.when(number < 1024, F.format_string("%d B", size.cast("bigint")))
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        scaled = F.format_string("%.1f " + unit, F.bround(number / float(1024 ** power), 1))
        if unit == SIZE_UNITS[-1]:
            return out.otherwise(scaled)
        out = out.when(number < float(1024 ** (power + 1)), scaled)
    return out


def format_duration(seconds: Column) -> Column:
    """`1h 2m`, `3m 4s`, `3m`, `5s`; `n/a` for what is not a number."""
    whole = seconds.try_cast("double").try_cast("bigint")
    hours = F.floor(whole / 3600)
    minutes = F.floor((whole % 3600) / 60)
    secs = whole % 60
    return (
        F.when(whole.isNull(), F.lit("n/a"))
        .when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .when((minutes > 0) & (secs > 0), F.format_string("%dm %ds", minutes, secs))
        .when(minutes > 0, F.format_string("%dm", minutes))
        .otherwise(F.format_string("%ds", secs))
    )


def format_report_date(value: Column) -> Column:
    """`05 March 2024 07:08 PM UTC` from an ISO string; other text passes through, none is `n/a`."""
    parsed = F.try_to_timestamp(value)
    return (
        F.when(value.isNull() | (value == ""), F.lit("n/a"))
        .when(parsed.isNull(), value)
        .otherwise(F.concat(F.date_format(parsed, "dd MMMM yyyy hh:mm a"), F.lit(" UTC")))
    )


def format_count(value: Column) -> Column:
    return F.format_number(value, 0)


def timestamp_slug(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd_HHmmss")


def scan_duration(started: Column, finished: Column) -> Column:
    """Seconds between two timestamps, NULL while the scan runs."""
    return (F.unix_micros(finished) - F.unix_micros(started)) / F.lit(1e6)


def status_tone(status: Column) -> Column:
    return F.when(status.isin("PASS", "WARNING", "FAIL"), F.lower(status)).otherwise(F.lit("unknown"))


def title_case(word: Column) -> Column:
    return F.initcap(F.lower(word))


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")
