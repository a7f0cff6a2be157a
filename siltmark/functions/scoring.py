"""Column expressions for penalties, scores, grades, ages, sizes and efforts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "warning", "info")
CATEGORIES = ("env", "dependency", "branch", "todo", "security", "dead-code", "hygiene")
GRADES = ("A", "B", "C", "D", "F")
# Default weight, findings charged in full, exponent beyond that, and hours to fix, of each severity.
WEIGHTS = {"critical": 10.0, "warning": 3.0, "info": 0.25}
FULL = {"critical": 2, "warning": 8, "info": 20}
TAIL = {"critical": 0.7, "warning": 0.5, "info": 0.4}
HOURS = {"critical": 4.0, "warning": 1.5, "info": 0.25}
# The least score of each grade but the last, upper ages (days) and lines of code of buckets.
GRADE_FLOORS = {"A": 90, "B": 75, "C": 60, "D": 40}
AGE_BUCKETS = (("<1mo", 30), ("1-3mo", 90), ("3-6mo", 180), ("6-12mo", 365), (">1y", None))
SIZE_BUCKETS = (("xs", 1_000), ("s", 10_000), ("m", 100_000), ("l", 1_000_000), ("xl", None))


def half_up(x: Column) -> Column:
    """Round to a whole number, halves upwards."""
    return F.floor(x + 0.5)


def severity_rank(severity: Column) -> Column:
    """0 for the worst; an unknown severity comes last."""
    out = F.lit(len(SEVERITIES))
    for k, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, k).otherwise(out)
    return out


def severity_value(severity: Column, of: dict[str, float]) -> Column:
    """A number for each severity, null for an unknown one."""
    out = F.lit(None).cast("double")
    for s in SEVERITIES:
        out = F.when(severity == s, float(of[s])).otherwise(out)
    return out


def tier_penalty(count: Column, severity: str, weight: float | Column | None = None) -> Column:
    """Points that so many findings of a severity take off: in full up to a number, with a falling exponent beyond."""
    w = F.lit(WEIGHTS[severity]) if weight is None else (weight if isinstance(weight, Column) else F.lit(float(weight)))
    full, n = FULL[severity], count.cast("double")
    return F.when(count <= 0, 0.0).when(count <= full, n * w).otherwise(w * (full + F.pow(F.greatest(n - full, F.lit(0.0)), F.lit(TAIL[severity]))))


def score(critical: Column, warning: Column, info: Column, weights: dict[str, float] | None = None) -> Column:
    w = {**WEIGHTS, **(weights or {})}
    lost = sum((tier_penalty(c, s, w[s]) for c, s in ((critical, "critical"), (warning, "warning"), (info, "info"))), F.lit(0.0))
    return F.greatest(F.lit(0), half_up(100 - lost)).cast("int")


def grade(points: Column) -> Column:
    out = F.lit("F")
    for g, least in reversed(list(GRADE_FLOORS.items())):
        out = F.when(points >= least, g).otherwise(out)
    return out


def grade_rank(letter: Column) -> Column:
    """5 for A down to 1 for F."""
    out = F.lit(None).cast("int")
    for k, g in enumerate(GRADES):
        out = F.when(letter == g, 5 - k).otherwise(out)
    return out


def bucket(value: Column, buckets: tuple[tuple[str, int | None], ...]) -> Column:
    """Name of the first bucket whose upper bound is above the value."""
    out = F.lit(buckets[-1][0])
    for name, below in reversed(buckets[:-1]):
        out = F.when(value < below, name).otherwise(out)
    return out


def _plain(x: Column) -> Column:
    """A number without a trailing .0"""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def effort_text(hours: Column) -> Column:
    """Hours in words: minutes below one hour, hours below 16, days of eight hours beyond."""
    tenth = half_up(hours * 10) / 10
    return (
        F.when(hours.isNull() | F.isnan(hours) | (hours <= 0), "0h")
        .when(hours < 1, F.concat(F.greatest(F.lit(15), half_up(hours * 60)).cast("string"), F.lit("m")))
        .when(hours < 10, F.concat(_plain(tenth), F.lit("h")))
        .when(hours < 16, F.concat(half_up(hours).cast("string"), F.lit("h")))
        .otherwise(F.concat(_plain(half_up(hours / 8 * 10) / 10), F.lit("d")))
    )


def verdict(points: Column, critical: Column, warning: Column, findings: Column) -> Column:
    """clean, strong, fair or poor; a single critical finding makes it poor."""
    return F.when(critical > 0, "poor").when(findings == 0, "clean").when((points >= 75) & (warning == 0), "strong").when(points >= 60, "fair").otherwise("poor")


def size_verdict(kilobytes: Column, most_megabytes: float) -> Column:
    """ok, large (from two fifths of the limit) or over."""
    mb = kilobytes / 1024
    return F.when(kilobytes.isNull() | (kilobytes <= 0) | F.lit(most_megabytes <= 0), "ok").when(mb >= most_megabytes, "over").when(mb >= most_megabytes * 0.4, "large").otherwise("ok")


def location_path(location: Column) -> Column:
    """The file a finding lies in, or null: without a commit, line or column; not a branch, a pattern or the whole repository."""
    # one expression, so that it is worked out once however often a plan names it
    file = F.regexp_extract(F.substring_index(location, " @ ", 1), r"^ *(?!origin/)([^*]*?) *(?::\d+(?::\d+)?)? *$", 1)
    return F.nullif(file, F.lit(""))


def location_line(location: Column) -> Column:
    """The line a finding lies on, or null."""
    return F.nullif(F.regexp_extract(F.split(location, " @ ")[0], r":(\d+)(?::\d+)?$", 1), F.lit("")).cast("int")


def location_kind(location: Column) -> Column:
    return (
        F.when(location.isNull() | (F.trim(location) == ""), None).when(location == ".", "repository").when(location.startswith("origin/"), "branch")
        .when(location.contains(" @ "), "history").when(location.contains("#"), "pointer").when(location.contains("*"), "pattern")
        .when(location_line(location).isNotNull(), "line").otherwise("file")
    )
