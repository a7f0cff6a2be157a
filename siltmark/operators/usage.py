"""Usage statistics over events (event_ts, visitor, event, host, repo, amount, ok)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANONYMOUS = "anonymous"


def _known(name: str):
    return F.countDistinct(F.when(F.col("visitor") != ANONYMOUS, F.col("visitor"))).alias(name)


def totals(events: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: distinct visitors, anonymous events, failed scans, commits scanned, and whether the rows reached a limit."""
    amount = F.coalesce("amount", F.lit(1))
    out = events.agg(
        _known("visitors"), F.count_if(F.col("visitor") == ANONYMOUS).alias("anonymous_events"), F.count_if((F.col("event") == "scan") & (F.col("ok") == F.lit(False))).alias("failed_scans"),
        F.coalesce(F.sum(F.when(F.col("event") == "commit-scan", amount)), F.lit(0)).alias("commits_scanned"), F.count("*").alias("events"),
    )
    return out.withColumn("truncated", F.lit(False) if limit is None else F.col("events") >= limit)


def by_event(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count("*").alias("events"), F.sum(F.coalesce("amount", F.lit(1))).alias("amount"), _known("visitors"))


def top_repos(events: DataFrame, n: int = 20, event: str = "scan") -> DataFrame:
    """The repositories with most scans."""
    scans = events.filter((F.col("event") == event) & F.col("repo").isNotNull() & (F.col("repo") != ""))
    return scans.groupBy(F.coalesce("host", F.lit("")).alias("host"), "repo").agg(F.count("*").alias("scans"), _known("visitors")).orderBy(F.desc("scans"), "repo", "host").limit(n)


def daily(events: DataFrame, event: str = "scan") -> DataFrame:
    return events.filter(F.col("event") == event).groupBy(F.to_date("event_ts").alias("day")).agg(F.count("*").alias("scans"), _known("visitors"))


# Points for each unit of a signal, most units that count, and where tiers begin.
SIGNALS = {"confirmed_false_positives": (4.0, 4), "clean_streak_weeks": (1.0, 12), "areas_touched": (1.5, 6)}
TIERS = ((0, "Passing through"), (3, "Reporter"), (8, "Regular"), (15, "Keeper"), (23, "Steward"), (31, "Warden"))


def contributor_points(people: DataFrame) -> DataFrame:
    """Points of people by their signals, whole units up to a limit each; tier, share of the way to the next one, and points to it (null at the top)."""
    units = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.when(~F.isnan(F.col(c).cast("double")), F.coalesce(F.col(c), F.lit(0))).otherwise(0))))
    out = people.withColumn("points", sum((units(c, most) * each for c, (each, most) in SIGNALS.items()), F.lit(0.0)))
    tier, name, start, after = F.lit(0), F.lit(TIERS[0][1]), F.lit(0), F.lit(TIERS[1][0])
    for k, (least, called) in enumerate(TIERS):
        here = F.col("points") >= least
        tier, name, start = F.when(here, k).otherwise(tier), F.when(here, called).otherwise(name), F.when(here, least).otherwise(start)
        after = F.when(here, F.lit(TIERS[k + 1][0] if k + 1 < len(TIERS) else None).cast("int")).otherwise(after)
    ratio = F.when(after.isNull(), 1.0).otherwise((F.col("points") - start) / (after - start))
    return out.withColumns({"tier": tier, "tier_name": name, "ratio": ratio, "to_next": after - F.col("points")})


def owner_summary(repos: DataFrame) -> DataFrame:
    """Per owner of (owner, name, language, stars): repositories, stars, the most used language and the most starred repository."""
    langs = repos.filter("language is not null").groupBy("owner", "language").agg(F.count("*").alias("n"), F.max("stars").alias("s")).groupBy("owner").agg(F.max_by("language", F.struct("n", "s", "language")).alias("language"))
    out = repos.groupBy("owner").agg(F.count("*").alias("repos"), F.sum("stars").alias("stars"), F.max_by("name", F.struct("stars", "name")).alias("best"))
    return out.join(langs, "owner", "left")
