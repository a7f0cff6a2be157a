"""Order-dependent operators over scans (repo_id, scan_ts, score, critical, warning, info), commits and findings of successive scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S

_KEEP = 50


def _order(scans: DataFrame, *more: str) -> Window:
    return Window.partitionBy("repo_id").orderBy("scan_ts", *more)


def keep_last(points: DataFrame, n: int | None = _KEEP) -> DataFrame:
    """The last n points of each repository; all of them if n is None."""
    if n is None:
        return points
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("scan_ts")))
    return points.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def merge_points(stored: DataFrame, incoming: DataFrame, keep: int | None = _KEEP) -> DataFrame:
    """Stored and incoming points by time; at one time the incoming one counts unless its score is the stored one. Out-of-order points fall into place."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    at = Window.partitionBy("repo_id", "scan_ts")
    old = F.max(F.when(F.col("_new") == 0, F.col("score"))).over(at)
    both = both.withColumn("_keep", F.when((F.col("_new") == 1) & F.col("score").eqNullSafe(old), -1).otherwise(F.col("_new")))
    first = F.row_number().over(at.orderBy(F.desc("_keep"), "score"))
    return keep_last(both.withColumn("_r", first).filter("_r = 1").drop("_r", "_new", "_keep"), keep)


def union_history(local: DataFrame, server: DataFrame, keep: int | None = _KEEP) -> DataFrame:
    """Histories united by time; where both have a time the local point stays."""
    both = local.withColumn("_from", F.lit(0)).unionByName(server.withColumn("_from", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("repo_id", "scan_ts").orderBy("_from", "score"))
    return keep_last(both.withColumn("_r", first).filter("_r = 1").drop("_r", "_from"), keep)


def latest_and_previous(scans: DataFrame, *tie: str) -> DataFrame:
    """The newest and the one before of each repository's scans, as columns."""
    recent = scans.withColumn("_r", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("scan_ts"), *(F.desc(t) for t in tie)))).filter("_r <= 2")
    pick = lambda k, c: F.max(F.when(F.col("_r") == k, F.col(c)))
    return recent.groupBy("repo_id").agg(pick(1, "scan_ts").alias("scan_ts"), pick(1, "score").alias("score"), pick(2, "scan_ts").alias("previous_ts"), pick(2, "score").alias("previous_score"))


def scan_timeline(scans: DataFrame, *tie: str) -> DataFrame:
    """Each scan with its changes against the one before."""
    w = _order(scans, *tie)
    out = scans.withColumn("grade", S.grade(F.col("score")))
    for c in ("score", "critical", "warning", "info"):
        out = out.withColumn(f"{c}_delta", F.col(c) - F.lag(c).over(w))
    return out.withColumn("previous_grade", F.lag("grade").over(w))


def score_drops(scans: DataFrame, *tie: str, least: int = 3) -> DataFrame:
    """Scans that are significantly worse than the one before: by grade, else by at least so many points."""
    w = _order(scans, *tie)
    graded = scans.withColumn("grade", S.grade(F.col("score"))).withColumn("previous_score", F.lag("score").over(w))
    graded = graded.withColumn("previous_grade", S.grade(F.col("previous_score"))).filter("previous_score is not null").withColumn("drop", F.col("previous_score") - F.col("score"))
    reason = F.when(S.grade_rank(F.col("grade")) < S.grade_rank(F.col("previous_grade")), "grade").when(F.col("drop") >= least, "score")
    return graded.withColumn("reason", reason).filter("reason is not null")


def rot_trend(scans: DataFrame, as_of, *tie: str, quiet_days: int = 7) -> DataFrame:
    """What to say of each repository: rotting, improved or unchanged, and for how many days; no row if nothing.

    A decline runs back from the newest scan through falls and flat stretches to the oldest fall; a repository that still has an A is not rotting.
    """
    w = _order(scans, *tie)
    moved = scans.withColumn("_move", F.signum(F.col("score") - F.lag("score").over(w))).withColumn("_n", F.row_number().over(w))
    up = moved.groupBy("repo_id").agg(
        F.max(F.when(F.col("_move") > 0, F.col("_n"))).alias("up_n"), F.max(F.when(F.col("_move") > 0, F.col("scan_ts"))).alias("up_ts"),
        F.min("scan_ts").alias("first_ts"), F.count("*").alias("n"), F.max_by("score", "_n").alias("score"),
    )
    falls = moved.filter("_move < 0").join(up.select("repo_id", "up_n"), "repo_id").filter("up_n is null or _n > up_n").groupBy("repo_id").agg(F.min("scan_ts").alias("fall_ts"))
    both = up.filter("n >= 2").join(falls, "repo_id", "left")
    kind = F.when(F.col("fall_ts").isNotNull(), F.when(S.grade(F.col("score")) != "A", "rotting")).when(F.col("up_ts").isNotNull(), "improved").when(F.datediff(F.lit(as_of), F.col("first_ts")) >= quiet_days, "unchanged")
    since = F.coalesce("fall_ts", "up_ts", "first_ts")
    return both.select("repo_id", kind.alias("kind"), F.greatest(F.lit(0), F.datediff(F.lit(as_of), since)).alias("days")).filter("kind is not null")


def portfolio_trend(scans: DataFrame, *tie: str, keep: int | None = _KEEP) -> DataFrame:
    """At each time of any scan: mean score (halves upwards) and findings over every repository's latest scan until then.

    Each scan adds its change against the repository's previous one, and running totals over all times give the averages: no grid of
    repositories and times is made. Only one row for each distinct time reaches the final window.
    """
    last = scans.withColumn("_r", F.row_number().over(Window.partitionBy("repo_id", "scan_ts").orderBy(*(F.desc(t) for t in tie or ("score",))))).filter("_r = 1")
    w = _order(last)
    total = F.col("critical") + F.col("warning") + F.col("info")
    change = last.withColumn("found", total)
    change = change.select(
        "scan_ts", (F.col("score") - F.coalesce(F.lag("score").over(w), F.lit(0))).alias("ds"), (F.col("found") - F.coalesce(F.lag("found").over(w), F.lit(0))).alias("df"),
        F.when(F.lag("score").over(w).isNull(), 1).otherwise(0).alias("dn"),
    ).groupBy("scan_ts").agg(F.sum("ds").alias("ds"), F.sum("df").alias("df"), F.sum("dn").alias("dn"))
    # running totals by day block first, so no single task sorts every time
    block = F.floor(F.unix_timestamp("scan_ts") / (86400 * 32))
    change = change.withColumn("block", block)
    sums = change.groupBy("block").agg(*(F.sum(c).alias(f"b{c}") for c in ("ds", "df", "dn")))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("block", *(F.coalesce(F.sum(f"b{c}").over(upto), F.lit(0)).alias(f"p{c}") for c in ("ds", "df", "dn")))
    inside = Window.partitionBy("block").orderBy("scan_ts")
    run = change.join(before, "block").select("scan_ts", *((F.col(f"p{c}") + F.sum(c).over(inside)).alias(c) for c in ("ds", "df", "dn")))
    out = run.select("scan_ts", S.half_up(F.col("ds") / F.col("dn")).alias("avg_score"), F.col("df").alias("findings"), F.col("dn").alias("repos"))
    return out if keep is None else out.orderBy(F.desc("scan_ts")).limit(keep)


def commits_per_day(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id", F.to_date("commit_ts").alias("day")).agg(F.count("*").alias("commits"))


def heatmap(daily: DataFrame, until: str, weeks: int = 53, by: str = "commits") -> DataFrame:
    """Every day of so many whole weeks, the last one ending on the Saturday from a date on, with a level from 0 (none) to 4 by quarters of the busiest day."""
    spark = daily.sparkSession
    end = f"date_add(date'{until}', 7 - dayofweek(date'{until}'))"
    days = spark.sql(f"select explode(sequence(date_sub({end}, {weeks * 7 - 1}), {end})) as day")
    sums = daily.groupBy("day").agg(F.sum(by).alias("n"))
    most = sums.agg(F.greatest(F.lit(1), F.coalesce(F.max("n"), F.lit(1))).alias("most"))
    out = days.join(sums, "day", "left").fillna(0, ["n"]).crossJoin(F.broadcast(most))
    share = F.col("n") / F.col("most")
    level = F.when(F.col("n") <= 0, 0).when(share < 0.25, 1).when(share < 0.5, 2).when(share < 0.75, 3).otherwise(4)
    return out.select("day", "n", level.alias("level"))


def select_commits(commits: DataFrame, most: int = 18) -> DataFrame:
    """At most so many commits of each repository: the newest and oldest, then tagged and merge commits, then the newest of each week not yet seen."""
    newest = Window.partitionBy("repo_id").orderBy(F.desc("commit_ts"), "sha")
    whole = Window.partitionBy("repo_id")
    c = commits.withColumn("_n", F.row_number().over(newest)).withColumn("_all", F.count("*").over(whole)).withColumn("_week", F.floor(F.unix_timestamp("commit_ts") / (7 * 86400)))
    rank = F.when((F.col("_n") == 1) | (F.col("_n") == F.col("_all")), 0).when(F.col("tagged") | (F.size("parents") >= 2), 1)
    c = c.withColumn("_p", rank)
    first = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.asc_nulls_last("_p"), "_n"))
    c = c.withColumn("_o", first)
    # weeks that a commit of the first two kinds within the budget covers
    seen = F.max(F.when(F.col("_p").isNotNull() & (F.col("_o") <= most), 1).otherwise(0)).over(Window.partitionBy("repo_id", "_week"))
    fresh = F.row_number().over(Window.partitionBy("repo_id", "_week").orderBy(F.col("_p").isNotNull(), "_n"))
    c = c.withColumn("_q", F.when(F.col("_p").isNotNull(), F.col("_p")).when((seen == 0) & (fresh == 1), 2))
    c = c.withColumn("_k", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.asc_nulls_last("_q"), "_n")))
    keep = (F.col("_all") <= most) | (F.col("_q").isNotNull() & (F.col("_k") <= most))
    return c.filter(keep & F.lit(most > 0)).drop("_n", "_all", "_week", "_p", "_o", "_q", "_k")


def finding_diff(previous: DataFrame, current: DataFrame, key: tuple[str, ...] = ("repo_id", "id")) -> DataFrame:
    """(keys, change): ids that are added, fixed or unchanged; equal ids count once."""
    a, b = previous.select(*key).distinct().withColumn("_old", F.lit(True)), current.select(*key).distinct().withColumn("_new", F.lit(True))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "fixed").otherwise("unchanged")
    return a.join(b, list(key), "full").withColumn("change", change).drop("_old", "_new")


def row_diff(previous: DataFrame, current: DataFrame, key: tuple[str, ...] = ("repo_id", "id")) -> DataFrame:
    """Added and fixed counts of rows, not of distinct ids."""
    added = current.join(previous.select(*key).distinct(), list(key), "left_anti").groupBy("repo_id").agg(F.count("*").alias("added"))
    fixed = previous.join(current.select(*key).distinct(), list(key), "left_anti").groupBy("repo_id").agg(F.count("*").alias("fixed"))
    return added.join(fixed, "repo_id", "full").fillna(0, ["added", "fixed"])


def successive_diffs(findings: DataFrame) -> DataFrame:
    """(repo_id, scan_idx, added, fixed) of each scan against the one before, from findings with a scan_idx."""
    ids = findings.select("repo_id", "scan_idx", "id").distinct()
    scans = ids.select("repo_id", "scan_idx").distinct()
    added = ids.join(ids.withColumn("scan_idx", F.col("scan_idx") + 1), ["repo_id", "scan_idx", "id"], "left_anti")
    gone = ids.withColumn("scan_idx", F.col("scan_idx") + 1).join(ids, ["repo_id", "scan_idx", "id"], "left_anti")
    count = lambda df, name: df.groupBy("repo_id", "scan_idx").agg(F.count("*").alias(name))
    first = scans.groupBy("repo_id").agg(F.min("scan_idx").alias("first"))
    out = scans.join(count(added, "added"), ["repo_id", "scan_idx"], "left").join(count(gone, "fixed"), ["repo_id", "scan_idx"], "left").fillna(0, ["added", "fixed"])
    return out.join(first, "repo_id").filter("scan_idx > first").drop("first")


def regression_story(previous: DataFrame, current: DataFrame, scores: DataFrame, newest: int = 5) -> DataFrame:
    """(repo_id, score_delta, added, fixed, new_findings, headline) from findings of two scans and (repo_id, previous_score, score)."""
    diff = finding_diff(previous, current).groupBy("repo_id").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "fixed").alias("fixed"))
    new = current.join(previous.select("repo_id", "id").distinct(), ["repo_id", "id"], "left_anti")
    order = Window.partitionBy("repo_id").orderBy(S.severity_rank(F.col("severity")), "title", "id")
    new = new.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= newest)
    listed = new.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id", "severity", "title"))), lambda x: F.struct(x["id"].alias("id"), x["severity"].alias("severity"), x["title"].alias("title"))).alias("new_findings"))
    out = scores.join(diff, "repo_id", "left").fillna(0, ["added", "fixed"]).join(listed, "repo_id", "left").withColumn("score_delta", F.col("score") - F.col("previous_score"))
    sign = F.when(F.col("score_delta") > 0, F.concat(F.lit("+"), F.col("score_delta").cast("string"))).otherwise(F.col("score_delta").cast("string"))
    side = lambda c: F.concat_ws(" ", S.grade(F.col(c)), F.col(c).cast("string"))
    moved = F.concat(side("previous_score"), F.lit(" → "), side("score"))
    news = F.concat_ws(" · ", F.concat(moved, F.lit(" ("), sign, F.lit(")")), F.when(F.col("added") > 0, F.concat(F.col("added").cast("string"), F.lit(" new"))), F.when(F.col("fixed") > 0, F.concat(F.col("fixed").cast("string"), F.lit(" fixed"))))
    same = (F.col("added") == 0) & (F.col("fixed") == 0) & (F.col("score_delta") == 0)
    return out.withColumn("headline", F.when(same, F.concat(moved, F.lit(" · no change"))).otherwise(news))


def due_watches(watches: DataFrame, as_of, limit: int, hours: int = 24) -> DataFrame:
    """Watches to check: never checked first, then the longest ago, if that is over so many hours."""
    old = F.col("last_checked_ts").isNull() | (F.col("last_checked_ts") <= F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours)))
    return watches.filter(old).orderBy(F.asc_nulls_first("last_checked_ts"), "id").limit(limit)


#: Hours between scans of a repository at least, and where none or another time of day is set.
LEAST_HOURS, HOURS, DAILY = 0.25, 24.0, "03:00"


def due_repos(repos: DataFrame, settings: DataFrame, as_of) -> DataFrame:
    """Repositories (owner, url, scanned_ts, ...) to scan again, with place from 1 in each owner's order, the longest ago first.

    settings: (owner, enabled, mode, interval_hours, daily_time), at most one row of an owner. By interval, a scan is due so many hours after the last; daily, once the time of day has passed (in the
    session's time zone) and there was no scan since. Repositories without an address are never due, nor are those of an owner without settings; one without a scan counts as scanned in 1970.
    """
    own = settings.select(
        "owner", F.coalesce("enabled", F.lit(False)).alias("_on"), F.when(F.col("mode") == "daily", "daily").otherwise("interval").alias("_mode"), F.when(F.col("interval_hours") >= LEAST_HOURS, F.col("interval_hours")).otherwise(HOURS).alias("_hours"),
        F.when(F.coalesce(F.col("daily_time").rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False)), F.col("daily_time")).otherwise(DAILY).alias("_time"),
    )
    now = F.lit(as_of).cast("timestamp")
    last = F.coalesce("scanned_ts", F.timestamp_seconds(F.lit(0)))
    target = F.to_timestamp(F.concat_ws(" ", F.date_format(now, "yyyy-MM-dd"), "_time"), "yyyy-MM-dd HH:mm")
    waited = (F.unix_micros(now) - F.unix_micros(last)) >= F.col("_hours") * 3_600_000_000
    due = F.col("_on") & (F.coalesce("url", F.lit("")) != "") & F.when(F.col("_mode") == "daily", (now >= target) & (last < target)).otherwise(waited)
    place = F.row_number().over(Window.partitionBy("owner").orderBy(last, "url"))
    return repos.join(own, "owner").filter(due).withColumn("place", place).select(*repos.columns, "place")


def rate_limited(events: DataFrame, client: str = "client", at: str = "event_ts", most: int = 30, seconds: int = 3600) -> DataFrame:
    """Events with how many of their client fall in the window that ends with them, and whether that is too many."""
    w = Window.partitionBy(client).orderBy(F.col(at).cast("timestamp").cast("long")).rangeBetween(-seconds + 1, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("limited", F.col("in_window") > most)


def pick_commits(commits: DataFrame, query: str = "", kind: str = "all", big: int = 20) -> DataFrame:
    """Commits whose subject holds the query (in any case) or whose hash begins with it, of a kind: all, tagged, merges (two parents or more) or big (so many files)."""
    q = query.strip().lower()
    out = commits if not q else commits.filter(F.lower("subject").contains(q) | F.col("sha").startswith(q))
    kinds = {"all": F.lit(True), "tagged": F.col("tagged"), "merges": F.size("parents") >= 2}
    return out.filter(F.col("files_changed") >= big if kind == "big" else kinds[kind])


def in_log(log: DataFrame, wanted: DataFrame, most: int | None = 250) -> DataFrame:
    """The log's commits (repo_id, sha, commit_ts) that are wanted (repo_id, sha), newest first, at most so many of a repository (None: all); what the log does not have is left out."""
    out = log.join(wanted.select("repo_id", "sha").distinct(), ["repo_id", "sha"], "left_semi").select(log.columns)
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("commit_ts"), "sha"))
    out = out.withColumn("position", nth)
    return out if most is None else out.filter(F.col("position") <= most)


def live_or_snapshot(wanted: DataFrame, live: DataFrame, snapshot: DataFrame, grade: str = "C", score: int = 70) -> DataFrame:
    """Each wanted repository (owner, name, ...) with grade, score and source: from its live report, else the snapshot, else the given ones.

    live and snapshot: (repo_id as owner/name, grade, score); names are compared in any case; of several rows of a repository the one with the greatest repo_id counts.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.lower("repo_id").alias("_key")).agg(F.max_by(F.struct("grade", "score"), F.struct("repo_id", "score")).alias(name))

    out = wanted.withColumn("_key", F.lower(F.concat_ws("/", "owner", "name"))).join(side(live, "_l"), "_key", "left").join(side(snapshot, "_s"), "_key", "left")
    return out.select(*wanted.columns, F.coalesce("_l.grade", "_s.grade", F.lit(grade)).alias("grade"), F.coalesce("_l.score", "_s.score", F.lit(score)).alias("score"), F.when(F.col("_l").isNotNull(), "live").otherwise("snapshot").alias("source"))
