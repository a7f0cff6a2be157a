"""Named queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import findings as FI
from ..operators import metrics as M
from ..operators import timeline as TL
from ..operators import usage as U
from ..session import table
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.floor(F.col(c) * 10**digits + 0.5) / 10**digits)
    return df


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


_TIER = {s: f"(CASE WHEN {s} <= {S.FULL[s]} THEN {s} * {S.WEIGHTS[s]}::DOUBLE ELSE {S.WEIGHTS[s]}::DOUBLE * ({S.FULL[s]} + power(greatest({s} - {S.FULL[s]}, 0)::DOUBLE, {S.TAIL[s]}::DOUBLE)) END)" for s in S.SEVERITIES}
_POINTS = f"greatest(0, floor(100 - ({' + '.join(_TIER.values())}) + 0.5))::BIGINT"
_GRADE = lambda c: f"CASE WHEN {c} >= 90 THEN 'A' WHEN {c} >= 75 THEN 'B' WHEN {c} >= 60 THEN 'C' WHEN {c} >= 40 THEN 'D' ELSE 'F' END"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
_WEIGHT = "CASE severity WHEN 'critical' THEN 10.0::DOUBLE WHEN 'warning' THEN 3.0::DOUBLE ELSE 0.25::DOUBLE END"
_HOURS = "CASE severity WHEN 'critical' THEN 4.0::DOUBLE WHEN 'warning' THEN 1.5::DOUBLE ELSE 0.25::DOUBLE END"
_F = f"WITH findings AS ({V.FINDINGS})"
_COUNTS = "SELECT {by}, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) AS findings FROM findings GROUP BY {by}"
_SCORES = f"{_F}, counts AS ({_COUNTS.format(by='repo_id')}), scores AS (SELECT *, {_POINTS} AS score FROM counts)"
_S = f"WITH scans AS ({V.SCANS})"
_ST = f"WITH stats AS ({V.SCAN_STATS})"
_U = f"WITH usage AS ({V.USAGE})"
_L = f"WITH lines AS ({V.LINES})"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return M.repo_scores(V.findings(spark, d))


@query(f"{_SCORES} SELECT repo_id, critical, warning, info, findings, score, {_GRADE('score')} AS grade FROM scores")
def repo_health_score(spark: SparkSession, d: str) -> DataFrame:
    return _long(_scores(spark, d), "score")


@query(f"{_SCORES} SELECT {_GRADE('score')} AS grade, count(*) AS repos FROM scores GROUP BY 1")
def grade_distribution(spark: SparkSession, d: str) -> DataFrame:
    return M.grade_distribution(_scores(spark, d))


@query(f"{_F} {_COUNTS.format(by='category')}")
def severity_by_category(spark: SparkSession, d: str) -> DataFrame:
    return M.severity_counts(V.findings(spark, d), ["category"])


_BREAKDOWN = " UNION ALL ".join(f"SELECT repo_id, '{s}' AS severity, {s} AS findings, {_TIER[s]} AS penalty, {s} > {S.FULL[s]} AS discounted FROM counts" for s in S.SEVERITIES)


@query(f"{_SCORES}, b AS ({_BREAKDOWN}) SELECT repo_id, severity, findings, floor(penalty * 10000 + 0.5) / 10000 AS penalty, discounted FROM b")
def penalty_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.penalty_breakdown(V.findings(spark, d)), "penalty")


@query(f"{_SCORES}, b AS ({_BREAKDOWN}) SELECT f.repo_id, f.id, f.severity, floor(b.penalty / b.findings * 10000 + 0.5) / 10000 AS cost FROM findings f JOIN b ON f.repo_id = b.repo_id AND f.severity = b.severity")
def issue_costs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.issue_costs(V.findings(spark, d)).select("repo_id", "id", "severity", "cost"), "cost")


@query(
    f"{_SCORES}, b AS ({_BREAKDOWN}) SELECT f.repo_id, f.category, floor(sum(b.penalty / b.findings) * 10000 + 0.5) / 10000 AS cost, count(*) AS findings FROM findings f JOIN b ON f.repo_id = b.repo_id AND f.severity = b.severity GROUP BY ALL"
)
def category_costs(spark: SparkSession, d: str) -> DataFrame:
    return _long(_rounded(M.category_costs(V.findings(spark, d)), "cost"), "findings")


@query(f"{_F}, counts AS ({_COUNTS.format(by='repo_id, category')}) SELECT repo_id, category, {_POINTS} AS score, {_GRADE(_POINTS)} AS grade, findings FROM counts")
def category_scores(spark: SparkSession, d: str) -> DataFrame:
    return _long(M.category_scores(V.findings(spark, d)), "score")


_BUCKET = "CASE WHEN age_days < 30 THEN '<1mo' WHEN age_days < 90 THEN '1-3mo' WHEN age_days < 180 THEN '3-6mo' WHEN age_days < 365 THEN '6-12mo' ELSE '>1y' END"


@query(
    f"""{_F}, b AS (SELECT *, {_BUCKET} AS bucket FROM findings), names AS (SELECT unnest(['<1mo', '1-3mo', '3-6mo', '6-12mo', '>1y']) AS bucket, unnest(range(5)) AS bucket_order)
    SELECT n.bucket, bucket_order, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(id) AS total
    FROM names n LEFT JOIN b ON n.bucket = b.bucket GROUP BY 1, 2"""
)
def age_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _long(M.age_histogram(V.findings(spark, d)), "bucket_order")


@query(f"{_F} SELECT category, floor(median(age_days) + 0.5)::BIGINT AS median_age_days FROM findings GROUP BY 1")
def median_age(spark: SparkSession, d: str) -> DataFrame:
    return _long(M.median_age(V.findings(spark, d), ["category"]), "median_age_days")


@query(
    f"""{_F}, h AS (SELECT repo_id, sum({_HOURS}) AS hours FROM findings GROUP BY 1)
    SELECT repo_id, hours, CASE WHEN hours < 1 THEN greatest(15, floor(hours * 60 + 0.5))::BIGINT::VARCHAR || 'm'
      WHEN hours < 10 THEN regexp_replace((floor(hours * 10 + 0.5) / 10)::VARCHAR, '\\.0$', '') || 'h' WHEN hours < 16 THEN floor(hours + 0.5)::BIGINT::VARCHAR || 'h'
      ELSE regexp_replace((floor(hours / 8 * 10 + 0.5) / 10)::VARCHAR, '\\.0$', '') || 'd' END AS effort FROM h"""
)
def debt_hours(spark: SparkSession, d: str) -> DataFrame:
    return M.debt_hours(V.findings(spark, d), ["repo_id"])


@query(
    f"""{_F}, c AS ({_COUNTS.format(by='repo_id')}), l AS (SELECT o_orderkey AS repo_id, floor(o_totalprice)::BIGINT AS lines_of_code FROM orders)
    SELECT c.repo_id, findings, floor(findings / (lines_of_code / 1000.0::DOUBLE) * 10000 + 0.5) / 10000 AS density FROM c JOIN l USING (repo_id)"""
)
def issue_density(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "orders").select(F.col("o_orderkey").alias("repo_id"), F.floor("o_totalprice").alias("lines_of_code"))
    return _rounded(M.issue_density(M.severity_counts(V.findings(spark, d)).join(size, "repo_id")).select("repo_id", "findings", "density"), "density")


def _as_repo(spark: SparkSession, d: str, group: str) -> DataFrame:
    """Findings with a coarser repository, so that files gather several."""
    f = V.findings(spark, d)
    return f.withColumn("repo_id", F.col("category") if group == "category" else F.pmod("repo_id", F.lit(int(group))))


@query(
    f"""{_F}, g AS (SELECT category AS repo_id, path, sum({_WEIGHT}) AS weight, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM findings GROUP BY 1, 2),
    m AS (SELECT *, max(findings) OVER (PARTITION BY repo_id) AS most FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY weight DESC, findings DESC, path) AS rank FROM m WHERE findings > 1 OR most = 1)
    SELECT repo_id, path, weight, findings, critical, warning, info, rank FROM r WHERE rank <= 6"""
)
def hotspot_files(spark: SparkSession, d: str) -> DataFrame:
    return _long(M.hotspot_files(_as_repo(spark, d, "category")), "rank")


@query(
    f"""{_F}, n AS (SELECT category AS repo_id, {_WEIGHT} AS w, severity, unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path]) AS node, unnest(range(4)) AS depth FROM findings)
    SELECT repo_id, node, depth, CASE depth WHEN 0 THEN 'root' WHEN 3 THEN 'file' ELSE 'dir' END AS kind, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
      count(*) FILTER (severity = 'info') AS info, count(*) AS findings, sum(w) AS weight, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'warning' ELSE 'info' END AS worst
    FROM n GROUP BY 1, 2, 3"""
)
def dir_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _long(M.tree_nodes(_as_repo(spark, d, "category")), "depth")


@query(
    f"""{_F}, f AS (SELECT repo_id % 1000 AS repo_id, path, regexp_extract(path, '^(src/d[0-9]+)/', 1) AS folder, severity FROM findings),
    n AS (SELECT repo_id, 'src' AS node, 'dir' AS kind, 1 AS depth, severity FROM f UNION ALL SELECT repo_id, folder, 'dir', 2, severity FROM f UNION ALL SELECT repo_id, path, 'file', 3, severity FROM f),
    lone AS (SELECT repo_id FROM f GROUP BY 1 HAVING count(DISTINCT folder) = 1),
    g AS (SELECT repo_id, node, kind, depth, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) AS findings, sum({_WEIGHT}) AS weight FROM n GROUP BY 1, 2, 3, 4)
    SELECT g.*, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' ELSE 'info' END AS worst,
      CASE WHEN depth = 2 AND repo_id IN (SELECT repo_id FROM lone) OR depth = 1 THEN node ELSE regexp_extract(node, '([^/]*)$', 1) END AS label FROM g WHERE NOT (depth = 1 AND repo_id IN (SELECT repo_id FROM lone))"""
)
def dir_rollup_compressed(spark: SparkSession, d: str) -> DataFrame:
    return M.compressed_tree(M.tree_nodes(_as_repo(spark, d, "1000")))


@query(f"{_F}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_RANK}, age_days DESC, ord, id) AS rank FROM findings) SELECT repo_id, id, severity, age_days, rank, {_HOURS} AS hours FROM r WHERE rank <= 3")
def quick_wins(spark: SparkSession, d: str) -> DataFrame:
    return _long(M.quick_wins(V.findings(spark, d), 3).select("repo_id", "id", "severity", "age_days", "rank", "hours"), "rank", "age_days")


@query(f"{_F} SELECT repo_id, id, severity, age_days FROM findings ORDER BY {_RANK}, age_days DESC, ord, id LIMIT 100")
def top_findings(spark: SparkSession, d: str) -> DataFrame:
    return _long(M.top_findings(V.findings(spark, d), 100).select("repo_id", "id", "severity", "age_days"), "age_days")


@query(
    f"""{_F}, g AS (SELECT category AS repo_id, scanner, count(*) AS findings, min({_RANK}) AS k FROM findings GROUP BY 1, 2)
    SELECT repo_id, scanner, findings, row_number() OVER (PARTITION BY repo_id ORDER BY k, findings DESC, scanner) AS position, ['critical', 'warning', 'info'][k + 1] AS worst FROM g"""
)
def scanner_groups(spark: SparkSession, d: str) -> DataFrame:
    return _long(M.scanner_groups(_as_repo(spark, d, "category")), "position")


@query(f"{_F} SELECT repo_id, id FROM findings WHERE NOT (category = 'todo' OR regexp_matches(path, '^src/d1[0-9]*/f[^/]*\\.ts$') OR (category = 'env' AND regexp_matches(path, '^(.*/)?f[^/][^/]\\.ts$')))")
def mute_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [{"category": "todo"}, {"path": "src/d1*/f*.ts"}, {"category": "env", "path": "**/f??.ts"}, {"reason": "mutes nothing"}]
    # a folder of one digit or more after d1: the pattern's star stays in one part of the path
    return FI.apply_mutes(V.findings(spark, d), rules).select("repo_id", "id")


@query(f"{_F} SELECT repo_id, id FROM findings WHERE scanner IN ('insecure-code', 'secrets', 'vulnerable-deps', 'workflow-security', 'supply-chain')")
def mode_lens(spark: SparkSession, d: str) -> DataFrame:
    return FI.in_mode(V.findings(spark, d), "security").select("repo_id", "id")


@query(f"{_F} SELECT repo_id, id FROM findings WHERE severity <> 'info' AND category = 'security' AND scanner = 'secrets'")
def severity_filter(spark: SparkSession, d: str) -> DataFrame:
    return FI.filter_findings(V.findings(spark, d), "actionable", "security", "secrets").select("repo_id", "id")


@query(
    f"""{_L}, marks AS (SELECT repo_id, path, line + CASE WHEN text LIKE '%or as%' THEN 1 ELSE 0 END AS line FROM lines WHERE text LIKE '%or a%'),
    f AS (SELECT repo_id, path, line FROM lines WHERE text LIKE '%the%') SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.repo_id = f.repo_id AND m.path = f.path AND m.line = f.line)"""
)
def inline_ignore(spark: SparkSession, d: str) -> DataFrame:
    ln = V.lines(spark, d).select("repo_id", "path", "line", "text")
    found = ln.filter(F.col("text").contains("the")).select("repo_id", "path", "line", F.concat_ws(":", "path", F.col("line").cast("string")).alias("location"))
    return _long(FI.drop_ignored(found, ln, "or a", "or as").drop("location"), "line")


@query(
    f"""{_F}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY ord, id) AS a FROM (SELECT category AS repo_id, path, id, ord FROM findings)),
    s AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord, id) AS b FROM r WHERE a <= 5) SELECT repo_id, id FROM s WHERE b <= 40"""
)
def capped_findings(spark: SparkSession, d: str) -> DataFrame:
    return FI.cap(_as_repo(spark, d, "category"), 40, 5).select("repo_id", "id")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = V.findings(spark, d).withColumn("repo_id", F.pmod("repo_id", F.lit(1000))).withColumn("id", F.substring_index("location", ":", 1))
    return f.filter("ord <= 2"), f.filter("ord >= 2")


_HALVES = f"{_F}, f AS (SELECT repo_id % 1000 AS repo_id, path AS id, ord, severity, title FROM findings), a AS (SELECT * FROM f WHERE ord <= 2), b AS (SELECT * FROM f WHERE ord >= 2)"


@query(
    f"""{_HALVES}, x AS (SELECT DISTINCT repo_id, id FROM a), y AS (SELECT DISTINCT repo_id, id FROM b)
    SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'added' WHEN y.id IS NULL THEN 'fixed' ELSE 'unchanged' END AS change FROM x FULL JOIN y ON x.repo_id = y.repo_id AND x.id = y.id"""
)
def scan_diff(spark: SparkSession, d: str) -> DataFrame:
    return TL.finding_diff(*_halves(spark, d))


@query(
    f"""{_HALVES}, p AS (SELECT repo_id, count(*) AS added FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.repo_id = b.repo_id AND a.id = b.id) GROUP BY 1),
    q AS (SELECT repo_id, count(*) AS fixed FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.repo_id = b.repo_id AND a.id = b.id) GROUP BY 1)
    SELECT coalesce(p.repo_id, q.repo_id) AS repo_id, coalesce(added, 0) AS added, coalesce(fixed, 0) AS fixed FROM p FULL JOIN q ON p.repo_id = q.repo_id"""
)
def scan_diff_rows(spark: SparkSession, d: str) -> DataFrame:
    return TL.row_diff(*_halves(spark, d))


@query(
    f"""{_F}, ids AS (SELECT DISTINCT repo_id % 100 AS repo_id, ord AS scan_idx, path AS id FROM findings), scans AS (SELECT DISTINCT repo_id, scan_idx FROM ids),
    a AS (SELECT repo_id, scan_idx, count(*) AS n FROM ids i WHERE NOT EXISTS (SELECT 1 FROM ids j WHERE j.repo_id = i.repo_id AND j.id = i.id AND j.scan_idx = i.scan_idx - 1) GROUP BY 1, 2),
    g AS (SELECT repo_id, scan_idx + 1 AS scan_idx, count(*) AS n FROM ids i WHERE NOT EXISTS (SELECT 1 FROM ids j WHERE j.repo_id = i.repo_id AND j.id = i.id AND j.scan_idx = i.scan_idx + 1) GROUP BY 1, 2)
    SELECT s.repo_id, s.scan_idx, coalesce(a.n, 0) AS added, coalesce(g.n, 0) AS fixed FROM scans s LEFT JOIN a USING (repo_id, scan_idx) LEFT JOIN g USING (repo_id, scan_idx)
    WHERE s.scan_idx > (SELECT min(scan_idx) FROM scans t WHERE t.repo_id = s.repo_id)"""
)
def scan_history_diffs(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d).select(F.pmod("repo_id", F.lit(100)).alias("repo_id"), F.col("ord").alias("scan_idx"), F.substring_index("location", ":", 1).alias("id"))
    return TL.successive_diffs(f)


@query()
def regression_story(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    before, after = (M.repo_scores(x).select("repo_id", F.col("score").alias(n)) for x, n in ((old, "previous_score"), (new, "score")))
    return TL.regression_story(old, new, before.join(after, "repo_id"))


_LAG = "lag({c}) OVER (PARTITION BY repo_id ORDER BY scan_ts, scan_id)"


@query(f"{_S} SELECT repo_id, scan_id, scan_ts, score, score - {_LAG.format(c='score')} AS score_delta, critical - {_LAG.format(c='critical')} AS critical_delta, {_GRADE('score')} AS grade FROM scans")
def scan_timeline(spark: SparkSession, d: str) -> DataFrame:
    return TL.scan_timeline(V.scans(spark, d), "scan_id").select("repo_id", "scan_id", "scan_ts", "score", "score_delta", "critical_delta", "grade")


@query(
    f"""{_S}, l AS (SELECT repo_id, scan_id, score, {_LAG.format(c='score')} AS previous_score FROM scans), g AS (SELECT *, {_GRADE('score')} AS grade, {_GRADE('previous_score')} AS previous_grade FROM l WHERE previous_score IS NOT NULL)
    SELECT repo_id, scan_id, score, previous_score, grade, previous_grade, CASE WHEN grade > previous_grade THEN 'grade' ELSE 'score' END AS reason FROM g WHERE grade > previous_grade OR previous_score - score >= 3"""
)
def score_drop_alerts(spark: SparkSession, d: str) -> DataFrame:
    return TL.score_drops(V.scans(spark, d), "scan_id").select("repo_id", "scan_id", "score", "previous_score", "grade", "previous_grade", "reason")


@query(
    f"""{_S}, m AS (SELECT *, sign(score - {_LAG.format(c='score')}) AS move, row_number() OVER (PARTITION BY repo_id ORDER BY scan_ts, scan_id) AS n FROM scans),
    u AS (SELECT repo_id, max(n) FILTER (move > 0) AS up_n, max(scan_ts) FILTER (move > 0) AS up_ts, min(scan_ts) AS first_ts, count(*) AS c, arg_max(score, n) AS score FROM m GROUP BY 1),
    f AS (SELECT m.repo_id, min(scan_ts) AS fall_ts FROM m JOIN u USING (repo_id) WHERE move < 0 AND (up_n IS NULL OR n > up_n) GROUP BY 1),
    k AS (SELECT u.repo_id, CASE WHEN fall_ts IS NOT NULL THEN CASE WHEN score < 90 THEN 'rotting' END WHEN up_ts IS NOT NULL THEN 'improved' WHEN date_diff('day', first_ts::DATE, DATE '{V.AS_OF}') >= 7 THEN 'unchanged' END AS kind,
      greatest(0, date_diff('day', coalesce(fall_ts, up_ts, first_ts)::DATE, DATE '{V.AS_OF}')) AS days FROM u LEFT JOIN f USING (repo_id) WHERE c >= 2) SELECT * FROM k WHERE kind IS NOT NULL"""
)
def rot_trend(spark: SparkSession, d: str) -> DataFrame:
    return _long(TL.rot_trend(V.scans(spark, d), V.AS_OF, "scan_id"), "days")


@query(
    f"""{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_ts DESC, scan_id DESC) AS n FROM scans)
    SELECT repo_id, max(scan_ts) FILTER (n = 1) AS scan_ts, max(score) FILTER (n = 1) AS score, max(scan_ts) FILTER (n = 2) AS previous_ts, max(score) FILTER (n = 2) AS previous_score FROM r GROUP BY 1"""
)
def latest_and_previous(spark: SparkSession, d: str) -> DataFrame:
    return TL.latest_and_previous(V.scans(spark, d), "scan_id")


@query(
    f"""{_S}, p AS (SELECT repo_id, scan_ts, max(score) AS score FROM scans GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_ts DESC) AS n FROM p) SELECT repo_id, scan_ts, score FROM r WHERE n <= 10"""
)
def history_last(spark: SparkSession, d: str) -> DataFrame:
    return TL.keep_last(V.scans(spark, d).groupBy("repo_id", "scan_ts").agg(F.max("score").alias("score")), 10)


@query(
    f"""{_S}, a AS (SELECT repo_id, scan_ts::DATE AS day, max(score) AS score FROM scans WHERE scan_ts < DATE '1999-01-01' GROUP BY ALL), b AS (SELECT repo_id, scan_ts::DATE AS day, max(score) AS score FROM scans WHERE scan_ts >= DATE '1997-01-01' GROUP BY ALL)
    SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.day, b.day)::TIMESTAMP AS scan_ts, coalesce(b.score, a.score) AS score FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.day = b.day"""
)
def merged_history(spark: SparkSession, d: str) -> DataFrame:
    """Merged points of an older and a newer history, which overlap in some years and together hold every scan."""
    day = V.scans(spark, d).withColumn("scan_ts", F.date_trunc("day", "scan_ts"))
    part = lambda which: day.filter(which).groupBy("repo_id", "scan_ts").agg(F.max("score").alias("score"))
    return TL.merge_points(part("scan_ts < timestamp '1999-01-01'"), part("scan_ts >= timestamp '1997-01-01'"), keep=None)


@query(
    f"""{_S}, a AS (SELECT repo_id, scan_ts::DATE AS day, max(score) AS score FROM scans WHERE scan_id % 3 <> 0 GROUP BY ALL), b AS (SELECT repo_id, scan_ts::DATE AS day, max(score) AS score FROM scans WHERE scan_id % 2 = 0 OR scan_id % 3 = 0 GROUP BY ALL)
    SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.day, b.day)::TIMESTAMP AS scan_ts, coalesce(b.score, a.score) AS score FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.day = b.day"""
)
def merged_history_whole(spark: SparkSession, d: str) -> DataFrame:
    """As merged_history, of two histories that overlap and together hold every scan."""
    day = V.scans(spark, d).withColumn("scan_ts", F.date_trunc("day", "scan_ts"))
    part = lambda which: day.filter(which).groupBy("repo_id", "scan_ts").agg(F.max("score").alias("score"))
    return TL.merge_points(part("scan_id % 3 <> 0"), part("scan_id % 2 = 0 or scan_id % 3 = 0"), keep=None)


@query(
    f"""{_S}, c AS (SELECT repo_id % 20 AS repo_id, date_trunc('month', scan_ts) AS scan_ts, scan_id, score, critical, warning, info FROM scans),
    p AS (SELECT repo_id, scan_ts, score, critical + warning + info AS found, row_number() OVER (PARTITION BY repo_id, scan_ts ORDER BY scan_id DESC) AS n FROM c), l AS (SELECT * FROM p WHERE n = 1),
    t AS (SELECT DISTINCT scan_ts FROM l), r AS (SELECT DISTINCT repo_id FROM l),
    g AS (SELECT t.scan_ts, r.repo_id, last_value(l.score IGNORE NULLS) OVER w AS score, last_value(l.found IGNORE NULLS) OVER w AS found FROM t CROSS JOIN r LEFT JOIN l ON l.scan_ts = t.scan_ts AND l.repo_id = r.repo_id WINDOW w AS (PARTITION BY r.repo_id ORDER BY t.scan_ts))
    SELECT scan_ts::TIMESTAMP AS scan_ts, floor(avg(score) + 0.5)::BIGINT AS avg_score, sum(found)::BIGINT AS findings, count(score) AS repos FROM g WHERE score IS NOT NULL GROUP BY 1"""
)
def portfolio_trend(spark: SparkSession, d: str) -> DataFrame:
    s = V.scans(spark, d).withColumn("repo_id", F.pmod("repo_id", F.lit(20))).withColumn("scan_ts", F.date_trunc("month", "scan_ts"))
    return _long(TL.portfolio_trend(s, "scan_id", keep=None), "avg_score", "findings", "repos")


@query(
    f"""WITH c AS ({V.COMMITS}), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commit_ts DESC, sha) AS n, count(*) OVER (PARTITION BY repo_id) AS a, floor(epoch(commit_ts) / 604800) AS week FROM c),
    p AS (SELECT *, CASE WHEN n = 1 OR n = a THEN 0 WHEN tagged OR merge THEN 1 END AS p FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY p NULLS LAST, n) AS o FROM p),
    w AS (SELECT *, max(CASE WHEN p IS NOT NULL AND o <= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, week) AS seen, row_number() OVER (PARTITION BY repo_id, week ORDER BY p IS NOT NULL, n) AS fresh FROM o),
    q AS (SELECT *, CASE WHEN p IS NOT NULL THEN p WHEN seen = 0 AND fresh = 1 THEN 2 END AS q FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY q NULLS LAST, n) AS k FROM q)
    SELECT repo_id, sha, commit_ts FROM k WHERE a <= 8 OR (q IS NOT NULL AND k <= 8)"""
)
def commit_sampling(spark: SparkSession, d: str) -> DataFrame:
    return TL.select_commits(V.commits(spark, d), 8).select("repo_id", "sha", "commit_ts")


@query(f"WITH c AS ({V.COMMITS}) SELECT repo_id, commit_ts::DATE AS day, count(*) AS commits FROM c GROUP BY ALL")
def commits_per_day(spark: SparkSession, d: str) -> DataFrame:
    return TL.commits_per_day(V.commits(spark, d))


@query(
    f"""{_ST}, t AS (SELECT DISTINCT repo_id AS target_id, language, size, arg_max(score, scan_id) AS score FROM stats GROUP BY ALL),
    c AS (SELECT target_id, t.score, 0 AS k, 'language-size' AS basis, s.score AS v FROM t JOIN stats s USING (language, size) UNION ALL SELECT target_id, t.score, 1, 'language', s.score FROM t JOIN stats s USING (language)
      UNION ALL SELECT target_id, t.score, 2, 'size', s.score FROM t JOIN stats s USING (size) UNION ALL SELECT target_id, t.score, 3, 'all', s.score FROM t CROSS JOIN stats s),
    g AS (SELECT target_id, k, basis, count(*) AS sample, count(*) FILTER (v < score) AS below, count(*) FILTER (v > score) AS above FROM c GROUP BY ALL HAVING count(*) >= 30),
    f AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY k) AS n FROM g)
    SELECT target_id, basis, sample, floor(below / sample * 100 + 0.5)::BIGINT AS better_than, floor(above / sample * 100 + 0.5)::BIGINT AS worse_than FROM f WHERE n = 1"""
)
def percentile_fallback(spark: SparkSession, d: str) -> DataFrame:
    stats = V.scan_stats(spark, d)
    targets = stats.groupBy(F.col("repo_id").alias("target_id"), "language", "size").agg(F.max_by("score", "scan_id").alias("score"))
    return _long(M.percentile_shares(stats, targets), "sample", "better_than", "worse_than")


@query(f"{_ST} SELECT count(*) AS scans, floor(median(score) + 0.5)::BIGINT AS median_score, " + ", ".join(f"count(*) FILTER ({_GRADE('score')} = '{g}') AS grade_{g.lower()}" for g in S.GRADES) + " FROM stats HAVING count(*) >= 30")
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return _long(M.scan_summary(V.scan_stats(spark, d)), "median_score")


@query(f"{_F}, x AS (SELECT category, title, count(DISTINCT repo_id) AS repos, min({_RANK}) AS k FROM findings GROUP BY 1, 2) SELECT category, title, repos, ['critical', 'warning', 'info'][k + 1] AS severity FROM x WHERE repos >= 2")
def batch_shared_findings(spark: SparkSession, d: str) -> DataFrame:
    return M.shared_findings(V.findings(spark, d))


@query(
    f"""{_SCORES}, n AS (SELECT repo_id, category, count(*) AS n FROM findings GROUP BY 1, 2), t AS (SELECT repo_id, category AS top_category, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, category DESC) AS r FROM n)
    SELECT s.repo_id, score, {_GRADE('score')} AS grade, critical, top_category FROM scores s LEFT JOIN t ON t.repo_id = s.repo_id AND r = 1"""
)
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    return _long(M.batch_summary(M.repo_scores(f), f).select("repo_id", "score", "grade", "critical", "top_category"), "score")


@query(f"{_SCORES} SELECT (SELECT count(*) FROM scores) AS repos, (SELECT floor(avg(score) + 0.5)::BIGINT FROM scores) AS avg_score, (SELECT sum(critical)::BIGINT FROM scores) AS critical, (SELECT sum({_HOURS}) FROM findings) AS hours")
def portfolio(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    return _long(M.portfolio(M.repo_scores(f), f), "avg_score", "critical")


@query(
    f"""{_SCORES}, v AS (SELECT repo_id, CASE WHEN critical > 0 THEN 'poor' WHEN findings = 0 THEN 'clean' WHEN score >= 75 AND warning = 0 THEN 'strong' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS verdict FROM scores) SELECT verdict, count(*) AS repos FROM v GROUP BY 1"""
)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("verdict", S.verdict(*(F.col(c) for c in ("score", "critical", "warning", "findings")))).groupBy("verdict").agg(F.count("*").alias("repos"))


@query(
    f"""{_U} SELECT count(DISTINCT visitor) FILTER (visitor <> 'anonymous') AS visitors, count(*) FILTER (visitor = 'anonymous') AS anonymous_events, count(*) FILTER (event = 'view' AND NOT ok) AS failed_scans,
    coalesce(sum(amount) FILTER (event = 'purchase'), 0)::BIGINT AS commits_scanned, count(*) AS events, false AS truncated FROM usage"""
)
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    as_scans = F.when(F.col("event") == "view", "scan").when(F.col("event") == "purchase", "commit-scan").otherwise(F.col("event"))
    return U.totals(V.usage_events(spark, d).withColumn("event", as_scans))


@query(f"{_U} SELECT event, count(*) AS events, sum(amount)::BIGINT AS amount, count(DISTINCT visitor) FILTER (visitor <> 'anonymous') AS visitors FROM usage GROUP BY 1")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return U.by_event(V.usage_events(spark, d))


@query(f"{_U} SELECT host, repo, count(*) AS scans, count(DISTINCT visitor) FILTER (visitor <> 'anonymous') AS visitors FROM usage WHERE event = 'view' AND repo <> '' GROUP BY 1, 2 ORDER BY scans DESC, repo, host LIMIT 20")
def usage_top(spark: SparkSession, d: str) -> DataFrame:
    return U.top_repos(V.usage_events(spark, d), event="view")


@query(f"{_U} SELECT event_ts::DATE AS day, count(*) AS scans, count(DISTINCT visitor) FILTER (visitor <> 'anonymous') AS visitors FROM usage WHERE event = 'view' GROUP BY 1")
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return U.daily(V.usage_events(spark, d), "view")


@query(
    f"""{_U}, n AS (SELECT event_ts::DATE AS day, count(*) AS n FROM usage GROUP BY 1), e AS (SELECT DATE '2024-02-03' AS e), d AS (SELECT unnest(generate_series(e - INTERVAL 370 DAY, e::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM e),
    x AS (SELECT d.day, coalesce(n, 0) AS n, (SELECT greatest(1, max(n)) FROM n) AS most FROM d LEFT JOIN n USING (day))
    SELECT day, n, (CASE WHEN n <= 0 THEN 0 WHEN n / most < 0.25 THEN 1 WHEN n / most < 0.5 THEN 2 WHEN n / most < 0.75 THEN 3 ELSE 4 END)::BIGINT AS level FROM x"""
)
def activity_heatmap(spark: SparkSession, d: str) -> DataFrame:
    daily = V.usage_events(spark, d).groupBy(F.to_date("event_ts").alias("day")).agg(F.count("*").alias("commits"))
    return _long(TL.heatmap(daily, "2024-01-31"), "level")


@query(f"{_U}, s AS (SELECT event_id, user_id, epoch_us(event_ts) // 1000000 AS t FROM usage) SELECT event_id, user_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS limited FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)")
def rate_limit_hits(spark: SparkSession, d: str) -> DataFrame:
    e = V.usage_events(spark, d).withColumn("client", F.col("user_id"))
    return TL.rate_limited(e, most=3, seconds=86400).select("event_id", "user_id", "in_window", "limited")


@query(f"{_L} SELECT coalesce(lang, 'txt') AS language, count(DISTINCT doc_id) AS files, count(*) FILTER (trim(text) <> '') AS loc FROM lines GROUP BY 1")
def loc_by_language(spark: SparkSession, d: str) -> DataFrame:
    ln = V.lines(spark, d)
    return M.lines_of_code(ln.withColumn("language", F.coalesce("lang", F.lit("txt"))), "language")


@query(
    f"""{_L}, p AS (SELECT repo_id, coalesce(lang, 'txt') AS language, count(DISTINCT doc_id) AS files, count(*) FILTER (trim(text) <> '') AS loc FROM lines GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY loc DESC, language) AS n, sum(loc) OVER (PARTITION BY repo_id) AS total FROM p)
    SELECT repo_id, CASE WHEN n <= 2 THEN language ELSE 'Other' END AS language, sum(files)::BIGINT AS files, sum(loc)::BIGINT AS loc, floor(sum(loc) / any_value(total) * 100 * 10000 + 0.5) / 10000 AS share FROM r GROUP BY repo_id, CASE WHEN n <= 2 THEN language ELSE 'Other' END"""
)
def language_shares(spark: SparkSession, d: str) -> DataFrame:
    ln = V.lines(spark, d)
    profile = M.lines_of_code(ln.withColumn("language", F.coalesce("lang", F.lit("txt"))), "repo_id", "language")
    return _rounded(M.language_shares(profile, 2), "share")


@query(
    f"""{_L}, w AS (SELECT path, line, text || chr(10) || lead(text) OVER (PARTITION BY path ORDER BY line) AS block FROM lines WHERE trim(text) <> ''), g AS (SELECT block, count(*) AS copies, count(DISTINCT path) AS files FROM w WHERE block IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    SELECT md5(block) AS block, copies, files FROM g"""
)
def line_clones(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    ln = V.lines(spark, d).filter(F.trim("text") != "")
    block = F.concat("text", F.lit("\n"), F.lead("text").over(Window.partitionBy("path").orderBy("line")))
    return ln.select("path", block.alias("b")).filter("b is not null").groupBy("b").agg(F.count("*").alias("copies"), F.countDistinct("path").alias("files")).filter("copies > 1").select(F.md5("b").alias("block"), "copies", "files")


@query(f"WITH l AS ({V.LINKS}), r AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS n FROM l) SELECT link, page_id, pos FROM r WHERE n = 1")
def first_mention(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scanners.docs import first_mentions

    return _long(first_mentions(V.links(spark, d), ["link"], "page_id", "pos").select("link", "page_id", "pos"), "pos")


@query("""SELECT count(*) AS pages, count(*) FILTER (NOT regexp_matches(lower(coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), ''), 'none')), '(^|\\.)(example\\.(com|org|net)|test|invalid|local|internal|localhost)$|^[^.]*$')) AS public FROM pages""")
def host_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").agg(F.count("*").alias("pages"), F.count_if(~T.private_host(F.col("url"))).alias("public"))


_SECRET = r"""(token|secret|password|api_key|apikey)\s*[:=]\s*"([A-Za-z0-9+/_-]{20,})\""""


@query(
    f"""{_L}, h AS (SELECT path, line, regexp_extract_all(text, '{_SECRET}', 2) AS found FROM lines WHERE regexp_matches(text, '{_SECRET}')), s AS (SELECT path, line, unnest(found) AS secret FROM h)
    SELECT path, line, left(secret, 4) || '****' AS evidence, sha256(secret) AS fingerprint FROM s"""
)
def secrets_redacted(spark: SparkSession, d: str) -> DataFrame:
    hit = V.lines(spark, d).filter(F.col("text").rlike(_SECRET)).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(_SECRET), 2)).alias("secret"))
    return _long(hit.select("path", "line", F.concat(F.substring("secret", 1, 4), F.lit("****")).alias("evidence"), F.sha2("secret", 256).alias("fingerprint")), "line")


@query(
    f"""{_L}, l AS (SELECT repo_id, CASE WHEN text LIKE '%MIT License%' THEN 'MIT' WHEN text LIKE '%Apache License%' THEN 'Apache-2.0' WHEN text LIKE '%GNU General Public License%' THEN 'GPL-3.0' WHEN text LIKE '%CC BY-NC%' THEN 'CC-BY-NC' END AS licence FROM lines)
    SELECT repo_id, licence, CASE licence WHEN 'GPL-3.0' THEN 'strong-copyleft' ELSE 'permissive' END AS class, count(*) AS lines FROM l WHERE licence IS NOT NULL GROUP BY ALL"""
)
def license_mix_by_source(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    name = F.when(t.contains("MIT License"), "MIT").when(t.contains("Apache License"), "Apache-2.0").when(t.contains("GNU General Public License"), "GPL-3.0").when(t.contains("CC BY-NC"), "CC-BY-NC")
    found = V.lines(spark, d).select("repo_id", name.alias("licence")).filter("licence is not null")
    return found.groupBy("repo_id", "licence").agg(F.count("*").alias("lines")).withColumn("class", T.licence_class(F.col("licence")))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 200 AS src, l_suppkey * 7 % 200 AS dst FROM lineitem), r AS (SELECT 0::BIGINT AS name UNION SELECT e.dst FROM r JOIN e ON e.src = r.name) SELECT 1::BIGINT AS repo_id, name FROM r"""
)
def dependency_reach(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    edges = li.select(F.lit(1).cast("long").alias("repo_id"), (F.col("l_partkey") % 200).alias("src"), (F.col("l_suppkey") * 7 % 200).alias("dst")).distinct()
    return FI.reachable(spark.createDataFrame([(1, 0)], "repo_id long, name long"), edges)


@query(
    """WITH w AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS t FROM part), x AS (SELECT id, t, list_filter(regexp_split_to_array(t, '[^a-z0-9_]+'), lambda y: y <> '') AS words FROM w),
    s AS (SELECT id, CASE WHEN contains(t, 'small') THEN 3 WHEN len(list_filter(words, lambda y: starts_with(y, 'small') OR starts_with('small', y))) > 0 THEN 2 WHEN len(list_filter(words, lambda y: levenshtein(y, 'small') <= 1)) > 0 THEN 1 ELSE 0 END AS a,
      CASE WHEN contains(t, 'gizm') THEN 3 WHEN len(list_filter(words, lambda y: starts_with(y, 'gizm') OR starts_with('gizm', y))) > 0 THEN 2 WHEN len(list_filter(words, lambda y: levenshtein(y, 'gizm') <= 1)) > 0 THEN 1 ELSE 0 END AS b FROM x)
    SELECT id, (a + b)::BIGINT AS relevance FROM s WHERE a > 0 AND b > 0"""
)
def issue_search(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), *(F.lit("").alias(c) for c in ("detail", "location", "category", "severity", "scanner")))
    return _long(FI.search(p, "Small gizm").select("id", "relevance"), "relevance")


@query(
    """WITH c AS (SELECT c_custkey AS id, c_custkey % 7 AS fp, c_custkey % 19 AS weeks, c_custkey % 9 AS areas FROM customer), p AS (SELECT id, least(fp, 4) * 4.0::DOUBLE + least(weeks, 12) * 1.0::DOUBLE + least(areas, 6) * 1.5::DOUBLE AS points FROM c)
    SELECT id, points, (CASE WHEN points >= 31 THEN 5 WHEN points >= 23 THEN 4 WHEN points >= 15 THEN 3 WHEN points >= 8 THEN 2 WHEN points >= 3 THEN 1 ELSE 0 END)::BIGINT AS tier FROM p"""
)
def contributor_tiers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *((F.col("c_custkey") % k).alias(n) for n, k in (("confirmed_false_positives", 7), ("clean_streak_weeks", 19), ("areas_touched", 9))))
    return _long(U.contributor_points(c).select("id", "points", "tier"), "tier")


@query(
    """WITH r AS (SELECT n_name AS owner, c_mktsegment AS language, c_custkey AS name, floor(c_acctbal)::BIGINT AS stars FROM customer JOIN nation ON n_nationkey = c_nationkey),
    l AS (SELECT owner, language, count(*) AS n, max(stars) AS s FROM r GROUP BY 1, 2), f AS (SELECT owner, language, row_number() OVER (PARTITION BY owner ORDER BY n DESC, s DESC, language DESC) AS k FROM l),
    t AS (SELECT owner, count(*) AS repos, sum(stars)::BIGINT AS stars FROM r GROUP BY 1), b AS (SELECT owner, name AS best, row_number() OVER (PARTITION BY owner ORDER BY stars DESC, name DESC) AS k FROM r)
    SELECT t.owner, repos, stars, best, language FROM t JOIN f ON f.owner = t.owner AND f.k = 1 JOIN b ON b.owner = t.owner AND b.k = 1"""
)
def owner_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return U.owner_summary(c.select(F.col("n_name").alias("owner"), F.col("c_mktsegment").alias("language"), F.col("c_custkey").alias("name"), F.floor("c_acctbal").alias("stars")))


@query(
    f"""{_F}, m AS (SELECT category AS repo_id, category, id, ord FROM findings WHERE category IN ('security', 'todo') AND id NOT LIKE '%-1'), c AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord, id) AS n FROM m)
    SELECT repo_id, id, ((row_number() OVER (PARTITION BY repo_id, category ORDER BY ord, id) - 1) // 5)::BIGINT AS batch FROM c WHERE n <= 40"""
)
def verdict_batches(spark: SparkSession, d: str) -> DataFrame:
    f = _as_repo(spark, d, "category")
    return _long(FI.verdict_batches(f, f.filter(F.col("id").endswith("-1")).select("id"), ["security", "todo"]).select("repo_id", "id", "batch"), "batch")


def _documents(spark: SparkSession, d: str):
    """The documents as files of one repository for each source."""
    from ..operators.scanners import Snapshot

    t = table(spark, d, "documents")
    return Snapshot(files=t.select(F.col("source").alias("repo_id"), F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("doc_id").alias("file_ord"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content")))


@query("SELECT DISTINCT source AS repo_id, id, severity FROM documents, (VALUES ('hygiene-no-readme', 'warning'), ('hygiene-no-license', 'info'), ('hygiene-no-tests', 'warning'), ('hygiene-no-ci', 'info')) v(id, severity)")
def rule_project_hygiene(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scanners import RULES

    return RULES["project-hygiene"](_documents(spark, d)).select("repo_id", "id", "severity")


@query("""SELECT source AS repo_id, 'bloat-big/' || doc_id::VARCHAR || '.zip' AS id, 'warning' AS severity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY strlen(text) DESC, doc_id::VARCHAR || '.zip') AS n FROM documents) WHERE n <= 30""")
def rule_repo_bloat(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scanners import RULES, Snapshot

    s = _documents(spark, d)
    return RULES["repo-bloat"](Snapshot(files=s.files.withColumn("path", F.concat(F.lit("big/"), F.col("file_ord").cast("string"), F.lit(".zip"))))).select("repo_id", "id", "severity")


@query()
def rule_secrets(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scanners import RULES

    return RULES["secrets"](_documents(spark, d))


@query()
def rule_duplicate_code(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scanners import RULES

    return RULES["duplicate-code"](_documents(spark, d))


from . import people, repos, rules, streams  # noqa: E402

for _more in (people, repos, rules, streams):
    QUERIES.update(_more.QUERIES)
    SQL.update(_more.SQL)
