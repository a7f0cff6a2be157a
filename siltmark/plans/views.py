"""Domain views over the driver's tables, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import CATEGORIES
from ..operators.findings import SCANNERS
from ..session import table

AS_OF = "2002-01-01"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each order line: the order is the repository."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    path = F.concat(F.lit("src/d"), (F.col("l_partkey") % 50).cast("string"), F.lit("/f"), F.col("l_partkey").cast("string"), F.lit(".ts"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("repo_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        pick(CATEGORIES, F.col("l_partkey") % 7).alias("category"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "critical").when(F.col("l_returnflag").isin("R", "A"), "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("finding in part "), (F.col("l_partkey") % 1000).cast("string")).alias("title"),
        F.concat(path, F.lit(":"), F.col("l_linenumber").cast("string")).alias("location"),
        F.greatest(F.lit(0), F.datediff(F.lit(AS_OF), F.to_date("l_shipdate"))).alias("age_days"),
        F.lit("").alias("detail"),
        pick(SCANNERS, F.col("l_suppkey") % len(SCANNERS)).alias("scanner"),
        F.col("l_linenumber").cast("long").alias("ord"),
    )


_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
FINDINGS = f"""
SELECT l_orderkey AS repo_id, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, ({_list(CATEGORIES)})[(l_partkey % 7 + 1)::INT] AS category,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'critical' WHEN l_returnflag IN ('R', 'A') THEN 'warning' ELSE 'info' END AS severity,
  'finding in part ' || (l_partkey % 1000)::VARCHAR AS title,
  'src/d' || (l_partkey % 50)::VARCHAR || '/f' || l_partkey::VARCHAR || '.ts' AS path,
  greatest(0, date_diff('day', l_shipdate::DATE, DATE '{AS_OF}')) AS age_days, ({_list(SCANNERS)})[(l_suppkey % {len(SCANNERS)} + 1)::INT] AS scanner, l_linenumber AS ord
FROM lineitem"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan for each order: the customer is the repository."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo_id"), F.col("o_orderdate").alias("scan_ts"), F.col("o_orderkey").alias("scan_id"), (F.floor("o_totalprice") % 101).cast("int").alias("score"),
        (F.col("o_orderkey") % 3).cast("int").alias("critical"), (F.col("o_orderkey") % 7).cast("int").alias("warning"), (F.col("o_orderkey") % 11).cast("int").alias("info"),
    )


SCANS = "SELECT o_custkey AS repo_id, o_orderdate AS scan_ts, o_orderkey AS scan_id, (floor(o_totalprice)::BIGINT % 101)::INT AS score, (o_orderkey % 3)::INT AS critical, (o_orderkey % 7)::INT AS warning, (o_orderkey % 11)::INT AS info FROM orders"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit for each order: urgent ones are tagged, and those of a low priority are merges."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderdate").alias("commit_ts"),
        F.when(F.col("o_orderpriority").startswith("5"), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("parents"), F.col("o_orderpriority").startswith("1").alias("tagged"),
    )


COMMITS = "SELECT o_custkey AS repo_id, o_orderkey::VARCHAR AS sha, o_orderdate AS commit_ts, o_orderpriority LIKE '5%' AS merge, o_orderpriority LIKE '1%' AS tagged FROM orders"


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the customer's nation as language and a size by balance."""
    c = table(spark, sf_dir, "customer")
    size = F.when(F.col("c_acctbal") < 0, "xs").when(F.col("c_acctbal") < 3000, "s").when(F.col("c_acctbal") < 6000, "m").when(F.col("c_acctbal") < 9000, "l").otherwise("xl")
    who = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("repo_id"), F.col("n_name").alias("language"), size.alias("size"))
    return scans(spark, sf_dir).join(who, "repo_id").select("repo_id", "scan_id", "scan_ts", "language", "size", "score")


SCAN_STATS = f"""
SELECT s.repo_id, scan_id, scan_ts, n_name AS language, CASE WHEN c_acctbal < 0 THEN 'xs' WHEN c_acctbal < 3000 THEN 's' WHEN c_acctbal < 6000 THEN 'm' WHEN c_acctbal < 9000 THEN 'l' ELSE 'xl' END AS size, score
FROM ({SCANS}) s JOIN customer ON c_custkey = s.repo_id JOIN nation ON n_nationkey = c_nationkey"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage: users whose number ends in 0 are anonymous; the repository is the event's k."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").alias("event_ts"), F.when(F.col("user_id") % 10 == 0, "anonymous").otherwise(F.col("user_id").cast("string")).alias("visitor"), F.col("event_type").alias("event"),
        F.lit("host").alias("host"), F.get_json_object("props", "$.k").alias("repo"), F.floor("value").cast("long").alias("amount"), (F.col("event_id") % 13 != 0).alias("ok"), "event_id", "user_id",
    )


USAGE = """
SELECT ts AS event_ts, CASE WHEN user_id % 10 = 0 THEN 'anonymous' ELSE user_id::VARCHAR END AS visitor, event_type AS event, 'host' AS host,
  json_extract_string(props, '$.k') AS repo, floor(value)::BIGINT AS amount, event_id % 13 <> 0 AS ok, event_id, user_id FROM events"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as source files, numbered from 1."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("txt"))))
    return d.select(F.col("source").alias("repo_id"), path.alias("path"), "doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("n", "text")).withColumn("line", F.col("n") + 1).drop("n")


LINES = """
SELECT source AS repo_id, source || '/' || doc_id::VARCHAR || '.' || coalesce(lang, 'txt') AS path, doc_id, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line
FROM documents WHERE text IS NOT NULL"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of the pages, in order."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "link"))


LINKS = """
SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link, unnest(range(0, len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS pos FROM pages"""
