"""Queries of hosts' answers, schedules and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import timeline as TL
from ..session import dealt, table
from ..sources import host
from .named import register

QUERIES, SQL, _query = register()


@_query(
    """SELECT p_partkey AS id, 'o' || (p_partkey % 9) AS owner, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'dev' ELSE 'main' END AS default_branch, CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE p_size::DOUBLE END AS stars,
    CASE WHEN p_partkey % 3 = 1 THEN 'MIT' END AS license, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS language, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE least(p_partkey % 12, 8) END::INT AS topics,
    CASE WHEN p_partkey % 10 = 3 THEN 'http://h/' || p_partkey ELSE 'https://github.com/x/' || p_name END AS html_url, p_partkey % 8 = 1 AS archived FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"""
)
def host_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Answers written from parts: some are errors or no JSON, counts are texts, licences unknown, topics no list."""
    p, k = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type"), "p_partkey"), F.col("p_partkey")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    topics = F.when(k % 6 == 0, F.lit('"none"')).otherwise(F.concat(F.lit("[1"), F.repeat(F.lit(', "t"'), (k % 12).cast("int")), F.lit(", null]")))
    fields = {
        "full_name": F.when(k % 7 == 0, F.lit("null")).otherwise(q(F.concat(F.lit("x/"), F.col("p_name")))), "owner": F.concat(F.lit('{"login": '), q(F.concat(F.lit("o"), (k % 9).cast("string"))), F.lit("}")), "name": q(F.col("p_name")),
        "default_branch": F.when(k % 4 == 0, F.lit('"dev"')).otherwise(F.lit('""')), "stargazers_count": F.when(k % 5 == 0, q(F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")),
        "license": F.when(k % 3 == 0, F.lit('{"spdx_id": "NOASSERTION"}')).when(k % 3 == 1, F.lit('{"spdx_id": "MIT"}')).otherwise(F.lit("null")), "language": F.when(k % 2 == 0, q(F.col("p_type"))).otherwise(F.lit("7")), "topics": topics,
        "html_url": F.when(k % 10 == 3, q(F.concat(F.lit("http://h/"), k.cast("string")))).otherwise(F.lit("null")), "archived": F.when(k % 8 == 1, F.lit("true")).otherwise(F.lit('"true"')),
    }
    body = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": '), v) for n, v in fields.items())), F.when(k % 11 == 0, F.lit("")).otherwise(F.lit("}")))
    out = host.repositories(p.select(k.alias("id"), body.alias("payload")))
    return out.select("id", "owner", "name", "default_branch", "stars", "license", "language", F.size("topics").alias("topics"), "html_url", "archived")


@_query(
    """WITH o AS (SELECT o_custkey AS id, o_orderkey, floor(o_totalprice)::BIGINT AS stars, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS language, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders), i AS (SELECT * FROM o WHERE n <= 10),
    l AS (SELECT id, language, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(n)) AS r FROM i WHERE language IS NOT NULL GROUP BY id, language)
    SELECT i.id, any_value(l.language) AS top_language, sum(stars)::BIGINT AS stars_received, (SELECT count(*) FROM o WHERE o.id = i.id) > count(*) AS stars_approximate, 'r' || min_by(o_orderkey, n) AS best_known FROM i LEFT JOIN l ON l.id = i.id AND r = 1 GROUP BY i.id"""
)
def host_repository_stats(spark: SparkSession, d: str) -> DataFrame:
    """Searches written from orders: a customer's ten dearest orders as repositories, priorities as languages."""
    o = table(spark, d, "orders")
    item = F.struct(F.floor("o_totalprice").alias("stargazers_count"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("language"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"))
    each = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey", item.alias("item"))))
    per = o.groupBy(F.col("o_custkey").alias("id")).agg(F.slice(F.transform(each, lambda x: x["item"]), 1, 10).alias("items"), F.count("*").alias("total_count"))
    return host.repository_stats(per.select("id", F.to_json(F.struct("items", "total_count")).alias("payload")))


_AS_OF = "1998-08-01 07:00:00"


@_query(
    f"""WITH r AS (SELECT c_nationkey AS owner, c_custkey AS id, CASE WHEN c_custkey % 6 <> 0 THEN 'u' || c_custkey END AS url, max(o_orderdate)::TIMESTAMP + to_hours((c_custkey % 24)::INT) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey),
    s AS (SELECT n_nationkey AS owner, n_nationkey % 5 <> 0 AS active, n_nationkey % 2 = 0 AS daily, CASE WHEN n_nationkey % 3 = 0 THEN 24.0 ELSE n_nationkey * 100.0 END AS hours, CASE WHEN n_nationkey % 4 = 0 THEN TIMESTAMP '1998-08-01 03:00:00' ELSE TIMESTAMP '1998-08-01 06:30:00' END AS target FROM nation WHERE n_nationkey <> 1),
    due AS (SELECT r.*, coalesce(last, TIMESTAMP '1970-01-01') AS seen FROM r JOIN s USING (owner) WHERE active AND url IS NOT NULL AND CASE WHEN daily THEN coalesce(last, TIMESTAMP '1970-01-01') < target ELSE epoch(TIMESTAMP '{_AS_OF}') - epoch(coalesce(last, TIMESTAMP '1970-01-01')) >= hours * 3600 END)
    SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY seen, url) AS place FROM due"""
)
def due_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Customers as repositories of their nation, scanned at their last order, that are due by the nation's schedule."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("timestamp").alias("last"))
    c = table(spark, d, "customer").join(last, "c_custkey", "left")
    at = F.col("last") + F.make_interval(hours=(F.col("c_custkey") % 24).cast("int"))
    repos = c.select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 != 0, F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).alias("url"), at.alias("scanned_ts"))
    n, k = table(spark, d, "nation").filter("n_nationkey <> 1"), F.col("n_nationkey")
    settings = n.select(
        k.alias("owner"), (k % 5 != 0).alias("enabled"), F.when(k % 2 == 0, "daily").otherwise("interval").alias("mode"), F.when(k % 3 != 0, (k * 100).cast("double")).alias("interval_hours"), F.when(k % 4 == 0, "3 am").otherwise("06:30").alias("daily_time")
    )
    return TL.due_repos(repos, settings, _AS_OF).select("owner", "id", F.col("place").cast("long").alias("place"))


@_query(
    """WITH j AS (SELECT o_custkey AS id, string_agg(o_orderkey::VARCHAR, '' ORDER BY o_orderkey::VARCHAR) AS t, min(CASE o_custkey % 4 WHEN 0 THEN 'opt-out' WHEN 1 THEN '  0000000A-0000-0000-0000-' || lpad(o_custkey::VARCHAR, 12, '0') WHEN 2 THEN 'free text' END) AS h FROM orders GROUP BY 1)
    SELECT id, lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(t, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 33 + c) & 4294967295), 36)) AS fingerprint,
    CASE WHEN h = 'opt-out' THEN NULL WHEN regexp_matches(lower(trim(h)), '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') THEN lower(trim(h)) ELSE 'anonymous' END AS visitor FROM j"""
)
def id_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of each customer's orders, and what is recorded of the ids that customers send."""
    k = F.col("id")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))
    sent = F.when(k % 4 == 0, "opt-out").when(k % 4 == 1, F.concat(F.lit("  0000000A-0000-0000-0000-"), F.lpad(k.cast("string"), 12, "0"))).when(k % 4 == 2, "free text")
    return o.select("id", T.fingerprint(F.col("ids")).alias("fingerprint"), T.visitor(sent).alias("visitor"))
