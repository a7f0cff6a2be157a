"""Queries of what repositories hold: repeated blocks, lockfiles, workflows, configurations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import documents
from ..functions import scoring as S
from ..operators import config, metrics, search
from ..operators.findings import SYNONYMS
from ..operators.scanners import clones
from ..operators.scanners.deps import runtime_names
from ..session import checkpointed, release, shared_folder, table
from ..sources import locks
from . import views as V
from .named import register

QUERIES, SQL, _query = register()


@_query(
    f"""WITH RECURSIVE l AS (SELECT repo_id, path, doc_id, text, row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS n FROM ({V.LINES}) WHERE trim(text) <> ''),
    w AS (SELECT repo_id, path, doc_id, n, text || chr(10) || lead(text) OVER (PARTITION BY path ORDER BY n) AS key FROM l), g AS (SELECT repo_id, key, count(*) AS places, min((doc_id, path, n)) AS f FROM w WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
    m AS MATERIALIZED (SELECT w.repo_id, w.key, path, n FROM w JOIN g ON g.repo_id = w.repo_id AND g.key = w.key),
    ext AS (SELECT repo_id, key, places, 0 AS more FROM g UNION ALL SELECT e.repo_id, e.key, e.places, e.more + 1 FROM ext e JOIN m ON m.repo_id = e.repo_id AND m.key = e.key JOIN w x ON x.path = m.path AND x.n = m.n + e.more + 1 WHERE x.key IS NOT NULL
      GROUP BY e.repo_id, e.key, e.places, e.more HAVING count(*) = e.places AND min(x.key) = max(x.key)),
    c AS MATERIALIZED (SELECT g.repo_id, f[2] AS path, f[3] AS n, g.places, max(more) AS more FROM g JOIN ext e ON e.repo_id = g.repo_id AND e.key = g.key GROUP BY ALL),
    nxt AS MATERIALIZED (SELECT a.path, a.n, min(b.n) AS nxt FROM c a JOIN c b ON a.path = b.path AND b.n > a.n + a.more GROUP BY 1, 2),
    o AS (SELECT path, min(n) AS n FROM c GROUP BY 1 UNION ALL SELECT o.path, nxt.nxt FROM o JOIN nxt ON nxt.path = o.path AND nxt.n = o.n)
    SELECT repo_id, path, n::BIGINT AS first_line, (more + 2)::BIGINT AS lines, places FROM c JOIN o USING (path, n)"""
)
def clone_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Maximal repeated blocks of two lines or more in the documents of each source."""
    ln = V.lines(spark, d).filter(F.trim("text") != "")
    ln = ln.select("repo_id", "path", F.col("doc_id").alias("file_ord"), "line", "text", (F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1).alias("n"))
    kept, _ = clones.blocks(ln, 2, 0, code=False)
    return kept.select("repo_id", "path", F.col("n").cast("long").alias("first_line"), F.col("lines").cast("long").alias("lines"), "places")


def lock_tree(spark: SparkSession, d: str) -> DataFrame:
    """Lockfiles (repo_id, path, content) written from order lines, one for each customer, of the kind that the customer's number says.

    Package p1 needs p2 where a part and a supplier of the customer's lines have these numbers modulo 20; first lines of orders are declared, those returned (R) for run time.
    """
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("k"), (F.col("l_partkey") % 20).alias("src"), (F.col("l_suppkey") % 20).alias("dst"), (F.col("l_linenumber") == 1).alias("first"), (F.col("l_returnflag") == "R").alias("back")
    )
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    nodes = lines.groupBy("k", "src").agg(F.sort_array(F.collect_set("dst")).alias("needs"), F.bool_or("back").alias("back"), F.bool_or(F.col("first") & F.col("back")).alias("run"), F.bool_or(F.col("first") & ~F.col("back")).alias("dev"))
    each = F.array_sort(F.collect_list(F.struct("src", "needs", "back", "run", "dev")))
    per = nodes.groupBy("k").agg(each.alias("all"))

    def cat(of: str, line, join: str = "", keep=None) -> Column:
        rows = F.col(of) if keep is None else F.filter(of, keep)
        return F.array_join(F.transform(rows, line), join)

    put = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    dep = lambda x: put("      '", name(x["src"]), "':\n        specifier: ^1.0.0\n        version: 1.0.", x["src"].cast("string"), "\n")
    needs = lambda x: F.array_join(F.transform(x["needs"], lambda n: put("      ", name(n), ": 1.0.", n.cast("string"), "\n")), "")
    pnpm = put(
        "lockfileVersion: '9.0'\n\nimporters:\n\n  .:\n    dependencies:\n", cat("all", dep, keep=lambda x: x["run"]), "    devDependencies:\n", cat("all", dep, keep=lambda x: x["dev"]),
        "\nsnapshots:\n\n", cat("all", lambda x: put("  '", name(x["src"]), "@1.0.", x["src"].cast("string"), "(q@1.0.0)':\n    dependencies:\n", needs(x), "\n")),
    )
    flag = lambda x: F.when(x["back"], "").otherwise(', "dev": true')
    flat = put('{"lockfileVersion": 3, "packages": {"": {}, ', cat("all", lambda x: put('"node_modules/', name(x["src"]), '": {"version": "1.0.', x["src"].cast("string"), '"', flag(x), "}"), ", "), "}}")
    below = lambda x: F.array_join(F.transform(x["needs"], lambda n: put('"', name(n), '": {"version": "1.1.', n.cast("string"), '", "dev": true}')), ", ")
    deep = put('{"lockfileVersion": 1, "dependencies": {', cat("all", lambda x: put('"', name(x["src"]), '": {"version": "1.0.', x["src"].cast("string"), '"', flag(x), ', "dependencies": {', below(x), "}}"), ", "), "}}")
    yarn = cat("all", lambda x: put('"', name(x["src"]), "@^1.0.0, ", name(x["src"]), '@~1.0.0":\n  version "1.0.', x["src"].cast("string"), '"\n  resolved "x"\n\n'))
    kind = F.col("k") % 4
    path = F.when(kind == 0, "pnpm-lock.yaml").when(kind == 1, "package-lock.json").when(kind == 2, "yarn.lock").otherwise("npm-shrinkwrap.json")
    return per.select(F.col("k").alias("repo_id"), path.alias("path"), F.when(kind == 0, pnpm).when(kind == 1, flat).when(kind == 2, yarn).otherwise(deep).alias("content"))


_LOCKS = """x AS (SELECT o_custkey AS k, l_partkey % 20 AS src, l_suppkey % 20 AS dst, l_linenumber = 1 AS first, l_returnflag = 'R' AS back FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    own AS (SELECT k, src, bool_or(back) AS back, bool_or(first AND back) AS run FROM x GROUP BY 1, 2), edge AS (SELECT DISTINCT k, src, dst FROM x),
    seen AS (SELECT k, src AS n FROM own WHERE run AND k % 4 = 0 UNION SELECT s.k, e.dst FROM seen s JOIN edge e ON e.k = s.k AND e.src = s.n),
    known AS (SELECT k, src AS n, src, -1 AS dst, '1.0.' || src AS version, NOT back AS dev FROM own UNION ALL SELECT k, dst, src, dst, '1.1.' || dst, true FROM edge WHERE k % 4 = 3),
    one AS (SELECT k, n, min_by(version, (src, dst)) AS version, bool_and(dev) AS dev FROM known GROUP BY 1, 2)"""


@_query(
    f"""WITH RECURSIVE {_LOCKS} SELECT one.k AS repo_id, 'p' || one.n AS name, one.version,
    CASE WHEN one.k % 4 IN (1, 3) THEN NOT dev WHEN one.k % 4 = 0 AND EXISTS (SELECT 1 FROM own WHERE own.k = one.k AND run) THEN EXISTS (SELECT 1 FROM seen WHERE seen.k = one.k AND seen.n = one.n) END AS runtime FROM one"""
)
def lock_runtime(spark: SparkSession, d: str) -> DataFrame:
    """Packages that lockfiles of four forms install, and whether a production install has them (null: unknown)."""
    # five readers of the texts: they are made once, not joined and gathered from order lines by each
    tree = checkpointed(lock_tree(spark, d))
    nodes = checkpointed(locks.pnpm_nodes(tree))
    needed, known = runtime_names(tree, nodes)
    rows = locks.installed(tree, nodes).join(known.withColumn("known", F.lit(True)), "repo_id", "left").join(needed.withColumn("needed", F.lit(True)), ["repo_id", "name"], "left")
    return rows.select("repo_id", "name", "version", F.when(F.col("known"), F.coalesce("needed", F.lit(False))).alias("runtime"))


@_query(
    f"""WITH RECURSIVE {_LOCKS}, want AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 25 AS n, o_orderkey % 25 % 3 AS r FROM orders WHERE o_custkey % 5 <> 0)
    SELECT want.k AS repo_id, 'p' || want.n AS name, CASE WHEN one.version IS NOT NULL THEN one.version ELSE '2.' || r || '.0' END AS version,
    CASE WHEN one.version IS NULL THEN 'range' WHEN want.k % 4 = 0 THEN 'pnpm' WHEN want.k % 4 = 2 THEN 'yarn' ELSE 'npm' END AS source FROM want LEFT JOIN one ON one.k = want.k AND one.n = want.n WHERE one.version IS NOT NULL OR r > 0"""
)
def declared_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of what each customer's package.json declares, by lockfile or else by the floor of the range. Orders modulo 25 are declared; a third of the ranges has no floor."""
    o = table(spark, d, "orders").filter("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("repo_id"), (F.col("o_orderkey") % 25).alias("n")).distinct()
    range_ = F.when(F.col("n") % 3 == 0, "latest").otherwise(F.concat(F.lit("^2."), (F.col("n") % 3).cast("string"), F.lit(".0")))
    deps = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("n").cast("string")), range_)))
    pkg = o.groupBy("repo_id").agg(F.to_json(F.struct(deps.alias("dependencies"))).alias("content")).select("repo_id", F.lit("package.json").alias("path"), "content")
    return locks.declared_versions(checkpointed(lock_tree(spark, d)).unionByName(pkg))


_WEIGHT = {"critical": "10.0::DOUBLE", "warning": "3.0::DOUBLE", "info": "CASE WHEN repo_id % 2 = 0 THEN (repo_id % 3)::DOUBLE ELSE 0.25::DOUBLE END"}
_LOST = " + ".join(f"(CASE WHEN {s} <= {S.FULL[s]} THEN {s} * ({w}) ELSE ({w}) * ({S.FULL[s]} + power(greatest({s} - {S.FULL[s]}, 0)::DOUBLE, {S.TAIL[s]}::DOUBLE)) END)" for s, w in _WEIGHT.items())


@_query(
    f"""WITH findings AS ({V.FINDINGS}), kept AS (SELECT f.* FROM findings f JOIN orders ON o_orderkey = f.repo_id
      WHERE NOT (repo_id % 2 = 0 AND (path LIKE 'src/d' || (o_custkey % 50)::VARCHAR || '/%' OR (category = 'todo' AND regexp_matches(path, '^src/[^/]*/f1[^/]*$')) OR id = o_orderkey::VARCHAR || '-2'))),
    c AS (SELECT repo_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM kept GROUP BY 1)
    SELECT repo_id, critical, warning, info, greatest(0, floor(100 - ({_LOST}) + 0.5))::INT AS score FROM c"""
)
def configured_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores by each repository's own configuration: every second order has one that mutes a folder, a category in some files and a finding, and weighs info anew."""
    o = table(spark, d, "orders").filter("o_orderkey % 2 = 0")
    rule = lambda **x: F.to_json(F.struct(*(v.alias(k) for k, v in x.items())))
    mutes = F.concat_ws(
        ", ", rule(path=F.concat(F.lit("src/d"), (F.col("o_custkey") % 50).cast("string"), F.lit("/**"))), rule(category=F.lit("todo"), path=F.lit("src/*/f1*")), rule(id=F.concat(F.col("o_orderkey").cast("string"), F.lit("-2")))
    )
    text = F.concat(F.lit('{"mute": ['), mutes, F.lit('], "weights": {"info": '), (F.col("o_orderkey") % 3).cast("string"), F.lit("}}"))
    files = o.select(F.col("o_orderkey").alias("repo_id"), F.lit(config.CONFIG_FILE).alias("path"), text.alias("content"))
    configs = checkpointed(config.read_configs(files))
    left = config.unmuted(V.findings(spark, d), configs)
    return config.configured_scores(left, configs).select("repo_id", "critical", "warning", "info", "score")


_SYNONYMS = ", ".join(f"('{c}', '{w}')" for c, words in SYNONYMS.items() for w in words.split())


@_query(
    f"""WITH t AS (SELECT p_partkey AS id, ['security', 'todo', 'hygiene', ''][(p_partkey % 4 + 1)::INT] AS category, lower(p_name || ' ' || p_type || '   ' || category) AS text FROM part), f AS (SELECT id, category, text, list_filter(regexp_split_to_array(text, '[^a-z0-9_]+'), lambda y: y <> '') AS words FROM t),
    q AS (SELECT DISTINCT substr(p_type, 1, 4) || ' ' || substr(p_name, 1 + (p_partkey % 3)::INT, 5) || CASE WHEN p_partkey % 5 = 0 THEN ' secret' ELSE '' END AS query FROM part),
    terms AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest(list_filter(regexp_split_to_array(lower(trim(query)), '[^a-z0-9_]+'), lambda y: y <> '')) AS term FROM q) GROUP BY 1, 2),
    syn(category, word) AS (VALUES {_SYNONYMS}), cats AS (SELECT DISTINCT term, category FROM terms JOIN syn ON starts_with(word, term) OR starts_with(term, word)),
    words AS (SELECT DISTINCT unnest(words) AS word FROM f),
    best AS (SELECT term, word, max(CASE WHEN contains(word, term) THEN 3 WHEN starts_with(term, word) THEN 2 WHEN length(term) >= 4 AND levenshtein(word, term) <= 1 THEN 1 ELSE 0 END) AS points FROM (SELECT DISTINCT term FROM terms), words GROUP BY 1, 2),
    hit AS (SELECT term, id, points FROM best JOIN (SELECT id, unnest(words) AS word FROM f) USING (word) WHERE points > 0 UNION ALL SELECT term, id, 2 FROM cats JOIN f USING (category)
      UNION ALL SELECT c.term, f.id, 1 FROM cats c JOIN syn s USING (category) JOIN f ON contains(f.text, s.word)),
    got AS (SELECT term, id, max(points) AS points FROM hit GROUP BY 1, 2)
    SELECT query, id, sum(points * times)::BIGINT AS relevance FROM terms JOIN got USING (term) GROUP BY query, id HAVING count(*) = (SELECT count(*) FROM terms t WHERE t.query = terms.query)"""
)
def issue_search_many(spark: SparkSession, d: str) -> DataFrame:
    """Queries made of parts' types and names, over all parts as findings, by one index."""
    p = table(spark, d, "part")
    category = F.element_at(F.array(*map(F.lit, ("security", "todo", "hygiene", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), category.alias("category"), *(F.lit("").alias(c) for c in ("detail", "location", "severity", "scanner")))
    word = F.substr("p_name", (F.col("p_partkey") % 3 + 1).cast("int"), F.lit(5))
    queries = p.select(F.concat(F.substr("p_type", F.lit(1), F.lit(4)), F.lit(" "), word, F.when(F.col("p_partkey") % 5 == 0, " secret").otherwise("")).alias("query"))
    return search.search_all(search.build(rows, ("id",)), queries).select("query", "id", F.col("relevance").cast("long").alias("relevance"))


_BY_NATION = f"""f AS (SELECT * REPLACE (repo_id % 25 AS repo_id), row_number() OVER (PARTITION BY repo_id % 25 ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, age_days DESC, ord, id) AS position FROM ({V.FINDINGS}))"""


def _by_nation(spark: SparkSession, d: str) -> DataFrame:
    """All findings, of 25 repositories."""
    return V.findings(spark, d).withColumn("repo_id", (F.col("repo_id") % 25)).withColumn("evidence", F.lit(None).cast("string"))


@_query(
    f"""WITH {_BY_NATION}, r AS (SELECT repo_id, category, row_number() OVER (PARTITION BY repo_id ORDER BY min(position)) - 1 AS rule FROM f GROUP BY repo_id, category)
    SELECT f.repo_id::VARCHAR || '.sarif' AS name, position - 1 AS nth, f.category AS rule_id, r.rule AS rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, path AS uri, id AS finding_id FROM f JOIN r ON r.repo_id = f.repo_id AND r.category = f.category"""
)
def report_documents(spark: SparkSession, d: str) -> DataFrame:
    """SARIF documents of 25 repositories, written as packed files, read again line by line as JSON and taken apart into their results."""
    f = _by_nation(spark, d)
    folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    documents.write_documents(documents.sarif_documents(f.select("repo_id").distinct(), f), folder, packed=True)
    release(spark)
    shape = "struct<ruleId:string,ruleIndex:bigint,level:string,partialFingerprints:struct<findingId:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>"
    rules, results = documents.read_sarif(spark, folder, shape)
    return results.join(F.broadcast(rules), "name").select(
        "name", "nth", F.get("rules", F.col("result.ruleIndex").cast("int")).alias("rule_id"), F.col("result.ruleIndex").alias("rule_index"), F.col("result.level").alias("level"),
        F.col("result.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), F.col("result.partialFingerprints.findingId").alias("finding_id"),
    )


@_query(
    f"""WITH {_BY_NATION}, c AS (SELECT repo_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM f GROUP BY 1),
    t AS (SELECT repo_id, string_agg('| ' || severity || ' | finding in part ' || (split_part(split_part(path, '/f', 2), '.', 1)::BIGINT % 1000) || ' | `' || path || ':' || ord || '` |', chr(10) ORDER BY position) AS rows FROM f WHERE position <= 10 GROUP BY 1)
    SELECT repo_id, '<!-- siltmark-report -->' || chr(10) || '### Grade **F** (0 of 100)' || chr(10) || chr(10) || '**' || n || '** findings: ' || critical || ' critical · ' || warning || ' warning · ' || info || ' info' || chr(10) || chr(10)
      || '| Severity | Finding | Location |' || chr(10) || '| --- | --- | --- |' || chr(10) || rows || CASE WHEN n > 10 THEN chr(10) || chr(10) || 'and ' || (n - 10) || ' more' ELSE '' END AS body FROM c JOIN t USING (repo_id)"""
)
def comment_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The whole comment of each of 25 repositories; each has so many findings that its grade is the lowest."""
    f = _by_nation(spark, d)
    return documents.comments(metrics.repo_scores(f), f).select("repo_id", "body")
