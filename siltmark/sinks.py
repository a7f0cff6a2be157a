"""Reports as rows of text: JSON, Markdown, CSV, SARIF and pull-request comments. Rows are rendered by Spark; whoever writes a file orders and joins them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import scoring as S

FORMATS = {"json": "json", "md": "markdown", "markdown": "markdown", "sarif": "sarif", "csv": "csv", "terminal": "terminal", "text": "terminal"}


def format_of(name: str | None) -> str:
    """The canonical name of a format; anything unknown is the terminal's."""
    return FORMATS.get((name or "").lower(), "terminal")


def order_of(findings: DataFrame) -> list[Column]:
    """What findings are in ascending order of in their repository: worst first, then the oldest, then in order, findings of one id by location."""
    first = [F.col("scanner_ord")] if "scanner_ord" in findings.columns else []
    return [S.severity_rank(F.col("severity")), F.col("age_days").isNull(), F.negative("age_days"), *first, *map(F.col, ("ord", "id", "location", "category", "title"))]


def ordered(findings: DataFrame) -> DataFrame:
    """position of each finding in its repository, in order."""
    return findings.withColumn("position", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order_of(findings))))


def json_reports(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """(repo_id, report): one JSON document per repository with its findings in order."""
    issue = F.struct("position", "id", "category", "severity", "title", "location", F.col("age_days").alias("ageDays"), "detail", "evidence", "scanner")
    listed = ordered(findings).groupBy("repo_id").agg(F.array_sort(F.collect_list(issue)).alias("issues"))
    issues = F.transform(F.coalesce("issues", F.array().cast(listed.schema["issues"].dataType)), lambda i: i.dropFields("position"))
    return scores.join(listed, "repo_id", "left").select("repo_id", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col("repo_id").alias("repo"), "score", "grade", issues.alias("issues"))).alias("report"))


def _cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def markdown_rows(findings: DataFrame) -> DataFrame:
    """(repo_id, position, line): a table row for each finding, pipes and line breaks escaped, evidence as code."""
    evidence = F.when(F.col("evidence").isNotNull(), F.concat(F.lit(" `"), F.regexp_replace(_cell(F.col("evidence")), "`", "'"), F.lit("`"))).otherwise("")
    row = F.concat(F.lit("| "), F.col("severity"), F.lit(" | "), _cell(F.col("title")), evidence, F.lit(" | "), _cell(F.col("location")), F.lit(" | "), F.col("age_days").cast("string"), F.lit(" |"))
    return ordered(findings).select("repo_id", "position", row.alias("line"))


def markdown_sections(findings: DataFrame) -> DataFrame:
    """(repo_id, position, line): a heading for each category with its number of findings, categories by their first finding in order, then the findings."""
    rows = ordered(findings)
    groups = rows.groupBy("repo_id", "category").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    head = groups.select("repo_id", "first", F.lit(0).alias("position"), F.concat(F.lit("## "), F.col("category"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    item = F.concat(F.lit("- **"), F.col("severity"), F.lit("** "), _cell(F.col("title")), F.lit(" ("), _cell(F.col("location")), F.lit(")"))
    body = rows.join(groups.select("repo_id", "category", "first"), ["repo_id", "category"]).select("repo_id", "first", "position", item.alias("line"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("first", "position"))
    return head.unionByName(body).select("repo_id", place.alias("position"), "line")


def _quoted(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


CSV_COLUMNS = ("severity", "category", "title", "location", "age_days", "detail", "evidence", "id")


def csv_rows(findings: DataFrame) -> DataFrame:
    """(repo_id, position, line): RFC 4180 rows with CRLF; position 0 is the header, after a byte order mark."""
    rows = ordered(findings).select("repo_id", "position", F.concat(F.concat_ws(",", *(_quoted(F.col(c)) for c in CSV_COLUMNS)), F.lit("\r\n")).alias("line"))
    head = findings.select("repo_id").distinct().select("repo_id", F.lit(0).alias("position"), F.lit("\ufeff" + ",".join(CSV_COLUMNS) + "\r\n").alias("line"))
    return head.unionByName(rows)


def placed(findings: DataFrame) -> DataFrame:
    """Findings with _path and _line of their location, which are worked out once each however often a text names them."""
    return findings.withColumns({"_path": S.location_path(F.col("location")), "_line": S.location_line(F.col("location"))})


def sarif_result(rule_index: Column) -> Column:
    """A placed finding as the text of a SARIF result; a finding without a file has no location."""
    level = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    path, line = F.col("_path"), F.col("_line")
    place = F.when(path.isNotNull() & (path != "."), F.array(F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), F.when(line.isNotNull(), F.struct(line.alias("startLine"))).alias("region")).alias("physicalLocation"))))
    return F.to_json(F.struct(F.col("category").alias("ruleId"), rule_index.alias("ruleIndex"), level.alias("level"), F.struct(F.concat_ws(": ", "title", "detail").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("id").alias("findingId")).alias("partialFingerprints")))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(repo_id, position, rule_index, result): SARIF results; rules are the categories by first appearance."""
    rows = ordered(findings)
    first = rows.groupBy("repo_id", "category").agg(F.min("position").alias("p"))
    index = first.select("repo_id", "category", (F.row_number().over(Window.partitionBy("repo_id").orderBy("p")) - 1).alias("rule_index"))
    return placed(rows.join(index, ["repo_id", "category"])).select("repo_id", "position", "rule_index", sarif_result(F.col("rule_index")).alias("result"))


def comment_parts(story: DataFrame, findings: DataFrame, top: int = 10) -> DataFrame:
    """(repo_id, headline, new_findings, rows, more): what a pull-request comment shows."""
    rows = ordered(findings)
    line = F.concat(F.lit("| "), F.col("severity"), F.lit(" | "), _cell(F.col("title")), F.lit(" | "), _cell(F.col("location")), F.lit(" |"))
    shown = rows.filter(F.col("position") <= top).groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]), "\n").alias("rows"))
    more = rows.groupBy("repo_id").agg(F.greatest(F.lit(0), F.count("*") - top).alias("more"))
    return story.select("repo_id", "headline", "new_findings").join(shown, "repo_id", "left").join(more, "repo_id", "left").fillna(0, ["more"])


def terminal_rows(findings: DataFrame, color: bool | None = None) -> DataFrame:
    """(repo_id, position, line): plain lines, in colour only on request or on a terminal without NO_COLOR."""
    color = (os.isatty(1) and "NO_COLOR" not in os.environ) if color is None else color
    paint = F.when(F.col("severity") == "critical", "\x1b[31m").when(F.col("severity") == "warning", "\x1b[33m").otherwise("\x1b[36m") if color else F.lit("")
    line = F.concat(paint, F.rpad(F.upper("severity"), 9, " "), F.lit("\x1b[0m" if color else ""), F.col("title"), F.lit("  "), F.col("location"))
    return ordered(findings).select("repo_id", "position", line.alias("line"))


def shared_report(scores: DataFrame, findings: DataFrame, top: int = 10) -> DataFrame:
    """What may be shown to others: scores, counts and the titles of the worst findings, built by an explicit selection; no evidence, detail or path."""
    rows = ordered(findings).filter(F.col("position") <= top)
    listed = rows.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "severity", "category", "title"))), lambda x: F.struct(x["severity"].alias("severity"), x["category"].alias("category"), x["title"].alias("title"))).alias("top"))
    out = scores.join(listed, "repo_id", "left").select(F.sha2(F.col("repo_id").cast("string"), 256).alias("share_id"), "score", "grade", "critical", "warning", "info", "top")
    from .operators.metrics import assert_anonymous

    return assert_anonymous(out, {"evidence", "detail", "location", "path", "owner", "repo_id"})


def failed(scores: DataFrame, fail_on: str) -> DataFrame:
    """Repositories whose grade is no better than a threshold."""
    return scores.filter(S.grade_rank(F.col("grade")) <= S.grade_rank(F.lit(fail_on)))
