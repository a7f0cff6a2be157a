"""The snapshot that rules read, and the shape of what they find."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.lexer import token_files
from ...functions.text import basename, dirname, path_norm
from ...session import checkpointed
from ...sources.yaml import yaml_files

FINDINGS = "repo_id string, id string, category string, severity string, title string, location string, age_days int, detail string, evidence string, scanner string, ord long"
TESTS = r"(?i)(^|/)(__tests__|tests?|specs?|fixtures?)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|_test\.(py|go|rb)$|(^|/)conftest\.py$"
JS = r"\.(ts|tsx|js|jsx|mjs|mts|cts)$"
WORKFLOW = r"(?i)^\.github/workflows/[^/]+\.ya?ml$"
#: Words by which a name or a text is taken for a credential, and verbs by which it is taken for SQL.
CREDENTIALS = ["token", "secret", "passw", "api[-_]?key"]
SQL_VERBS = ["select", "insert", "update", "delete", "drop"]
# Folders that hold samples rather than the project itself.
SAMPLES = "__fixtures__|fixtures|fixture|__tests__|__mocks__|test|tests|e2e|spec|testdata|playground|playgrounds|sandbox|example|examples|template|templates|node_modules"

# How many findings of a repository and of a file a rule reports, how much it looks up, and how much it reads.
LIMITS: dict[str, dict[str, int]] = {
    "leftover-debug": {"findings": 50, "per_file": 8}, "insecure-code": {"findings": 60, "per_file": 6, "bytes": 400_000}, "skipped-tests": {"findings": 60, "per_file": 10}, "commented-code": {"findings": 40, "per_file": 5},
    "dead-code": {"findings": 40}, "outdated-deps": {"lookups": 100}, "license-risk": {"findings": 25, "names": 300, "lookups": 60, "characters": 4000}, "supply-chain": {"findings": 20}, "broken-doc-links": {"findings": 50},
    "dead-links": {"findings": 40, "lookups": 60}, "dockerfile": {"findings": 40}, "docs-drift": {"findings": 25}, "eol-runtime": {"findings": 30}, "bus-factor": {"findings": 30}, "repo-bloat": {"findings": 30}, "config-conflict": {"findings": 25},
    "workflow-security": {"findings": 40}, "ci-health": {"findings": 20}, "duplicate-code": {"findings": 15}, "javascript": {"bytes": 512 * 1024},
}


@dataclass
class Snapshot:
    """Source trees of many repositories and what is known beside them; a frame that is None is an adapter that is absent.

    files: (repo_id, path, file_ord, size, content); blame: (repo_id, path, line, age_days); branches: (repo_id, name, last_commit, behind, age_days);
    ownership: (repo_id, path, authors, age_days); history: (repo_id, commit, commit_ts, path, text); registry: (ecosystem, name, latest, deprecated,
    published, downloads, unpacked_size, license); advisories: (ecosystem, name, version, vuln_id, summary, label, alias, fixed); url_status: (url, status), a null status
    being an address that cannot be reached.

    limits: by rule, other limits than those of LIMITS; None for one of them: none, and None for all of it: none for any rule.
    """

    files: DataFrame
    as_of: str = "2026-08-01"
    repos: DataFrame | None = None
    blame: DataFrame | None = None
    branches: DataFrame | None = None
    ownership: DataFrame | None = None
    history: DataFrame | None = None
    registry: DataFrame | None = None
    advisories: DataFrame | None = None
    url_status: DataFrame | None = None
    options: dict = field(default_factory=dict)
    limits: dict[str, dict[str, int | None]] | None = field(default_factory=dict)

    def most(self, rule: str, what: str = "findings") -> int | None:
        """A limit of a rule; None: there is none."""
        return None if self.limits is None else self.limits.get(rule, {}).get(what, LIMITS.get(rule, {}).get(what))

    def first(self, rows: DataFrame, rule: str, what: str, *order: str) -> DataFrame:
        """As many rows of each repository, in an order, as a rule's limit allows."""
        most = self.most(rule, what)
        if most is None:
            return rows
        nth = F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
        return rows.withColumn("_first", nth).filter(F.col("_first") <= most).drop("_first")

    @cached_property
    def tree(self) -> DataFrame:
        """Files with clean paths, folder and name."""
        path = path_norm(F.col("path"))
        return self.files.select("repo_id", path.alias("path"), dirname(path).alias("dir"), basename(path).alias("base"), "file_ord", "size", "content")

    @cached_property
    def token_files(self) -> DataFrame:
        """(repo_id, path, file_ord, tokens): all JavaScript and TypeScript files with the tokens of each: read once and written to the session's checkpoint folder, whichever rules use them."""
        return checkpointed(token_files(self.matching(JS), self.most("javascript", "bytes")))

    @cached_property
    def tokens(self) -> DataFrame:
        """Those tokens, one a row."""
        return self.token_files.select("repo_id", "path", "file_ord", F.posexplode("tokens").alias("pos", "t")).select("repo_id", "path", "file_ord", "pos", "t.*")

    @cached_property
    def code_files(self) -> DataFrame:
        """(repo_id, path, file_ord, t): those files with their tokens without comments and calls. Places in t are looked up from its lambdas, so t is a column of its own."""
        return self.token_files.select("repo_id", "path", "file_ord", F.filter("tokens", lambda x: ~x["kind"].isin("comment", "call")).alias("t"))

    @cached_property
    def workflow_files(self) -> DataFrame:
        """(repo_id, path, file_ord, nodes): workflows and actions with the YAML nodes of each, read once and written to the session's checkpoint folder."""
        return checkpointed(yaml_files(self.matching(rf"{WORKFLOW}|(?i)(^|/)action\.ya?ml$").select("repo_id", "path", "file_ord", "content")))

    @cached_property
    def workflow_nodes(self) -> DataFrame:
        """Those nodes, one a row."""
        return self.workflow_files.select("repo_id", "path", "file_ord", F.inline("nodes"))

    @cached_property
    def js_lines(self) -> DataFrame:
        """(repo_id, path, file_ord, line, text): lines of those files in tokens with a space between, without comments; what a literal says is replaced by marks.

        Marks in quotes: $ for a template with a part worked out at run time, q for words of SQL, k for the name of a credential, h for a weak hash, 0 for a zero.
        """
        def shown(x: Column) -> Column:
            kind, t, says = x["kind"], x["text"], F.lower(x["text"])
            marks = F.concat(
                F.when((kind == "template") & t.contains("${"), "$").otherwise(""), F.when(says.rlike(rf"\b({'|'.join(SQL_VERBS)})\b"), "q").otherwise(""), F.when(says.rlike("|".join(CREDENTIALS)), "k").otherwise(""),
                F.when(says.rlike(r"^.(md5|sha1).$"), "h").otherwise(""), F.when(says.rlike(r"^.0.$"), "0").otherwise(""),
            )
            quote = F.when(kind == "template", "`").otherwise('"')
            return F.when(kind.isin("string", "template"), F.concat(quote, marks, quote)).when(kind == "regex", "/re/").otherwise(t)

        # a file's tokens in one text, with as many line ends between two of them as lines lie between them: nothing that is shown holds one
        before = lambda x, i: x["line"] - F.coalesce(F.get("t", i - 1)["line"], F.lit(1))
        space = lambda x, i: F.when(before(x, i) > 0, F.repeat(F.lit("\n"), before(x, i))).when(i > 0, " ").otherwise("")
        whole = F.array_join(F.transform("t", lambda x, i: F.concat(space(x, i), shown(x))), "")
        return self.code_files.select("repo_id", "path", "file_ord", F.posexplode(F.split(whole, "\n", -1)).alias("n", "text")).filter("text <> ''").select("repo_id", "path", "file_ord", (F.col("n") + 1).alias("line"), "text")

    def matching(self, pattern: str, contains: str | None = None) -> DataFrame:
        """Files with some content whose path fits, before anything else is done with them."""
        out = self.tree.filter(F.col("path").rlike(pattern) & (F.length("content") > 0))
        return out if contains is None else out.filter(F.col("content").contains(contains))

    def lines(self, files: DataFrame) -> DataFrame:
        """(repo_id, path, file_ord, line, text, ...) of files, lines from 1."""
        rest = [c for c in files.columns if c != "content"]
        return files.select(*rest, F.posexplode(F.split("content", r"\r?\n", -1)).alias("_n", "text")).withColumn("line", F.col("_n") + 1).drop("_n")

    def aged(self, found: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
        """Add age_days of a line by blame, 0 where unknown."""
        if self.blame is None:
            return found.withColumn("age_days", F.lit(0))
        # blame has a row for every line: it is never broadcast
        ages = self.blame.groupBy("repo_id", F.col("path").alias(path), F.col("line").alias(line)).agg(F.max("age_days").alias("age_days")).hint("merge")
        return found.drop("age_days").join(ages, ["repo_id", path, line], "left").withColumn("age_days", F.greatest(F.lit(0), F.coalesce("age_days", F.lit(0))))


def found(df: DataFrame, scanner: str, category: str, *, id: Column, severity: Column | str, title: Column, location: Column, detail: Column | str, evidence: Column | None = None, ord: Column | None = None) -> DataFrame:
    """Rows in the shape of findings."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    age = F.col("age_days") if "age_days" in df.columns else F.lit(0)
    default = F.coalesce(F.col("file_ord"), F.lit(0)) * 10_000_000 + (F.coalesce(F.col("line"), F.lit(0)) if "line" in df.columns else F.lit(0)) * 10 if "file_ord" in df.columns else F.lit(0)
    return df.select(
        F.col("repo_id").cast("string").alias("repo_id"), id.alias("id"), F.lit(category).alias("category"), lit(severity).alias("severity"), title.alias("title"), location.alias("location"),
        age.cast("int").alias("age_days"), lit(detail).alias("detail"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"), F.lit(scanner).alias("scanner"), (default if ord is None else ord).cast("long").alias("ord"),
    )


def at(path: str = "path", line: str = "line") -> Column:
    return F.concat_ws(":", path, F.col(line).cast("string"))


def text(template: str, **values: Column | str) -> Column:
    """A string with columns in its braces."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce((values[p] if p in values and not isinstance(values[p], str) else F.col(values.get(p, p))).cast("string"), F.lit("")) for k, p in enumerate(parts) if k % 2 or p))


def sample_path(path: Column) -> Column:
    return path.rlike(rf"(?i)(^|/)({SAMPLES})/")
