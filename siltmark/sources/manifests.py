"""Dependencies that manifests and lockfiles declare, and graphs of lockfiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .locks import listed, pnpm_nodes

_DEP = "array<struct<name:string,version:string>>"


def _pairs(content: Column, pattern: str) -> Column:
    """(name, version) of all matches of a pattern with two groups."""
    names, versions = F.regexp_extract_all(content, F.lit(pattern), 1), F.regexp_extract_all(content, F.lit(pattern), 2)
    return F.zip_with(names, versions, lambda n, v: F.struct(n.alias("name"), v.alias("version")))


def _map(content: Column, *fields: str) -> Column:
    """(name, version) of string maps in a JSON text."""
    empty = F.create_map().cast("map<string,string>")
    return F.concat(*(F.transform(F.map_entries(F.coalesce(F.from_json(F.get_json_object(content, f"$.{f}"), "map<string,string>"), empty)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"))) for f in fields))


def _section(content: Column, header: str) -> Column:
    """The lines of a TOML section."""
    return F.regexp_extract(content, rf"(?ms)^\[{header}\]\s*$(.*?)(?=^\[|\Z)", 1)


def _packages(content: Column, *fields: str) -> Column:
    """(name, version) of arrays of packages in a JSON text."""
    empty = F.array().cast(_DEP)
    return F.concat(*(F.coalesce(F.from_json(F.get_json_object(content, f"$.{f}"), _DEP), empty) for f in fields))


# Formats: file name, ecosystem, whether it is a lockfile, and what it lists. A lockfile counts before its manifest.
_TOML_LOCK = r"(?ms)^\[\[package\]\]\s*$\s*^name\s*=\s*\"([^\"]+)\"\s*$\s*^version\s*=\s*\"([^\"]+)\""
FORMATS = {
    "poetry.lock": ("PyPI", True, lambda c: _pairs(c, _TOML_LOCK)),
    "Pipfile.lock": ("PyPI", True, lambda c: _pairs(c, r"\"([A-Za-z0-9._-]+)\"\s*:\s*\{[^{}]*\"version\"\s*:\s*\"==([^\"]+)\"")),
    "requirements.txt": ("PyPI", False, lambda c: _pairs(c, r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:==|~=|>=)\s*([0-9][^\s;,#]*)")),
    "pyproject.toml": ("PyPI", False, lambda c: _pairs(c, r"(?m)^\s*\"([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:==|~=|>=)\s*([0-9][^\s;,\"]*)")),
    "go.mod": ("Go", False, lambda c: _pairs(c, r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[^\s]+)\s+v([0-9][^\s]*)")),
    "Cargo.lock": ("crates.io", True, lambda c: _pairs(c, _TOML_LOCK)),
    "Cargo.toml": ("crates.io", False, lambda c: _pairs(_section(c, "dependencies"), r"(?m)^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?\"[\^~=<> ]*([0-9][^\"]*)\"")),
    "Gemfile.lock": ("RubyGems", True, lambda c: _pairs(c, r"(?m)^    ([A-Za-z0-9_.-]+) \(([0-9][^)]*)\)")),
    "Gemfile": ("RubyGems", False, lambda c: _pairs(c, r"(?m)^\s*gem\s+[\"']([^\"']+)[\"']\s*,\s*[\"'][~>=< ]*([0-9][^\"']*)[\"']")),
    "composer.lock": ("Packagist", True, lambda c: _packages(c, "packages", "packages-dev")),
    "composer.json": ("Packagist", False, lambda c: F.filter(_map(c, "require", "require-dev"), lambda d: d["name"].contains("/"))),
}


def manifest_deps(tree: DataFrame, direct: bool = False) -> DataFrame:
    """(repo_id, ecosystem, name, version, manifest, ord): dependencies outside npm at the repository's root.

    Lockfiles first, manifests as fallback: of one ecosystem and name the first source counts; then equal (ecosystem, name, version) are one.
    direct leaves lockfiles out.
    """
    parts = []
    for k, (name, (ecosystem, lock, extract)) in enumerate(FORMATS.items()):
        if direct and lock:
            continue
        # what others need is in go.mod too, with a note
        content = F.regexp_replace("content", r"(?m)^.*// indirect.*$", "") if direct and name == "go.mod" else F.col("content")
        deps = F.posexplode(extract(content)).alias("pos", "d")
        # PyPI does not tell apart upper and lower case
        called = F.lower("d.name") if ecosystem == "PyPI" else F.col("d.name")
        parts.append(tree.filter((F.col("path") == name) & (F.length("content") > 0)).select("repo_id", F.lit(ecosystem).alias("ecosystem"), F.lit(name).alias("manifest"), F.lit(0 if lock else 1).alias("prec"), F.lit(k).alias("k"), deps).select("repo_id", "ecosystem", "manifest", "prec", "k", "pos", called.alias("name"), F.regexp_extract("d.version", r"(\d[\w.+-]*)", 1).alias("version")))
    rows = reduce(DataFrame.unionByName, parts).filter("name <> ''")
    best = Window.partitionBy("repo_id", "ecosystem", "name").orderBy("prec", "k", "pos")
    rows = rows.withColumn("source", F.first("k").over(best)).filter("k = source")
    first = Window.partitionBy("repo_id", "ecosystem", "name", "version").orderBy("pos")
    rows = rows.withColumn("r", F.row_number().over(first)).filter("r = 1")
    return rows.select("repo_id", "ecosystem", "name", "version", "manifest", (F.col("k") * 1_000_000 + F.col("pos")).alias("ord"))


_LOCK = "map<string,struct<version:string,dev:boolean,dependencies:map<string,string>,optionalDependencies:map<string,string>>>"


def npm_installed(tree: DataFrame) -> DataFrame:
    """(repo_id, name, version, dev) of every version of a package that a lockfile installs; dev is true where each place is only for development, else null."""
    rows = listed(tree, pnpm_nodes(tree))
    return rows.groupBy("repo_id", "name", "version").agg(F.bool_and(F.coalesce("dev", F.lit(False))).alias("dev")).withColumn("dev", F.when(F.col("dev"), True))


def npm_graph(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, edges) of a package-lock: what the root depends on at run time, and which package needs which. Repositories without one have no seeds: their run-time set is unknown."""
    lock = tree.filter(F.col("path").isin("package-lock.json", "npm-shrinkwrap.json") & (F.length("content") > 0)).select("repo_id", F.explode(F.from_json(F.get_json_object("content", "$.packages"), _LOCK)).alias("key", "v"))
    empty = F.create_map().cast("map<string,string>")
    needs = F.map_keys(F.map_concat(F.coalesce("v.dependencies", empty), F.map_filter(F.coalesce("v.optionalDependencies", empty), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("v.dependencies", empty)), k))))
    rows = lock.select("repo_id", F.regexp_extract("key", r"node_modules/((?:@[^/]+/)?[^/]+)$", 1).alias("src"), "key", F.explode(needs).alias("dst"))
    return rows.filter("key = ''").select("repo_id", F.col("dst").alias("name")).distinct(), rows.filter("src <> ''").select("repo_id", "src", "dst").distinct()
