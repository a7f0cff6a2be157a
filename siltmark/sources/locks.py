"""What lockfiles of the npm world install, and the graphs and marks that say which of it a production install needs."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .yaml import yaml_nodes

#: Groups of dependencies that a production install has.
RUNTIME = ("dependencies", "optionalDependencies")
# Formats: lockfiles of the root, in the order in which they count.
NPM, PNPM, YARN = ("package-lock.json", "npm-shrinkwrap.json"), "pnpm-lock.yaml", "yarn.lock"
_ENTRY = r"^/?((?:@[^/\s@]+/)?[^/\s@]+)[@/](\d+\.\d+\.\d+[^\s:(_]*)"
_BLOCK = r"(?m)^\"?((?:@[^/\s@\"]+/)?[^@\s,\"]+)@[^\n]*:\s*\n\s+version:?\s+\"?(\d+\.\d+\.\d+[^\s\"]*)"


@udtf(returnType="name string, version string, dev boolean, pos int")
class _NpmPackages:
    """Installed packages of an npm lockfile: of its flat map by install path, then of its tree of dependencies, to any depth."""

    def eval(self, content: str) -> Iterator[tuple]:
        try:
            lock = json.loads(content)
        except ValueError:
            return
        if not isinstance(lock, dict):
            return
        pos = 0
        for key, v in _items(lock.get("packages")):
            _, inside, name = ("/" + key).rpartition("/node_modules/")
            if inside and name.count("/") == (1 if name.startswith("@") else 0) and name:
                yield name, _version(v), _dev(v), (pos := pos + 1)
        todo = [iter(_items(lock.get("dependencies")))]
        while todo:
            for name, v in todo[-1]:
                yield name, _version(v), _dev(v), (pos := pos + 1)
                if below := _items(v.get("dependencies") if isinstance(v, dict) else None):
                    todo.append(iter(below))
                    break
            else:
                todo.pop()


def _items(x) -> list[tuple]:
    return list(x.items()) if isinstance(x, dict) else []


def _version(v) -> str | None:
    return v["version"] if isinstance(v, dict) and isinstance(v.get("version"), str) else None


def _dev(v) -> bool:
    return isinstance(v, dict) and v.get("dev") is True


def _root(tree: DataFrame, *names: str) -> DataFrame:
    return tree.filter(F.col("path").isin(*names) & (F.length("content") > 0)).select("repo_id", "path", "content")


def npm_packages(tree: DataFrame) -> DataFrame:
    """(repo_id, path, name, version, dev, pos) of package-lock.json and npm-shrinkwrap.json, each read once; version is null where none is given. A malformed file has no packages."""
    return _root(tree, *NPM).lateralJoin(_NpmPackages(F.col("content").outer())).select("repo_id", "path", "name", "version", "dev", "pos")


def pnpm_nodes(tree: DataFrame) -> DataFrame:
    return yaml_nodes(_root(tree, PNPM))


def _key_name(key: Column) -> Column:
    """The name in a key like @scope/name@1.2.3(peer@4) or, older, /name/1.2.3."""
    plain = F.regexp_replace(F.regexp_replace(key, r"\(.*$", ""), "^/", "")
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"^(.+)@[^@]*$", 1), F.lit("")), F.nullif(F.regexp_extract(plain, r"^((?:@[^/]+/)?[^/]+)/\d", 1), F.lit("")))


def pnpm_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, edges) of pnpm lockfiles: what each importer of the workspace needs at run time, and what each package does. Peer suffixes are no part of a name. A file without importers has no seeds."""
    key = lambda k: F.get("keys", k)
    needs = nodes.filter((F.size("keys") == 4) & key(2).isin(*RUNTIME))
    seeds = needs.filter(key(0) == "importers").select("repo_id", key(3).alias("name")).distinct()
    edges = needs.filter(key(0).isin("snapshots", "packages")).select("repo_id", _key_name(key(1)).alias("src"), key(3).alias("dst")).filter("src is not null").distinct()
    return seeds, edges


def npm_needed(npm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((repo_id, name) not marked as for development only, repositories of which that is known): by the first npm lockfile of each that lists any package."""
    place = F.when(F.col("path") == NPM[0], 0).otherwise(1)
    first = npm.groupBy("repo_id").agg(F.min(place).alias("place"))
    needed = npm.withColumn("place", place).join(first, ["repo_id", "place"], "left_semi").filter(~F.col("dev")).select("repo_id", "name").distinct()
    return needed, first.select("repo_id")


def listed(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, name, version, dev, source, rank, pos) of every package with a version that a lockfile lists; rank and pos give the order in which they count. Only npm knows dev."""
    npm = npm_packages(tree).select("repo_id", "name", "version", "dev", F.lit("npm").alias("source"), F.when(F.col("path") == NPM[0], 0).otherwise(1).alias("rank"), "pos")
    unknown = F.lit(None).cast("boolean").alias("dev")
    flat = nodes.filter((F.size("keys") == 2) & F.get("keys", 0).isin("packages", "snapshots")).select("repo_id", F.get("keys", 1).alias("k"), F.col("line").alias("pos"))
    pnpm = flat.select("repo_id", F.regexp_extract("k", _ENTRY, 1).alias("name"), F.regexp_extract("k", _ENTRY, 2).alias("version"), unknown, F.lit("pnpm").alias("source"), F.lit(2).alias("rank"), "pos")
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(_BLOCK), 1).alias("n"), F.regexp_extract_all("content", F.lit(_BLOCK), 2).alias("v"))
    yarn = _root(tree, YARN).select("repo_id", F.posexplode(pairs).alias("pos", "d")).select("repo_id", F.col("d.n").alias("name"), F.col("d.v").alias("version"), unknown, F.lit("yarn").alias("source"), F.lit(3).alias("rank"), "pos")
    return npm.unionByName(pnpm).unionByName(yarn).filter("name <> '' and version <> ''")


def installed(tree: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(repo_id, name, version, dev) of what lockfiles install, once a name: the version listed first, by the order of package-lock, shrinkwrap, pnpm and yarn; not dev if one place is not."""
    rows = listed(tree, pnpm_nodes(tree) if nodes is None else nodes)
    return rows.groupBy("repo_id", "name").agg(F.min_by("version", F.struct("rank", "pos")).alias("version"), F.bool_and(F.coalesce("dev", F.lit(False))).alias("dev"))


def locked(tree: DataFrame) -> DataFrame:
    """(repo_id) of repositories with any lockfile, readable or not."""
    return _root(tree, *NPM, PNPM, YARN).select("repo_id").distinct()


def declared(tree: DataFrame) -> DataFrame:
    """(repo_id, name, range, fields) of the root's package.json, once a name; of several fields the last of dependencies, devDependencies and optionalDependencies gives the range."""
    parts = None
    fields = ("dependencies", "devDependencies", "optionalDependencies")
    for k, field in enumerate(fields):
        own = F.from_json(F.get_json_object("content", f"$.{field}"), "map<string,string>")
        rows = _root(tree, "package.json").select("repo_id", F.explode(own).alias("name", "range"), F.lit(field).alias("field"), F.lit(k).alias("k"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("repo_id", "name").agg(F.max_by("range", "k").alias("range"), F.collect_set("field").alias("fields"))


def range_floor(range_: Column) -> Column:
    """The lowest full version that a range names, or null."""
    return F.nullif(F.regexp_extract(range_, r"(\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?)", 1), F.lit(""))


def declared_versions(tree: DataFrame) -> DataFrame:
    """(repo_id, name, version, source) of declared dependencies: as npm's lockfiles install them, else pnpm's, else yarn's, else the floor of the range; no row where none of these has one."""
    names = declared(tree)
    rows = listed(tree, pnpm_nodes(tree)).drop("dev")
    floor = names.select("repo_id", "name", range_floor(F.col("range")).alias("version"), F.lit("range").alias("source"), F.lit(4).alias("rank"), F.lit(0).alias("pos")).filter("version is not null")
    found = rows.unionByName(floor).join(names.select("repo_id", "name"), ["repo_id", "name"], "left_semi")
    best = F.row_number().over(Window.partitionBy("repo_id", "name").orderBy("rank", "pos"))
    return found.withColumn("r", best).filter("r = 1").select("repo_id", "name", "version", "source")
