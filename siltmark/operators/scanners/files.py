"""Rules about which files, branches and owners there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..findings import cap
from .base import JS, Snapshot, at, found, sample_path, text

# Thresholds in days and bytes, and file kinds.
STALE_DAYS, ABANDONED_DAYS, YEAR = 90, 180, 365
LARGE, MEDIA_LARGE = 5 * 1024 * 1024, 2 * 1024 * 1024
ARTIFACTS = "zip tar tgz gz bz2 xz 7z rar jar war ear class exe dll so dylib a o obj lib wasm pdb iso dmg deb rpm msi apk appimage bin dat pyc pyo dump sqlite sqlite3 db mdb".split()
MEDIA = "png jpg jpeg gif bmp tiff tif webp ico mp4 mov avi mkv webm wmv flv mp3 wav flac ogg aac psd ai sketch fig xcf".split()
SOURCE = r"\.(ts|tsx|js|jsx|mjs|mts|cts|py|go|rs|java|rb|php|c|cc|cpp|h|hpp|cs|kt|swift|scala)$"
CI = r"(?i)^(\.github/workflows/.+\.ya?ml|\.gitlab-ci\.yml|\.circleci/config\.yml|\.travis\.yml|azure-pipelines\.yml|\.drone\.yml|Jenkinsfile|\.woodpecker\.ya?ml|bitbucket-pipelines\.yml)$"


def plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))


def human_age(days: Column, least_months: int = 0) -> Column:
    months = F.greatest(F.lit(least_months), F.floor(days / 30))
    short = plural(months, "month") if least_months else F.when(days >= 30, plural(months, "month")).otherwise(plural(days, "day"))
    return F.when(days >= 365, plural(F.floor(days / 365), "year")).otherwise(short)


def stale_branches(s: Snapshot) -> DataFrame | None:
    if s.branches is None:
        return None
    b = s.branches
    if s.repos is not None:
        b = b.join(s.repos.select("repo_id", "default_branch"), "repo_id", "left").filter(~F.col("name").eqNullSafe(F.col("default_branch")))
    b = b.filter(F.col("age_days") >= STALE_DAYS)
    severity = F.when(F.col("age_days") >= ABANDONED_DAYS, "warning").otherwise("info")
    age = human_age(F.col("age_days"))
    behind = F.when(F.col("behind") > 0, F.concat(F.lit(", "), plural(F.col("behind"), "commit"), F.lit(" behind"))).otherwise("")
    return found(b, "stale-branch", "branch", id=text("branch-stale-{name}"), severity=severity, title=F.concat(F.col("name"), F.lit(" untouched for "), age), location=text("origin/{name}"), detail=F.concat(F.lit("Last commit "), age, F.lit(" ago"), behind, F.lit(".")))


def project_hygiene(s: Snapshot) -> DataFrame:
    """README, licence, tests and CI: one flag each, then a row for each one missing."""
    root = ~F.col("path").contains("/")
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    tests = r"(?i)(^|/)(__tests__/|test/|tests/|spec/)|\.(test|spec)\.[cm]?[jt]sx?$"
    flags = s.tree.groupBy("repo_id").agg(
        has(root & F.col("path").rlike(r"(?i)^readme(\.(md|rst|txt|adoc))?$")).alias("readme"), has(root & F.col("path").rlike(r"(?i)^licen[sc]e(\.(md|txt))?$")).alias("license"),
        has(F.col("path").rlike(tests)).alias("tests"), has(F.col("path").rlike(CI)).alias("ci"),
    )
    rows = [("readme", "warning", "No README at the repository root"), ("license", "info", "No LICENSE file"), ("tests", "warning", "No test files found"), ("ci", "info", "No CI configuration")]
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(sev).alias("severity"), F.lit(title).alias("title"), F.lit(n).alias("n"), F.col(k).alias("there")) for n, (k, sev, title) in enumerate(rows)))
    missing = flags.select("repo_id", F.inline(each)).filter(~F.col("there"))
    return found(missing, "project-hygiene", "hygiene", id=text("hygiene-no-{kind}"), severity=F.col("severity"), title=F.col("title"), location=F.lit("."), detail=F.col("title"), ord=F.col("n"))


def bus_factor(s: Snapshot) -> DataFrame | None:
    """Source files of one author, untouched for a year; the oldest first."""
    if s.ownership is None:
        return None
    own = s.ownership.withColumn("path", F.regexp_replace("path", r"\\", "/")).filter((F.col("authors") == 1) & (F.col("age_days") >= YEAR) & F.col("path").rlike(SOURCE))
    own = own.join(s.tree.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    out = found(own, "bus-factor", "hygiene", id=text("busfactor-{path}"), severity="info", title=F.concat(F.lit("Single-author file untouched for "), human_age(F.col("age_days"), 1)), location=F.col("path"), detail=text("Only one person has ever changed {path}."), ord=-F.col("age_days"))
    return cap(out, s.most("bus-factor"))


def repo_bloat(s: Snapshot) -> DataFrame:
    """Artifacts of any size, large files, heavy media; the largest first, unknown sizes last."""
    ext = F.lower(F.regexp_extract("base", r"^.+\.([^.]*)$", 1))
    kind = F.when(ext.isin(*ARTIFACTS), "artifact").when(F.col("size") >= LARGE, "large").when((F.col("size") >= MEDIA_LARGE) & ext.isin(*MEDIA), "media")
    big = s.tree.select("repo_id", "path", "base", "size").withColumn("kind", kind).filter("kind is not null")
    mb = F.col("size") / (1024 * 1024)
    human = F.when(F.col("size") >= 1024 * 1024, F.concat(F.format_number(mb, 1), F.lit(" MB"))).when(F.col("size") >= 1024, F.concat(F.floor(F.col("size") / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.col("size").cast("string"), F.lit(" B")))
    what = F.when(F.col("kind") == "artifact", "Binary artifact committed: ").when(F.col("kind") == "large", "Large file committed: ").otherwise("Heavy media asset: ")
    title = F.concat(what, F.col("path"), F.when(F.col("size").isNotNull(), F.concat(F.lit(" ("), human, F.lit(")"))).otherwise(""))
    out = found(big, "repo-bloat", "hygiene", id=text("bloat-{path}"), severity=F.when(F.col("kind") == "media", "info").otherwise("warning"), title=title, location=F.col("path"), detail=text("{path} makes every clone larger."), ord=-F.coalesce(F.col("size"), F.lit(-1)))
    return cap(out, s.most("repo-bloat"))


# Manifests, whether they declare dependencies, and their lockfiles.
LOCKS = (
    ("Python (Pipenv)", "Pipfile", r"\[packages\]", "Pipfile.lock"), ("Python (Poetry)", "pyproject.toml", r"\[tool\.poetry", "poetry.lock"), ("Rust", "Cargo.toml", r"\[dependencies", "Cargo.lock"),
    ("Ruby", "Gemfile", r"(^|\n)\s*gem\s+[\"']", "Gemfile.lock"), ("Go", "go.mod", r"(^|\n)\s*require\b", "go.sum"), ("PHP (Composer)", "composer.json", r"\"require(-dev)?\"\s*:", "composer.lock"),
)
NPM_LOCKS = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock", "npm-shrinkwrap.json")
DEPENDENCY_FIELDS = ("dependencies", "devDependencies", "optionalDependencies")


def package_fields(content: str, *fields: str) -> list[Column]:
    """String maps of a package.json; null where absent, not a map, or the whole is not JSON."""
    return [F.from_json(F.get_json_object(content, f"$.{f}"), "map<string,string>").alias(f) for f in fields]


def entries(of: Column, field: str) -> Column:
    """(name, version, field) of a map's entries."""
    return F.transform(F.map_entries(of), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(field).alias("field")))


def npm_names(s: Snapshot) -> DataFrame:
    """(repo_id, name, version, field, pos) that root package.json files declare."""
    pkg = s.tree.filter((F.col("path") == "package.json") & (F.length("content") > 0)).select("repo_id", *package_fields("content", *DEPENDENCY_FIELDS))
    empty = F.create_map().cast("map<string,string>")
    rows = [entries(F.coalesce(f, empty), f) for f in DEPENDENCY_FIELDS]
    return pkg.select("repo_id", F.posexplode(F.concat(*rows)).alias("pos", "d")).select("repo_id", "pos", "d.*")


def lockfile_drift(s: Snapshot) -> DataFrame:
    names = npm_names(s)
    order = F.array_position(F.array(*map(F.lit, NPM_LOCKS)), F.col("path"))
    locks = s.tree.filter(F.col("path").isin(*NPM_LOCKS)).groupBy("repo_id").agg(F.min_by(F.struct("path", "content"), order).alias("lock")).select("repo_id", "lock.path", "lock.content")
    none = names.select("repo_id").distinct().join(locks, "repo_id", "left_anti")
    missing = found(none, "lockfile-drift", "dependency", id=F.lit("lockfile-missing"), severity="warning", title=F.lit("No lockfile committed"), location=F.lit("package.json"), detail="Installs cannot be reproduced without a lockfile.", ord=F.lit(0))
    absent = names.join(locks, "repo_id").filter((F.length("content") > 0) & ~F.col("content").contains(F.col("name")))
    drift = found(absent, "lockfile-drift", "dependency", id=text("lockfile-drift-{name}"), severity="warning", title=text("{name} is declared but missing from {path}"), location=F.lit("package.json"), detail=text("{path} is older than package.json."), ord=F.col("pos") + 1)
    there = s.tree.filter("dir = ''").groupBy("repo_id").agg(F.collect_set("path").alias("there"))
    manifests = s.tree.filter(F.col("path").isin(*(m for _, m, _, _ in LOCKS)) & (F.length("content") > 0)).join(there, "repo_id")
    spec = F.array(*(F.struct(F.lit(e).alias("ecosystem"), F.lit(m).alias("manifest"), F.col("content").rlike(p).alias("uses"), F.lit(lock).alias("lock"), F.lit(k).alias("k")) for k, (e, m, p, lock) in enumerate(LOCKS)))
    other = manifests.select("repo_id", "path", "there", F.inline(spec)).filter("path = manifest and uses and not array_contains(there, lock)")
    poly = found(other, "lockfile-drift", "dependency", id=text("lockfile-missing-{lock}"), severity="warning", title=text("No {lock} committed ({ecosystem})"), location=F.col("manifest"), detail=text("{manifest} declares dependencies that nothing pins."), ord=F.col("k") + 1_000_000)
    return reduce(DataFrame.unionByName, [missing, drift, poly])


# Files that exclude each other in one folder.
MANAGERS = {"package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "yarn.lock": "Yarn", "pnpm-lock.yaml": "pnpm", "bun.lockb": "Bun", "bun.lock": "Bun"}
PAIRS = {
    "eslint": ([".eslintrc", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.mjs", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml"], [f"eslint.config.{x}" for x in ("js", "mjs", "cjs", "ts", "mts", "cts")]),
    "babel": ([".babelrc", ".babelrc.js", ".babelrc.cjs", ".babelrc.json"], [f"babel.config.{x}" for x in ("js", "cjs", "mjs", "json")]),
}
PACKAGE_KEYS = {"prettier": r"^(\.prettierrc(\.(json|json5|yml|yaml|js|cjs|mjs|toml))?|prettier\.config\.(js|cjs|mjs|ts))$", "jest": r"^jest\.config\.(js|cjs|mjs|ts|mts|cts|json)$"}
OTHER_CI = {".travis.yml": "Travis CI", ".circleci/config.yml": "CircleCI", "appveyor.yml": "AppVeyor", ".appveyor.yml": "AppVeyor", "azure-pipelines.yml": "Azure Pipelines", ".drone.yml": "Drone", ".gitlab-ci.yml": "GitLab CI", "bitbucket-pipelines.yml": "Bitbucket Pipelines", "wercker.yml": "Wercker"}


def config_conflicts(s: Snapshot) -> DataFrame:
    """Configuration files of which one makes the other void, folder by folder. The cap comes before other CI files are judged by age."""
    own = s.tree.filter(~sample_path(F.col("path")))
    wanted = [*MANAGERS, *(n for a, b in PAIRS.values() for n in (*a, *b))]
    dirs = own.filter(F.col("base").isin(*wanted)).groupBy("repo_id", "dir").agg(F.collect_set("base").alias("names"))
    manager = F.create_map(*(F.lit(x) for kv in MANAGERS.items() for x in kv))
    locks = F.filter(F.array(*map(F.lit, MANAGERS)), lambda n: F.array_contains("names", n))
    in_dir = lambda name: F.when(F.col("dir") == "", name).otherwise(F.concat_ws("/", "dir", name))
    rows = []
    many = dirs.withColumn("locks", locks).withColumn("labels", F.array_distinct(F.transform("locks", lambda n: manager[n]))).filter("size(labels) > 1")
    rows.append(many.select("repo_id", "dir", F.lit("lockfiles").alias("kind"), F.lit("warning").alias("severity"), F.concat(F.lit("Competing lockfiles: "), F.array_join("labels", " and ")).alias("title"), in_dir(F.element_at("locks", 1)).alias("path"), F.lit(0).alias("k")))
    for k, (kind, (old, new)) in enumerate(PAIRS.items(), 1):
        first = lambda names: F.element_at(F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains("names", n)), 1)
        both = dirs.filter(F.arrays_overlap("names", F.array(*map(F.lit, old))) & F.arrays_overlap("names", F.array(*map(F.lit, new)))).withColumn("a", first(old)).withColumn("b", first(new))
        title = text("{a} is never read while {b} exists") if kind == "eslint" else text("{a} sits beside {b}")
        rows.append(both.select("repo_id", "dir", F.lit(kind).alias("kind"), F.lit("warning" if kind == "eslint" else "info").alias("severity"), title.alias("title"), in_dir(F.col("a")).alias("path"), F.lit(k).alias("k")))
    keyed = own.filter((F.col("base") == "package.json") & (F.length("content") > 0)).select("repo_id", "dir", "path", F.json_object_keys("content").alias("keys"))
    for k, (key, pattern) in enumerate(PACKAGE_KEYS.items(), 3):
        twice = keyed.filter(F.array_contains("keys", key)).join(own.filter(F.col("base").rlike(pattern)).groupBy("repo_id", "dir").agg(F.min_by("base", "file_ord").alias("b")), ["repo_id", "dir"])
        rows.append(twice.select("repo_id", "dir", F.lit(key).alias("kind"), F.lit("info").alias("severity"), text(f"{key.capitalize()} is configured twice: {{b}} and package.json").alias("title"), "path", F.lit(k).alias("k")))
    strict = s.lines(own.filter((F.col("path") == "tsconfig.json") & (F.length("content") > 0))).filter(~F.col("text").rlike(r"^\s*(//|/\*|\*)") & F.col("text").rlike(r'"strict"\s*:\s*false'))
    strict = strict.groupBy("repo_id", "dir", "path").agg(F.min("line").alias("line"))
    rows.append(strict.select("repo_id", "dir", F.lit("ts-strict").alias("kind"), F.lit("info").alias("severity"), F.lit("TypeScript strict mode is switched off").alias("title"), at().alias("path"), F.lit(5).alias("k")))
    actions = s.tree.groupBy("repo_id").agg(F.bool_or(F.col("path").rlike(r"(?i)^\.github/workflows/[^/]+\.ya?ml$")).alias("actions")).filter("actions")
    ci = s.tree.filter(F.col("path").isin(*OTHER_CI)).join(actions, "repo_id")
    provider = F.create_map(*(F.lit(x) for kv in OTHER_CI.items() for x in kv))[F.col("path")]
    rows.append(ci.select("repo_id", "dir", F.lit("ci").alias("kind"), F.lit("info").alias("severity"), F.concat(provider, F.lit(" configuration beside Actions")).alias("title"), "path", F.lit(6).alias("k")))
    all_ = reduce(DataFrame.unionByName, rows)
    place = F.when(F.col("dir") == "", "root").otherwise(F.col("dir"))
    out = cap(found(all_, "config-conflict", "hygiene", id=F.concat(F.lit("config-conflict-"), F.col("kind"), F.lit("-"), place), severity=F.col("severity"), title=F.col("title"), location=F.col("path"), detail=F.col("title"), ord=F.col("k")), s.most("config-conflict"))
    ages = s.aged(out.withColumn("_p", F.regexp_replace("location", r":\d+$", "")).withColumn("_l", F.lit(1)), "_p", "_l").drop("_p", "_l")
    return ages.filter((F.col("ord") != 6) | (F.col("age_days") >= YEAR)).select(out.columns)


__all__ = ["JS", "bus_factor", "config_conflicts", "lockfile_drift", "project_hygiene", "repo_bloat", "stale_branches"]
