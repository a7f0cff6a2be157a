"""Rules about dependencies: unused, abandoned, outdated, vulnerable, licences, and what their scripts do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.scoring import severity_rank
from ...functions.text import lag_behind, licence_class, licence_of_text, range_kind, version_part
from ...session import checkpointed
from ...sources.locks import installed, locked, npm_needed, npm_packages, pnpm_graph, pnpm_nodes, range_floor
from ...sources.manifests import manifest_deps
from ..findings import cap, reachable
from .base import Snapshot, found, sample_path, text
from .files import entries, npm_names, package_fields

CONFIG = r"(?i)(^|/)(next|postcss|tailwind|vite|vitest|rollup|webpack|babel|jest|eslint|prettier|stylelint|playwright|cypress|tsup|drizzle|svelte|astro|nuxt)\.config\.[cm]?[jt]s$|(^|/)\.(babelrc|eslintrc|prettierrc|stylelintrc)[\w.]*$"
YEAR = 365


def module_specs(s: Snapshot) -> DataFrame:
    """(repo_id, path, spec, form, line) of modules that JavaScript imports, re-exports or requires."""
    back = lambda i, n: F.get("t", i - n)["text"]
    form = lambda i: F.when(back(i, 1) == "from", "from").when(back(i, 1) == "import", "side").when((back(i, 1) == "(") & back(i, 2).isin("require", "import"), "call")
    spec = lambda x: F.substring(x["text"], F.lit(2), F.length(x["text"]) - 2)
    each = F.transform("t", lambda x, i: F.when(x["kind"] == "string", F.struct(spec(x).alias("spec"), form(i).alias("form"), x["line"].alias("line"))))
    return s.code_files.select("repo_id", "path", F.inline(F.filter(each, lambda x: x["form"].isNotNull())))


def dependency_funeral(s: Snapshot) -> DataFrame:
    """npm dependencies that nothing uses, that are deprecated or else abandoned, and that are behind."""
    deps = npm_names(s).filter("field = 'dependencies'")
    spec = F.regexp_replace("spec", "^node:", "")
    used = module_specs(s).filter(~F.col("spec").rlike(r"^[./]")).select("repo_id", F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1).alias("name")).distinct()
    tools = s.tree.filter(F.col("path").rlike(CONFIG)).select("repo_id", "content")
    scripts = s.tree.filter("path = 'package.json'").select("repo_id", *package_fields("content", "scripts")).select("repo_id", F.array_join(F.map_values("scripts"), "\n").alias("content"))
    named = deps.join(tools.unionByName(scripts), "repo_id").filter(F.col("content").contains(F.col("name"))).select("repo_id", "name").distinct()
    unused = deps.filter(~F.col("name").startswith("@types/") & (F.col("name") != "react-dom")).join(used.unionByName(named), ["repo_id", "name"], "left_anti")
    out = found(unused, "dependency-funeral", "dependency", id=text("dep-unused-{name}"), severity="info", title=text("{name} is installed but never imported"), location=F.lit("package.json"), detail=text("Nothing imports {name}."), ord=F.col("pos") * 10)
    if s.registry is None:
        return out
    reg = s.registry.filter("ecosystem = 'npm'").select("name", "latest", F.coalesce("deprecated", F.lit(False)).alias("deprecated"), "published", "downloads", "unpacked_size")
    known = deps.join(reg, "name").withColumn("gap", F.datediff(F.lit(s.as_of), "published"))
    gone = found(known.filter("deprecated"), "dependency-funeral", "dependency", id=text("dep-deprecated-{name}"), severity="warning", title=text("{name} is deprecated"), location=F.lit("package.json"), detail=text("The latest {name} is marked deprecated."), ord=F.col("pos") * 10 + 1)
    wide = F.coalesce(F.col("downloads") >= 1_000_000, F.lit(False))
    old = known.filter(~F.col("deprecated") & (F.col("gap") > 2 * YEAR) & ~(wide & F.coalesce(F.col("unpacked_size") <= 50 * 1024, F.lit(False))))
    years = F.floor(F.col("gap") / YEAR).cast("string")
    left = found(old, "dependency-funeral", "dependency", id=text("dep-abandoned-{name}"), severity=F.when(wide, "info").when(F.col("gap") > 3 * YEAR, "warning").otherwise("info"), title=F.concat(F.col("name"), F.lit(" looks abandoned (no release in "), years, F.lit("+ years)")), location=F.lit("package.json"), detail=text("{name} has had no release for years."), ord=F.col("pos") * 10 + 2)
    three = r"\d+\.\d+\.\d+"
    kind = lag_behind(F.col("version"), F.col("latest"))
    late = known.filter(F.col("version").rlike(three) & F.col("latest").rlike(three)).withColumn("kind", kind).withColumn("range", range_kind(F.col("version"))).filter("kind is not null and range <> 'other' and not (kind = 'minor' and range = 'caret')")
    return out.unionByName(gone).unionByName(left).unionByName(_behind(late, "dependency-funeral", text("dep-outdated-{name}"), F.lit("package.json"), F.col("pos") * 10 + 3))


def _behind(late: DataFrame, scanner: str, id_, location, order) -> DataFrame:
    now = F.concat_ws(".", version_part(F.col("version"), 0).cast("string"), version_part(F.col("version"), 1).cast("string"))
    title = F.concat(F.col("name"), F.lit(" is "), F.col("kind"), F.lit(" versions behind ("), now, F.lit(" → "), F.col("latest"), F.lit(")"))
    return found(late, scanner, "dependency", id=id_, severity=F.when(F.col("kind") == "major", "warning").otherwise("info"), title=title, location=location, detail=text("{name} is at {version}; {latest} is out."), ord=order)


def outdated_deps(s: Snapshot) -> DataFrame | None:
    """Direct dependencies outside npm without a release for two years, or behind."""
    if s.registry is None:
        return None
    deps = manifest_deps(s.tree, direct=True)
    deps = s.first(deps, "outdated-deps", "lookups", "ord")
    reg = s.registry.select("ecosystem", "name", F.regexp_replace("latest", "^v", "").alias("latest"), "published")
    known = deps.join(reg, ["ecosystem", "name"]).withColumn("gap", F.datediff(F.lit(s.as_of), "published")).withColumn("key", F.regexp_replace(F.lower("ecosystem"), r"crates\.io", "crates"))
    years = F.floor(F.col("gap") / YEAR).cast("string")
    left = found(known.filter(F.col("gap") > 2 * YEAR), "outdated-deps", "dependency", id=text("dep-abandoned-{key}-{name}"), severity="warning", title=F.concat(F.col("name"), F.lit(" looks abandoned (no "), F.col("ecosystem"), F.lit(" release in "), years, F.lit("+ years)")), location=F.col("manifest"), detail=text("{name} has had no release for years."), ord=F.col("ord") * 10)
    two = r"\d+\.\d+"
    late = known.filter(F.col("version").rlike(two) & F.col("latest").rlike(two)).withColumn("kind", lag_behind(F.col("version"), F.col("latest"))).filter("kind is not null")
    return left.unionByName(_behind(late, "outdated-deps", text("dep-outdated-{key}-{name}"), F.col("manifest"), F.col("ord") * 10 + 1))


def runtime_names(tree: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((repo_id, name) that a production install has, repositories of which that is known).

    npm's lockfiles mark what is only for development. Else a pnpm lockfile's graph is followed from the run-time dependencies of its importers. yarn.lock says nothing of this, so with it alone,
    or without any lockfile, the answer is unknown.
    """
    needed, marked = npm_needed(npm_packages(tree))
    seeds, edges = pnpm_graph(nodes.join(marked, "repo_id", "left_anti"))
    return needed.unionByName(reachable(seeds, edges)), marked.unionByName(seeds.select("repo_id").distinct())


def vulnerable_deps(s: Snapshot) -> DataFrame | None:
    """Installed packages that an advisory names. The published severity is kept where it is unknown whether a package is used at run time; only a known no lowers it.

    What a repository declares for run time is used there. Of a package that a lockfile lists in several versions the first counts; ranges count only where there is no lockfile.
    """
    if s.advisories is None:
        return None
    direct = npm_names(s).groupBy("repo_id", "name").agg(F.collect_set("field").alias("fields"), F.first("version").alias("declared"))
    nodes = checkpointed(pnpm_nodes(s.tree))
    npm = installed(s.tree, nodes).join(s.tree.filter("path = 'package.json'").select("repo_id"), "repo_id", "left_semi").select("repo_id", F.lit("npm").alias("ecosystem"), "name", "version", F.lit("package.json").alias("manifest"))
    bare = direct.join(locked(s.tree), "repo_id", "left_anti").select("repo_id", F.lit("npm").alias("ecosystem"), "name", range_floor(F.col("declared")).alias("version"), F.lit("package.json").alias("manifest"))
    poly = manifest_deps(s.tree).select("repo_id", "ecosystem", "name", "version", "manifest")
    deps = npm.unionByName(bare).unionByName(poly).filter("version <> ''")
    prod, known = runtime_names(s.tree, nodes)
    prod, known = prod.withColumn("in_prod", F.lit(True)), known.withColumn("known", F.lit(True))
    deps = deps.join(prod, ["repo_id", "name"], "left").join(known, "repo_id", "left").join(direct.select("repo_id", "name", "fields"), ["repo_id", "name"], "left")
    has = lambda field: F.coalesce(F.array_contains("fields", field), F.lit(False))
    npm_run = F.when(has("dependencies"), True).when(F.col("known"), F.coalesce("in_prod", F.lit(False))).when(has("devDependencies"), False)
    deps = deps.withColumn("runtime", F.when(F.col("ecosystem") == "npm", npm_run)).withColumn("direct", F.col("fields").isNotNull() | (F.col("ecosystem") != "npm"))
    hit = deps.join(s.advisories, ["ecosystem", "name", "version"])
    label = F.upper(F.coalesce("label", F.lit("")))
    published = F.when(label == "CRITICAL", "critical").when(label == "HIGH", "critical").when(label.isin("MODERATE", "MEDIUM"), "warning").when(label == "LOW", "info").otherwise("warning")
    lowered = F.when(published == "critical", F.when(F.col("direct"), "warning").otherwise("info")).otherwise("info")
    sev = F.when(F.col("runtime").eqNullSafe(F.lit(False)), lowered).otherwise(published)
    shown = F.coalesce(F.col("alias"), F.col("vuln_id"))
    hit = hit.withColumn("severity", sev).withColumn("shown", shown)
    worst = Window.partitionBy("repo_id", "name", "shown").orderBy(severity_rank(F.col("severity")), "version", "vuln_id")
    hit = hit.withColumn("r", F.row_number().over(worst)).filter("r = 1")
    fix = F.when(F.col("fixed").isNotNull(), F.concat(F.lit(" Fixed in "), F.col("fixed"), F.lit("."))).otherwise("")
    return found(hit, "vulnerable-deps", "security", id=text("vuln-{name}-{shown}"), severity=F.col("severity"), title=text("{name} {version}: {shown}"), location=F.col("manifest"), detail=F.concat(F.coalesce("summary", F.lit("A published advisory names this version.")), fix), evidence=text("{name}@{version}"))


def fixed_version(affected: Column, ecosystem: Column, name: Column) -> Column:
    """The first version that an advisory names as fixed for a package, or null. affected: array<struct<package:struct<ecosystem,name>,ranges:array<struct<events:array<struct<introduced,fixed>>>>>>."""
    own = F.filter(affected, lambda a: (a["package"]["ecosystem"] == ecosystem) & (a["package"]["name"] == name))
    events = F.flatten(F.flatten(F.transform(own, lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    return F.get(F.filter(events, lambda e: F.coalesce(e["fixed"], F.lit("")) != ""), 0)["fixed"]


VERDICTS = {"network": "network copyleft", "strong": "copyleft", "weak": "file-level copyleft", "proprietary": "no open-source license", "unrecognised": "an unknown license", "unknown": "no license at all"}


def declared_licence(json: str) -> Column:
    """The licence that a package.json declares, in any of its three forms."""
    many = F.from_json(F.get_json_object(json, "$.licenses"), "array<struct<type:string>>")
    plain = F.get_json_object(json, "$.license")
    return F.coalesce(F.get_json_object(json, "$.license.type"), F.when(~plain.startswith("{"), plain), F.nullif(F.array_join(F.transform(many, lambda x: x["type"]), " AND "), F.lit("")))


def license_risk(s: Snapshot) -> DataFrame:
    """Dependencies whose licence asks more than the project's own gives."""
    pkg = s.tree.filter("path = 'package.json'").select("repo_id", declared_licence("content").alias("own"))
    file = s.tree.filter(F.col("path").rlike(r"(?i)^licen[sc]e(\.(md|txt))?$")).groupBy("repo_id").agg(F.min_by("content", "file_ord").alias("body")).select("repo_id", licence_of_text(F.col("body"), s.most("license-risk", "characters")).alias("of_file"))
    project = pkg.join(file, "repo_id", "left").select("repo_id", licence_class(F.coalesce("own", "of_file")).alias("project"))
    names = npm_names(s).filter("field in ('dependencies', 'devDependencies')").groupBy("repo_id", "name").agg(F.bool_or(F.col("field") == "dependencies").alias("shipped"), F.min(F.struct(F.col("field") != "dependencies", "pos")).alias("o"))
    names = s.first(names.withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy("o"))), "license-risk", "names", "o")
    copy = s.tree.filter(F.col("path").rlike(r"^node_modules/(@[^/]+/)?[^/]+/package\.json$") & F.json_object_keys("content").isNotNull()).select("repo_id", F.regexp_extract("path", r"^node_modules/(.*)/package\.json$", 1).alias("name"), declared_licence("content").alias("copied"), F.lit(True).alias("there"))
    deps = names.join(copy, ["repo_id", "name"], "left")
    if s.registry is not None:
        deps = deps.join(s.registry.filter("ecosystem = 'npm'").select("name", F.col("license").alias("listed")), "name", "left")
    else:
        deps = deps.withColumn("listed", F.lit(None).cast("string"))
    asked = F.row_number().over(Window.partitionBy("repo_id", F.coalesce("there", F.lit(False))).orderBy("n"))
    deps = deps.withColumn("asked", asked).withColumn("license", F.when(F.col("there"), F.col("copied")).otherwise(F.col("listed"))).filter(F.col("there") | (F.col("listed").isNotNull() & (F.lit(True) if s.most("license-risk", "lookups") is None else F.col("asked") <= s.most("license-risk", "lookups"))))
    deps = deps.join(project, "repo_id").withColumn("class", licence_class(F.col("license")))
    ours = F.col("project").isin("strong-copyleft", "network-copyleft", "weak-copyleft")
    c, shipped = F.col("class"), F.col("shipped")
    kind = F.when(c == "unknown", F.when(F.col("license").isNotNull(), "unrecognised").otherwise("unknown")).when(c == "proprietary", "proprietary").when(ours, None).when((c == "weak-copyleft") & shipped, "weak").when(c == "network-copyleft", "network").when(c == "strong-copyleft", "strong")
    sev = F.when(F.col("kind").isin("unrecognised", "unknown", "weak") | ~shipped, "info").when(F.col("kind") == "network", "critical").otherwise("warning")
    bad = deps.withColumn("kind", kind).filter("kind is not null")
    says = F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv))[F.col("kind")]
    out = found(bad, "license-risk", "dependency", id=text("license-{kind}-{name}"), severity=sev, title=F.concat(F.col("name"), F.lit(": "), says, F.lit(" ("), F.coalesce("license", F.lit("none")), F.lit(")")), location=F.lit("package.json"), detail=text("{name} is {class}; the project is {project}."), evidence=F.concat(F.col("name"), F.lit(": "), F.coalesce("license", F.lit("(no license field)"))), ord=F.col("n"))
    return cap(out, s.most("license-risk"))


LIFECYCLE = ("preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly")
#: What a download writes goes on to a shell.
PIPED = r"(?i)\b(curl|wget)\b[^|;]*\|\s*(sudo\s+)?(ba|z|da)?sh\b"


def supply_chain(s: Snapshot) -> DataFrame:
    """Scripts that fetch and run, and dependencies over plain HTTP."""
    pkg = s.tree.filter((F.lower("base") == "package.json") & ~sample_path(F.col("path")) & (F.length("content") > 0))
    fields = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
    pkg = pkg.select("repo_id", "path", "file_ord", *package_fields("content", "scripts", *fields))
    sc = pkg.select("repo_id", "path", "file_ord", F.explode("scripts").alias("name", "body")).filter("trim(body) <> ''")
    life, piped = F.col("name").isin(*LIFECYCLE), F.col("body").rlike(PIPED)
    kind = F.when(piped & life, "lifecycle-remote-shell").when(piped, "scripts-curl-pipe").when(life & F.col("body").rlike(r"(?i)\bnode\s+(-e|--eval)\b"), "lifecycle-node-eval")
    sc = sc.withColumn("kind", kind).filter("kind is not null")
    what = F.when(F.col("kind") == "scripts-curl-pipe", text("Script \"{name}\" pipes curl/wget into a shell")).when(F.col("kind") == "lifecycle-node-eval", text("Lifecycle script \"{name}\" runs node -e")).otherwise(text("Lifecycle script \"{name}\" pipes curl/wget into a shell"))
    a = found(sc, "supply-chain", "security", id=text("supply-{kind}-{path}-{name}"), severity=F.when(F.col("kind") == "lifecycle-remote-shell", "critical").otherwise("warning"), title=what, location=text("{path}#scripts.{name}"), detail=what, evidence=F.substring("body", 1, 160))
    rows = F.concat(*(entries(F.coalesce(f, F.create_map().cast("map<string,string>")), f) for f in fields))
    dep = pkg.select("repo_id", "path", "file_ord", F.explode(rows).alias("d")).select("repo_id", "path", "file_ord", "d.*").filter(F.col("version").rlike(r"(?i)^(git\+)?http://"))
    b = found(dep, "supply-chain", "security", id=text("supply-dep-git-http-{path}-{field}-{name}"), severity="warning", title=text("Dependency \"{name}\" installed over cleartext HTTP"), location=text("{path}#{field}.{name}"), detail="Anyone on the way can change it.", evidence=F.substring("version", 1, 160))
    return cap(a.unionByName(b), s.most("supply-chain"))


__all__ = ["dependency_funeral", "fixed_version", "license_risk", "module_specs", "outdated_deps", "supply_chain", "vulnerable_deps"]
