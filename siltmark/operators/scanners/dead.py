"""Rules about code that nothing uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import dirname, resolve
from ..findings import cap
from .base import JS, TESTS, Snapshot, at, found, text
from .deps import module_specs

# Exports that frameworks call by name.
CONVENTIONS = "metadata generateMetadata viewport generateViewport generateStaticParams dynamic dynamicParams revalidate fetchCache runtime preferredRegion maxDuration config middleware GET POST PUT PATCH DELETE HEAD OPTIONS alt size contentType".split()
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs"]


def dead_code(s: Snapshot) -> DataFrame:
    """Exports that no module imports by name, and Python and Go definitions whose name occurs once."""
    return _exports(s).unionByName(_symbols(s))


def _exports(s: Snapshot) -> DataFrame:
    files = s.matching(JS)
    enough = s.tree.filter(F.col("path").rlike(JS)).groupBy("repo_id").agg(F.count("*").alias("n")).filter("n >= 2").select("repo_id")
    # only files that say "export" have exports; what is declared is seen from the tokens before a name
    exporting = s.code_files.filter(F.exists("t", lambda x: x["text"].contains("export")))
    names = exporting.select("repo_id", "path", F.explode(F.transform(F.filter("t", lambda x: x["kind"] == "name"), lambda x: x["text"])).alias("name")).groupBy("repo_id", "path", "name").agg(F.count("*").alias("times"))
    b = lambda i, n: F.get("t", i - n)["text"]
    says = lambda i: (b(i, 1).isin("function", "class", "const", "let", "var") & (b(i, 2) == "export")) | (b(i, 1).isin("function", "class") & b(i, 2).isin("async", "abstract") & (b(i, 3) == "export")) | ((b(i, 1) == "*") & (b(i, 2) == "function") & (b(i, 3) == "export"))
    declared = exporting.select("repo_id", "path", "file_ord", F.inline(F.filter("t", lambda x, i: (x["kind"] == "name") & says(i)))).select("repo_id", "path", "file_ord", "line", F.col("text").alias("name"))
    # brace lists: the text of each list, and whether it is an import, a re-export or an export
    code = s.code_files.select("repo_id", "path", "file_ord", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("code"))
    lists = code.select("repo_id", "path", "file_ord", F.explode(F.regexp_extract_all("code", F.lit(r"((?:import|export)(?: type)?(?: [\w$]+ ,)? \{[^{}]*\}(?: from)?)"), 1)).alias("l"))
    items = lists.select("repo_id", "path", "file_ord", F.col("l").startswith("import").alias("imp"), F.col("l").endswith("from").alias("re"), F.explode(F.split(F.regexp_extract("l", r"\{([^{}]*)\}", 1), ",")).alias("item")).filter("trim(item) <> ''")
    first = F.regexp_extract("item", r"^\s*(?:type )?([\w$]+)", 1)
    last = F.regexp_extract("item", r"([\w$]+)\s*$", 1)
    used = items.filter("imp or re").select("repo_id", first.alias("name")).distinct()
    listed = items.filter("not imp and not re").select("repo_id", "path", "file_ord", F.lit(1).alias("line"), last.alias("name")).filter("name <> 'default'")
    exports = declared.unionByName(listed).filter(~F.col("path").rlike(r"(^|/)index\.[a-z]+$")).distinct()
    stars = code.select("repo_id", "path", F.explode(F.regexp_extract_all("code", F.lit(r"(?:import|export) \*(?: as [\w$]+)? from [\"']([^\"']+)[\"']"), 1)).alias("spec"))
    whole = stars.unionByName(module_specs(s).filter("form = 'call'").select("repo_id", "path", "spec")).filter(F.col("spec").rlike(r"^(\.|@/)"))
    base = F.when(F.col("spec").startswith("@/"), resolve(F.lit(""), F.expr("substring(spec, 3)"))).otherwise(resolve(dirname(F.col("path")), F.col("spec")))
    tries = whole.select("repo_id", "path", "spec", F.posexplode(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(base, e))).alias("k", "to"))
    there = tries.join(files.select("repo_id", F.col("path").alias("to")), ["repo_id", "to"], "left_semi").groupBy("repo_id", "path", "spec").agg(F.min_by("to", "k").alias("to"))
    exempt = there.select("repo_id", F.col("to").alias("path")).distinct()
    dead = exports.join(enough, "repo_id", "left_semi").join(exempt, ["repo_id", "path"], "left_anti").join(used, ["repo_id", "name"], "left_anti").filter(~F.col("name").isin(*CONVENTIONS))
    dead = dead.withColumn("kit", F.regexp_extract("path", r"^(.*?\bcomponents/(?:ui|magicui|aceternity))/", 1))
    local = names.filter("times > 1").select("repo_id", "path", "name")
    lone = dead.filter("kit = ''").join(local, ["repo_id", "path", "name"], "left_anti")
    a = found(lone, "dead-code", "dead-code", id=text("dead-export-{path}:{name}"), severity="info", title=text("Unused export {name}"), location=at(), detail=text("Nothing imports {name} from {path}."))
    kits = dead.filter("kit <> ''").groupBy("repo_id", "kit").agg(F.count("*").alias("n"), F.countDistinct("path").alias("m"), F.min("file_ord").alias("file_ord"))
    b = found(kits, "dead-code", "dead-code", id=text("dead-code-uikit-{kit}"), severity="info", title=text("{n} unused UI-kit exports in {kit}"), location=F.col("kit"), detail=text("{n} exports of {m} components are never imported."))
    return a.unionByName(b)


def _symbols(s: Snapshot) -> DataFrame:
    lang = F.when(F.col("path").rlike(r"(?i)\.py$"), "python").when(F.col("path").rlike(r"(?i)\.go$"), "go")
    files = s.matching(r"(?i)\.(py|go)$").withColumn("lang", lang)
    generated = (F.col("lang") == "go") & F.substring_index("content", "\n", 5).rlike(r"(?m)^// Code generated .* DO NOT EDIT\.?$")
    often = files.select("repo_id", "lang", F.explode(F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name")).groupBy("repo_id", "lang", "name").agg(F.count("*").alias("times")).filter("times > 1").select("repo_id", "lang", "name")
    listed = files.filter("lang = 'python'").select("repo_id", "lang", F.explode(F.regexp_extract_all(F.regexp_extract("content", r"(?s)__all__\s*=\s*[\[(](.*?)[\])]", 1), F.lit(r"['\"]([A-Za-z_]\w*)['\"]"), 1)).alias("name")).distinct()
    tests = F.col("path").rlike(r"(?i)(^|/)(test_[^/]*\.py|[^/]*_test\.py|conftest\.py)$|(^|/)tests?/.*\.py$|_test\.go$")
    # lines with something in them, and with each definition the one before it
    written = F.filter(F.transform(F.split("content", r"\r?\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda x: F.trim(x["text"]) != "")
    py, go = r"^(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[(\[]"
    each = F.transform("w", lambda x, i: F.when(x["text"].rlike(rf"{py}|{go}"), F.struct(x["line"].alias("line"), x["text"].alias("text"), F.trim(F.get("w", i - 1)["text"]).alias("above"))))
    defs = files.filter(~tests & ~generated).select("repo_id", "path", "file_ord", "lang", written.alias("w")).select("repo_id", "path", "file_ord", "lang", F.inline(F.array_compact(each)))
    defs = defs.withColumn("name", F.when(F.col("lang") == "python", F.regexp_extract("text", py, 2)).otherwise(F.regexp_extract("text", go, 1))).filter("name <> ''")
    ok_py = ~F.col("name").rlike(r"^__.*__$|^[Tt]est|^main$") & ~F.coalesce(F.col("above").startswith("@"), F.lit(False))
    ok_go = ~F.col("name").rlike(r"^[A-Z]|^main$|^init$")
    defs = defs.filter(F.when(F.col("lang") == "python", ok_py).otherwise(ok_go))
    dead = defs.join(often, ["repo_id", "lang", "name"], "left_anti").join(listed, ["repo_id", "lang", "name"], "left_anti")
    kind = F.when(F.col("text").rlike(r"^class\b"), "class").otherwise("function")
    out = found(dead, "dead-code", "dead-code", id=F.concat(F.lit("dead-symbol-"), at()), severity="info", title=F.concat(F.lit("Unused "), kind, F.lit(" "), F.col("name")), location=at(), detail=text("The name {name} occurs once."), evidence=F.substring(F.trim("text"), 1, 140))
    return cap(out, s.most("dead-code"))
