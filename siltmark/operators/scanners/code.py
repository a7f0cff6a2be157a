"""Rules about lines and tokens of source files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.scoring import severity_rank
from ...session import checkpointed
from ..findings import cap
from .base import CREDENTIALS, JS, TESTS, Snapshot, at, found, text

SOURCE = r"\.(ts|tsx|js|jsx|mjs|mts|cts|py|go|rs|java|rb|php|c|cc|cpp|h|hpp|cs|kt|swift|scala)$"
EXAMPLES = r"(?i)(^|/)examples?/|(^|/)example\.[cm]?[jt]sx?$"
DEBUG_TESTS = r"(?i)(^|/)(__tests__|tests?|specs?)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|_test\.(py|go|rb)$|_spec\.rb$|(^|/)conftest\.py$"
# Calls that are left over from debugging, by language: label, severity, names.
DEBUG = {
    "py": [("breakpoint()", "warning", ["breakpoint"]), ("pdb.set_trace()", "warning", ["pdb.set_trace", "ipdb.set_trace"]), ("print()", "info", ["print"]), ("pprint()", "info", ["pprint"])],
    "go": [("fmt.Print", "info", ["fmt.Print", "fmt.Println", "fmt.Printf"])],
    "rs": [("dbg!()", "warning", ["dbg!"]), ("println!", "info", ["print!", "println!", "eprintln!"])],
    "rb": [("binding.pry", "warning", ["binding.pry", "binding.irb"])],
    "php": [("dd()", "warning", ["dd", "dump"]), ("var_dump()", "info", ["var_dump", "print_r", "var_export"])],
}
COMMENTS = {"py": ["#"], "rb": ["#"], "go": ["//"], "rs": ["//"], "php": ["//", "#"], "js": ["//"]}

def _called(lang: str, names: list[str]) -> str:
    """A pattern for calls of functions that are not methods of something else; Ruby's need no bracket."""
    import re

    return rf"(?<![\w.$>])({'|'.join(map(re.escape, names))})" + (r"\b" if lang == "rb" else r"\s*\(")


_SECRET_NAME = rf"\w*({'|'.join(CREDENTIALS)})\w*"
#: Risky code: id, severity, what is looked for, title. JavaScript is looked at as lines of tokens with marks for literals (Snapshot.js_lines), so nothing in a text or comment counts.
JS_RISKS = [
    ("eval-dynamic", "critical", r"\beval \( (?![\"`)])", "A value is run as code by eval"),
    ("new-function", "critical", r"\bnew Function \(", "A function is made from text"),
    ("exec-interpolated", "critical", r"\bexec(Sync|File)? \( (`\$|\"\w*\" \+)", "A shell command is put together from values"),
    ("sql-interpolated", "critical", r"(?i)\b(query|execute|raw) \( (`\$q|\"q\w*\" \+)", "A database statement is put together from values"),
    ("innerhtml-dynamic", "warning", r"\. innerHTML = [^;]*(`\$|\+ [A-Za-z_$])", "HTML of an element is put together from values"),
    ("react-dangerous-html", "warning", r"\bdangerouslySetInnerHTML\b", "HTML is set past what the framework escapes"),
    ("tls-verification-off", "critical", r"\brejectUnauthorized : false\b|\bNODE_TLS_REJECT_UNAUTHORIZED [=:] \"?0", "Certificates of servers are not checked"),
    ("weak-hash", "warning", r"\bcreateHash \( [\"`]h", "A hash that can be broken"),
    ("random-for-secret", "warning", rf"(?i)\b(\w*(salt|nonce|session_?id)\w*|{_SECRET_NAME}) [=:] [^;]*\bMath \. random \(", "A secret comes from an ordinary random number"),
    ("jwt-verify-false", "critical", r"\bverify : false\b", "A signature is not checked"),
    ("localstorage-secret", "warning", rf"(?i)\blocalStorage \. setItem \( ([\"`]\$?q?k|[^)]*\b{_SECRET_NAME})", "A credential is kept in the browser's storage"),
    ("document-write-dynamic", "warning", r"\bdocument \. write \( (`\$|[^)]*\+)", "A page is written from values"),
]
#: What a line says in which one of them is found: the name that each pattern asks for begins on its line.
JS_WORDS = r"(?i)eval|Function|exec|query|execute|raw|innerHTML|dangerouslySetInnerHTML|rejectUnauthorized|NODE_TLS_REJECT_UNAUTHORIZED|createHash|random|verify|localStorage|document"
PY_RISKS = [
    ("py-shell-true", "critical", r"\bsubprocess\s*\.\s*\w+\s*\(.*\bshell\s*=\s*True\b", "A command goes through a shell"),
    ("py-os-system", "critical", r"\bos\s*\.\s*system\s*\((?!\s*(\"[^\"]*\"|'[^']*')\s*\))(?!\s*\))", "A shell command is put together from values"),
    ("py-yaml-load", "critical", r"\byaml\s*\.\s*load\s*\((?!.*Loader)", "YAML is read in a way that can make any object"),
    ("py-pickle-load", "warning", _called("py", ["pickle.load", "pickle.loads"]), "Objects are restored from bytes that can make any object"),
    ("py-eval-exec", "critical", _called("py", ["eval", "exec"]) + r"(?!\s*([rbu]?[\"']|\)|$))", "A value is run as code"),
    ("py-verify-false", "critical", r"\brequests\s*\.\s*\w+\s*\(.*\bverify\s*=\s*False\b", "Certificates of servers are not checked"),
]
VENDOR = r"(?i)(^|/)(node_modules|vendor|third_party|dist|build|out|\.next)/|\.min\.[cm]?js$"


def language(path):
    """js, py, go, rs, rb or php by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(path.rlike(f"(?i){JS}"), "js").when(ext.isin("py", "go", "rs", "rb", "php"), ext)


def _code(text, lang):
    """A line without what its strings say, up to its comment: the language's sign at the start or after a blank, a semicolon or a bracket."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"[^"\\]*(?:\\.[^"\\]*)*"', '""'), r"'[^'\\]*(?:\\.[^'\\]*)*'", "''")
    out = bare
    for name, marks in COMMENTS.items():
        out = F.when(lang == name, F.regexp_replace(bare, rf"(^|(?<=[\s;{{}}()]))({'|'.join(marks)}).*$", "")).otherwise(out)
    return out


def _hits(lines: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row per line and rule (lang, pattern, severity, label) whose pattern the line's code holds; any of its matches may be the one."""
    hits = [F.when((F.col("lang") == lang) & F.col("code").rlike(p), F.struct(F.lit(k).alias("rule"), F.lit(sev).alias("severity"), F.lit(label).alias("label"))) for k, (lang, p, sev, label) in enumerate(rules)]
    return lines.select("*", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("*", "h.*").drop("h")


def _first_match(lines: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    return _hits(lines.withColumn("code", _code(F.col("text"), F.col("lang"))), rules)


def _worst_of_line(hits: DataFrame) -> DataFrame:
    """The most severe hit of each line, the first rule of equals."""
    first = Window.partitionBy("repo_id", "path", "line").orderBy(severity_rank(F.col("severity")), "rule")
    return hits.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def leftover_debug(s: Snapshot) -> DataFrame:
    """Debug statements outside tests and examples. Entry points (a shebang, package bins, action mains) report only `debugger`."""
    ours = s.tree.filter(~F.col("path").rlike(DEBUG_TESTS) & ~F.col("path").rlike(EXAMPLES) & (F.length("content") > 0)).withColumn("lang", language(F.col("path")))
    js = ours.filter("lang = 'js'")
    calls = s.tokens.filter(~F.col("path").rlike(DEBUG_TESTS) & ~F.col("path").rlike(EXAMPLES)).filter("kind = 'call' and text rlike '^(debugger|console[.](log|debug|trace|dir|table))$'").select("repo_id", "path", "file_ord", "line", F.col("text").alias("label"))
    shebang = js.filter(F.col("content").startswith("#!")).select("repo_id", "path")
    pkg = s.tree.filter("base = 'package.json'").withColumn("bin", F.get_json_object("content", "$.bin"))
    many = F.coalesce(F.map_values(F.from_json("bin", "map<string,string>")), F.when(F.col("bin").isNotNull() & ~F.col("bin").startswith("{"), F.array(F.col("bin"))))
    mains = s.tree.filter(F.col("base").rlike(r"(?i)^action\.ya?ml$")).select("repo_id", "dir", F.regexp_extract_all("content", F.lit(r"(?m)^\s*main:\s*[\"']?([^\"'\n#]+?)[\"']?\s*(?:#.*)?$"), 1).alias("bins"))
    from ...functions.text import resolve

    entry = pkg.select("repo_id", "dir", many.alias("bins")).unionByName(mains).select("repo_id", "dir", F.explode("bins").alias("bin"))
    stem = F.regexp_replace(F.regexp_replace(resolve(F.col("dir"), F.trim("bin")), r"\.[^./]+$", ""), r"(^|/)dist/", "$1src/")
    entry = entry.select("repo_id", F.explode(F.array(*(F.concat(stem, F.lit(f".{x}")) for x in ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")))).alias("path"))
    entry = shebang.unionByName(entry).distinct().withColumn("entry", F.lit(True))
    calls = calls.join(entry, ["repo_id", "path"], "left").filter("entry is null or label = 'debugger'")
    a = found(calls, "leftover-debug", "hygiene", id=F.concat(F.lit("debug-"), at()), severity="info", title=text("Leftover {label} in source"), location=at(), detail=text("A {label} is committed in source."), evidence=F.when(F.col("label") == "debugger", "debugger").otherwise(F.concat("label", F.lit("(…)"))))
    rules = [(lang, _called(lang, names), sev, label) for lang, rs in DEBUG.items() for label, sev, names in rs]
    hits = _worst_of_line(_first_match(s.lines(ours.filter("lang <> 'js'")), rules))
    b = found(hits, "leftover-debug", "hygiene", id=F.concat(F.lit("debug-"), at()), severity=F.col("severity"), title=text("Leftover {label} in source"), location=at(), detail=text("A {label} is committed in source."), evidence=F.substring(F.trim("text"), 1, 120))
    return cap(a.unionByName(b), s.most("leftover-debug"), s.most("leftover-debug", "per_file"))


def insecure_code(s: Snapshot) -> DataFrame:
    """Risky calls, the worst of each line; not in comments nor, for JavaScript, inside strings or patterns. Tests count one step lower. Larger files than the limit are left out."""
    most_bytes = s.most("insecure-code", "bytes")
    small = F.lit(True) if most_bytes is None else F.coalesce("size", F.lit(0)) <= most_bytes
    ours = s.tree.filter(~F.col("path").rlike(VENDOR) & small & (F.length("content") > 0)).withColumn("lang", language(F.col("path"))).filter("lang in ('js', 'py')")
    raw = s.lines(ours).select("repo_id", "path", "file_ord", "line", "text", "lang")
    py = _first_match(raw.filter("lang = 'py'"), [("py", p, sev, rid) for rid, sev, p, _ in PY_RISKS])
    js = _hits(s.js_lines.withColumnRenamed("text", "code").withColumn("lang", F.lit("js")), [("js", p, sev, rid) for rid, sev, p, _ in JS_RISKS])
    # lines as they are written, of the files that count: only those that can be hit are dealt
    js = js.join(raw.filter("lang = 'js'").filter(F.col("text").rlike(JS_WORDS)).select("repo_id", "path", "line", "text"), ["repo_id", "path", "line"])
    columns = ["repo_id", "path", "file_ord", "line", "text", "rule", "severity", "label"]
    hits = _worst_of_line(js.select(columns).unionByName(py.select(columns))).withColumn("test", F.col("path").rlike(TESTS)).filter("not (test and label in ('new-function', 'eval-dynamic'))")
    sev = F.when(~F.col("test"), F.col("severity")).when(F.col("severity") == "critical", "warning").otherwise("info")
    title = F.create_map(*(F.lit(x) for r in JS_RISKS + PY_RISKS for x in (r[0], r[3])))[F.col("label")]
    out = found(s.aged(hits), "insecure-code", "security", id=F.concat(F.lit("insecure-"), F.col("label"), F.lit("-"), at()), severity=sev, title=title, location=at(), detail=title, evidence=F.substring(F.trim("text"), 1, 160))
    return cap(out, s.most("insecure-code"), s.most("insecure-code", "per_file"))


# Tests that are switched off, by language: calls (or decorators), severity, label; the first that fits a line counts.
_TEST = ["describe", "it", "test", "context", "suite"]
SKIPS = {
    "js": [
        ([f"{x}.only" for x in _TEST], "warning", "focused test (.only)"), (["fit", "fdescribe", "ftest"], "warning", "focused test (fit/fdescribe)"), ([f"{x}.skip" for x in _TEST], "info", "skipped test (.skip)"),
        (["xit", "xdescribe", "xtest", "xcontext"], "info", "skipped test (xit/xdescribe)"), (["it.todo", "test.todo"], "info", "unimplemented test (.todo)"),
    ],
    "py": [(["@pytest.mark.skip", "@unittest.skip"], "info", "skipped test (@skip)"), (["self.skipTest", "pytest.skip"], "info", "skipped test (skip call)")],
}


def skipped_tests(s: Snapshot) -> DataFrame:
    """Tests that are focused or switched off: calls of JavaScript by its tokens, Python's by line."""
    ours = s.tree.filter(~F.col("path").contains(".min.") & (F.length("content") > 0)).withColumn("lang", language(F.col("path")))
    rules = [(lang, names, sev, label) for lang, rs in SKIPS.items() for names, sev, label in rs]
    each = [F.when((F.col("lang") == lang) & F.col("call").isin(*names), F.struct(F.lit(k).alias("rule"), F.lit(sev).alias("severity"), F.lit(label).alias("label"))) for k, (lang, names, sev, label) in enumerate(rules)]
    js = s.tokens.filter("kind = 'call'").filter(~F.col("path").contains(".min.")).select("repo_id", "path", "file_ord", "line", F.concat("text", F.lit("(")).alias("text"), F.col("text").alias("call"), F.lit("js").alias("lang"))
    py = s.lines(ours.filter("lang = 'py'").filter(F.col("content").rlike("skip"))).withColumn("code", _code(F.col("text"), F.col("lang")))
    found_py = F.array_union(F.regexp_extract_all("code", F.lit(r"(@[\w.]+)"), 1), F.regexp_extract_all("code", F.lit(r"([\w.]+)\s*\("), 1))
    py = py.select("repo_id", "path", "file_ord", "line", "text", F.explode(found_py).alias("call"), "lang")
    hits = js.unionByName(py).select("*", F.coalesce(*each).alias("h")).filter("h is not null").select("repo_id", "path", "file_ord", "line", "text", "h.*")
    first = Window.partitionBy("repo_id", "path", "line").orderBy("rule", "text")
    hits = hits.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    out = found(hits, "skipped-tests", "hygiene", id=F.concat(F.lit("skiptest-"), at()), severity=F.col("severity"), title=text("Disabled coverage: {label}"), location=at(), detail=text("A {label} is committed."), evidence=F.substring(F.trim("text"), 1, 120))
    return cap(out, s.most("skipped-tests"), s.most("skipped-tests", "per_file"))


def commented_code(s: Snapshot) -> DataFrame:
    """Runs of three or more comment lines that look like code, by gaps and islands."""
    exts = r"\.(ts|tsx|js|jsx|mjs|mts|cts|java|c|cc|cpp|h|hpp|cs|go|rs|swift|kt|scala|php)$"
    ln = s.lines(s.matching(exts, "//").filter(~F.col("path").contains(".min."))).withColumn("body", F.trim(F.regexp_extract("text", r"^\s*//(.*)$", 1)))
    b = F.col("body")
    note = b.rlike(r"(?i)^([@!/]|\S+-(disable|enable|ignore|expect|nocheck)|(todo|fixme|note|hack|xxx)\b|https?:|copyright|licen[cs]e)")
    last, opens = F.substring(b, -1, 1), F.substring(b, 1, 1)
    statement = last.isin(";", "{", "}", ",", ")") | opens.isin(")", "}", "]") | b.contains("=>") | b.rlike(r"[\w\])]\s*=\s*[^=\s>]")
    prose = last.isin(".", ":", "?", "!") | b.contains("`")
    code = ln.filter(F.col("text").rlike(r"^\s*//") & (F.length("body") >= 2) & statement & ~note & ~prose)
    island = F.col("line") - F.row_number().over(Window.partitionBy("repo_id", "path").orderBy("line"))
    runs = code.withColumn("island", island).groupBy("repo_id", "path", "file_ord", "island").agg(F.min("line").alias("line"), F.count("*").alias("n"), F.min_by("text", "line").alias("text")).filter("n >= 3")
    out = found(runs, "commented-code", "hygiene", id=F.concat(F.lit("commented-"), at()), severity="info", title=text("Commented-out code block ({n} lines)"), location=at(), detail=text("{n} lines of commented-out code start here."), evidence=F.substring(F.trim("text"), 1, 120))
    return cap(out, s.most("commented-code"), s.most("commented-code", "per_file"))


MARKER = r"^[\s*>!-]*(TODO|FIXME|HACK|XXX)\b:?\s*(.*)$"


def todo_debt(s: Snapshot) -> DataFrame:
    """Markers that lead a comment; a year old ones are warnings. JavaScript comments come from tokens, others from the line after its first comment sign."""
    ours = s.matching(SOURCE).filter(F.col("content").rlike("TODO|FIXME|HACK|XXX"))
    js = s.tokens.filter("kind = 'comment'").filter(F.col("path").rlike(SOURCE))
    inner = js.select("repo_id", "path", "file_ord", F.col("line").alias("start"), F.posexplode(F.split(F.regexp_replace("text", r"^(//|/\*)|\*/$", ""), "\n")).alias("k", "body")).withColumn("line", F.col("start") + F.col("k"))
    other = s.lines(ours.filter(~F.col("path").rlike(JS))).filter(F.col("text").rlike(r"//|/\*|\*|#"))
    body = F.regexp_replace(F.when(F.col("text").rlike(r"//|#|/\*"), F.regexp_extract("text", r"(//.*|#.*|/\*.*)", 1)).otherwise(F.col("text")), r"^(//+|/\*+|#+)", "")
    both = inner.select("repo_id", "path", "file_ord", "line", "body").unionByName(other.select("repo_id", "path", "file_ord", "line", body.alias("body"))).filter(F.col("body").rlike(MARKER))
    hits = s.aged(both.withColumn("marker", F.regexp_extract("body", MARKER, 1)).withColumn("rest", F.trim(F.regexp_extract("body", MARKER, 2))))
    short = F.when(F.length("rest") > 80, F.concat(F.substring("rest", 1, 79), F.lit("…"))).otherwise(F.col("rest"))
    title = F.concat(F.col("marker"), F.when(F.length("rest") > 0, F.concat(F.lit(": "), short)).otherwise(""))
    return found(hits, "todo-debt", "todo", id=F.concat(F.lit("todo-"), at()), severity=F.when(F.col("age_days") >= 365, "warning").otherwise("info"), title=title, location=at(), detail=text("{marker} marker in a comment."))


# How each language reads an environment variable, with a mark of a default, and how it reads one by a computed name.
NAME = "([A-Za-z_][A-Za-z0-9_]*)"
READS = {
    "py": [rf"os\.environ\.get\(\s*[\"']{NAME}[\"']\s*(,)?", rf"(?:os\.)?getenv\(\s*[\"']{NAME}[\"']\s*(,)?", rf"(?:os\.environ|environ)\[\s*[\"']{NAME}[\"']\s*\]()"],
    "go": [rf"os\.Getenv\(\s*\"{NAME}\"()", rf"os\.LookupEnv\(\s*\"{NAME}\"()"],
    "rb": [rf"ENV\[\s*[\"']{NAME}[\"']\s*\]()", rf"ENV\.fetch\(\s*[\"']{NAME}[\"']\s*(,)?"],
    "php": [rf"getenv\(\s*[\"']{NAME}[\"']()", rf"\$_ENV\[\s*[\"']{NAME}[\"']\s*\]()", rf"\benv\(\s*[\"']{NAME}[\"']\s*(,)?"],
    "js": [r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)\s*(\?\?|\|\|)?", rf"process\.env\[\s*[\"']{NAME}[\"']\s*\]\s*(\?\?|\|\|)?"],
}
DYNAMIC = {
    "py": r"(os\.environ|environ)\[\s*[^\"'\]\s]|(os\.)?getenv\(\s*[^\"'\s)]", "go": r"os\.(Getenv|LookupEnv)\(\s*[^\"\s)]", "rb": r"ENV\[\s*[^\"'\]\s]", "php": r"getenv\(\s*\$|\$_ENV\[\s*\$|\benv\(\s*\$",
    "js": r"process\.env\[\s*[^\"'\]\s]|=\s*process\.env\s*([;,)\n]|$)|\.\.\.\s*process\.env",
}
#: What a line has that reads a variable in any of these ways.
ENV_MARKS = r"process[.]env|environ|getenv|Getenv|LookupEnv|ENV|env[(]"
EXAMPLE_FILES = (".env.example", ".env.sample", ".env.template", ".env.dist")
PLATFORM = r"^(GITHUB_|RUNNER_|INPUT_|CI_|VERCEL_|NETLIFY_)|^(CI|NODE_ENV|NO_COLOR|FORCE_COLOR|TERM|TZ|LANG|LC_ALL|HOME|PATH|PWD|SHELL|USER|HOSTNAME|TMPDIR)$"


def env_lifecycle(s: Snapshot) -> DataFrame:
    """Variables that code reads and no example file names, and the other way round; the latter only where no variable is read by a computed name."""
    ours = s.tree.filter((F.length("content") > 0) & F.col("content").rlike(ENV_MARKS)).withColumn("lang", language(F.col("path"))).filter("lang is not null")
    js = s.tokens
    # code without comments and strings, one row a line; names in brackets are kept by the tokens
    code = js.filter("kind <> 'comment'").groupBy("repo_id", "path", "file_ord", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text")).withColumn("lang", F.lit("js"))
    ln = code.unionByName(s.lines(ours.filter("lang <> 'js'")).select("repo_id", "path", "file_ord", "line", "text", "lang"))
    ln = checkpointed(ln.filter(F.col("text").rlike(ENV_MARKS)))  # few lines, which six branches read
    parts = []
    for lang, patterns in READS.items():
        for p in patterns:
            got = F.arrays_zip(F.regexp_extract_all("text", F.lit(p), 1).alias("name"), F.regexp_extract_all("text", F.lit(p), 2).alias("default"))
            parts.append(F.when(F.col("lang") == lang, got).otherwise(F.array().cast("array<struct<name:string,default:string>>")))
    unpacked = F.filter(F.transform(F.split(F.regexp_extract("text", r"\{([^}]*)\}\s*=\s*process\.env", 1), ","), lambda x: F.struct(F.regexp_extract(x, rf"^\s*{NAME}", 1).alias("name"), F.when(x.contains("="), "=").otherwise("").alias("default"))), lambda x: x["name"] != "")
    reads = ln.select("repo_id", "path", "file_ord", "line", F.explode(F.concat(*parts, unpacked)).alias("r")).select("repo_id", "path", "file_ord", "line", "r.name", (F.col("r.default") != "").alias("has_default"), F.col("path").rlike(TESTS).alias("test"))
    site = F.min(F.struct("test", "file_ord", "line", "path")).alias("site")
    used = reads.groupBy("repo_id", "name").agg(site, F.bool_or("has_default").alias("has_default"), F.bool_or(~F.col("test")).alias("outside"))
    dynamic = ln.filter(reduce(lambda a, b: a | b, ((F.col("lang") == lang) & F.col("text").rlike(p) for lang, p in DYNAMIC.items()))).select("repo_id").distinct()
    order = F.array_position(F.array(*map(F.lit, EXAMPLE_FILES)), F.col("path"))
    example = s.tree.filter(F.col("path").isin(*EXAMPLE_FILES) & F.col("content").isNotNull()).groupBy("repo_id").agg(F.min_by(F.struct("path", "content"), order).alias("x")).select("repo_id", F.col("x.path").alias("example"), F.col("x.content").alias("content"))
    declared = example.select("repo_id", "example", F.explode(F.split("content", "\n")).alias("l")).select("repo_id", "example", F.regexp_extract("l", r"^\s*(?:export\s+)?([A-Z0-9_]+)\s*=", 1).alias("name")).filter("name <> ''").distinct()
    open_ = used.filter(F.col("outside") & ~F.col("name").rlike(PLATFORM)).join(declared, ["repo_id", "name"], "left_anti").join(example.select("repo_id", "example"), "repo_id", "left")
    where = F.concat_ws(":", "site.path", F.col("site.line").cast("string"))
    title = F.when(F.col("has_default"), text("{name} (optional) not in {example}")).otherwise(text("{name} used but not in {example}"))
    a = found(open_.filter("example is not null"), "env-lifecycle", "env", id=text("env-missing-{name}"), severity=F.when(F.col("has_default"), "info").otherwise("warning"), title=title, location=where, detail=text("Code reads {name}, which {example} does not name."))
    none = open_.filter("example is null").groupBy("repo_id").agg(F.count("*").alias("n"), F.min(F.struct("name", "site")).alias("f"))
    b = found(none, "env-lifecycle", "env", id=F.lit("env-no-example"), severity="info", title=F.concat(F.lit("No .env.example — "), F.col("n").cast("string"), F.lit(" env var"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" undocumented")), location=F.concat_ws(":", "f.site.path", F.col("f.site.line").cast("string")), detail="Code reads variables that no example file names.")
    dead = declared.join(dynamic, "repo_id", "left_anti").join(used.select("repo_id", "name"), ["repo_id", "name"], "left_anti")
    c = found(dead, "env-lifecycle", "env", id=text("env-dead-{name}"), severity="info", title=text("{name} declared but never used"), location=F.col("example"), detail=text("{example} names {name}, which no code reads."))
    return a.unionByName(b).unionByName(c)


# Provider formats of credentials; the generic one needs entropy.
SECRETS = [
    ("aws-access-key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"), ("stripe-key", r"\b([sr]k_live_[0-9A-Za-z]{16,})"), ("github-token", r"\b(gh[pousr]_[0-9A-Za-z]{36,})"),
    ("slack-token", r"\b(xox[abprs]-[0-9A-Za-z-]{10,})"), ("google-api-key", r"\b(AIza[0-9A-Za-z_-]{35})"), ("private-key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
    ("generic", r"(?i)\b\w*(?:secret|token|password|passwd|api_?key)\w*\s*[:=]\s*[\"']([^\"'\s]{16,})[\"']"),
]


def secrets(s: Snapshot) -> DataFrame:
    """Credentials in the tree and in added lines of the history: one finding each, the tree first, then the newest commit. No raw value leaves this function."""
    from ...functions.text import entropy

    skip = r"(^|/)(\.env\.(example|sample|template|dist)|package-lock\.json|pnpm-lock\.yaml|yarn\.lock|Cargo\.lock|poetry\.lock|composer\.lock|Gemfile\.lock|go\.sum)$"
    near = r"(?i)AKIA|ASIA|k_live_|gh[pousr]_|xox|AIza|PRIVATE KEY|secret|token|passw|api_?key"
    tree = s.lines(s.matching(".").filter(~F.col("path").rlike(skip) & F.col("content").rlike(near))).select("repo_id", "path", "file_ord", "line", "text", F.lit("").alias("commit"), F.lit(None).cast("timestamp").alias("commit_ts"))
    if s.history is not None:
        old = s.history.filter(~F.col("path").rlike(skip) & F.col("text").rlike(near))
        tree = tree.unionByName(old.select("repo_id", "path", F.lit(0).cast(tree.schema["file_ord"].dataType).alias("file_ord"), F.lit(0).alias("line"), "text", "commit", F.col("commit_ts").cast("timestamp").alias("commit_ts")))

    def matches(k: int, rule: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda x: F.struct(F.lit(k).alias("k"), F.lit(rule).alias("rule"), x.alias("value")))

    hit = F.explode(F.flatten(F.array(*(matches(k, r, p) for k, (r, p) in enumerate(SECRETS)))))
    rows = tree.select("*", hit.alias("h")).select("repo_id", "path", "file_ord", "line", "commit", "commit_ts", "h.*")
    rows = rows.filter((F.col("rule") != "generic") | ((entropy(F.col("value")) >= 3.5) & ~F.col("value").rlike(r"^\$\{|^<|(?i)example|changeme|placeholder|your[-_]")))
    rows = rows.withColumn("print", F.sha2("value", 256)).withColumn("evidence", F.concat(F.substring("value", 1, 4), F.lit("********"))).drop("value")
    first = Window.partitionBy("repo_id", "print").orderBy((F.col("commit") != ""), F.desc_nulls_last("commit_ts"), "k", "file_ord", "line")
    one = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    place = F.when(F.col("commit") == "", at()).otherwise(F.concat(F.col("path"), F.lit(" @ "), F.substring("commit", 1, 7)))
    sample = F.col("path").rlike(TESTS) | F.col("path").rlike(r"(?i)(^|/)(examples?|samples?)/")
    return found(one, "secrets", "security", id=F.concat(F.lit("secret-"), F.col("rule"), F.lit("-"), F.substring("print", 1, 12)), severity=F.when(sample, "info").otherwise("critical"), title=F.concat(F.lit("Committed credential: "), F.col("rule")), location=place, detail=F.when(F.col("commit") == "", "A credential is in the tree.").otherwise("A credential is in the history."), evidence=F.col("evidence"))
