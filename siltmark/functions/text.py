"""Column expressions and plan-time helpers for paths, globs, versions, licences, URLs and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a path pattern: ** crosses folders (and takes a slash that follows), * and ? stay in one."""
    out = ""
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", glob.replace("\\", "/")):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return f"^{out}$"


def path_norm(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def dirname(path: Column) -> Column:
    """The folder of a path; empty at the root."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), "/$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def resolve(base_dir: Column, target: Column) -> Column:
    """A path relative to a folder, with . and .. worked out; .. above the root is dropped."""
    parts = F.split(F.concat_ws("/", base_dir, target), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat_ws("/", kept)


def folders_above(path: Column) -> Column:
    """All folders that hold a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, F.when(F.size(parts) > 1, n).otherwise(0)), "/"))


def version_part(version: Column, part: int) -> Column:
    """Major (0), minor (1) or patch (2) of the first version in a text, or null; missing parts are 0."""
    found = F.regexp_extract(version, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", part + 1)
    return F.when(version.rlike(r"\d"), F.coalesce(F.nullif(found, F.lit("")), F.lit("0")).cast("int"))


def range_kind(version: Column) -> Column:
    """caret, tilde, exact or other."""
    v = F.trim(version)
    return F.when(v.startswith("^"), "caret").when(v.startswith("~"), "tilde").when(v.rlike(r"^=?v?\d+\.\d+\.\d+"), "exact").otherwise("other")


def lag_behind(current: Column, latest: Column) -> Column:
    """major, minor or null: by how much a version is behind another."""
    major, minor = (version_part(latest, k) - version_part(current, k) for k in (0, 1))
    return F.when(major > 0, "major").when((major == 0) & (minor > 0), "minor")


# Classes of licences from the mildest to the strictest, and the class of each name prefix; the longest prefix that fits decides.
LICENCE_CLASSES = ("permissive", "unknown", "weak-copyleft", "proprietary", "strong-copyleft", "network-copyleft")
LICENCES = {
    "permissive": "mit bsd apache isc 0bsd unlicense cc0 cc-by wtfpl zlib python-2 postgresql blueoak ms-pl",
    "weak-copyleft": "lgpl mpl epl eupl cddl cpl ms-rl cc-by-sa artistic",
    "proprietary": "unlicensed proprietary commercial",
    "strong-copyleft": "gpl cecill",
    "network-copyleft": "agpl sspl osl",
}


def licence_class(expression: Column) -> Column:
    """Class of a licence expression: the mildest side of OR, the strictest of AND; unknown if nothing is declared or recognised."""

    def rank(name: Column) -> Column:
        n = F.lower(F.trim(F.regexp_replace(F.trim(name), r"^\(|\)$", "")))
        out = F.when(n.startswith("see license"), LICENCE_CLASSES.index("proprietary")).otherwise(LICENCE_CLASSES.index("unknown"))
        pairs = [(p, LICENCE_CLASSES.index(c)) for c, names in LICENCES.items() for p in names.split()]
        for prefix, k in sorted(pairs, key=lambda x: len(x[0])):
            out = F.when(n.startswith(prefix), k).otherwise(out)
        return out

    sides = F.transform(F.split(F.coalesce(expression, F.lit("")), r"(?i)\s+or\s+"), lambda side: F.array_max(F.transform(F.split(side, r"(?i)\s+and\s+"), rank)))
    return F.element_at(F.array(*map(F.lit, LICENCE_CLASSES)), F.array_min(sides) + 1)


# Sentences by which a licence file is recognised, in order, in its first 4000 characters.
LICENCE_TEXTS = (
    (r"(?i)GNU AFFERO GENERAL PUBLIC LICENSE", "AGPL-3.0"), (r"(?i)Server Side Public License", "SSPL-1.0"), (r"(?i)GNU LESSER GENERAL PUBLIC LICENSE", "LGPL-3.0"),
    (r"(?i)GNU GENERAL PUBLIC LICENSE", "GPL-3.0"), (r"(?i)Mozilla Public License", "MPL-2.0"), (r"(?i)Eclipse Public License", "EPL-2.0"), (r"(?i)Apache License", "Apache-2.0"),
    (r"(?i)\bMIT License\b", "MIT"), (r"(?i)Redistribution and use in source and binary forms", "BSD-3-Clause"), (r"(?i)ISC License", "ISC"),
)


def licence_of_text(text: Column, most: int | None = 4000) -> Column:
    """The licence that a text is recognised as, by so many of its first characters (None: all)."""
    head, out = text if most is None else F.substring(text, 1, most), F.lit(None).cast("string")
    for pattern, name in reversed(LICENCE_TEXTS):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def private_host(url: Column) -> Column:
    """Whether a URL leads to a private, reserved or placeholder host, or to none."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return (
        (host == "") | ~host.contains(".") | host.rlike(r"^(localhost|127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")
        | host.rlike(r"(^|\.)(example\.(com|org|net)|test|invalid|local|internal|localhost)$") | host.rlike(r"[{}$<>]")
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, as a long."""
    code = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(text) - 1, F.lit(0))), lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i + 1, F.lit(1))), 16, 10).cast("long"))
    return F.when(F.octet_length(text) == 0, F.lit(2166136261)).otherwise(F.aggregate(code, F.lit(2166136261).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619), F.lit(4294967296).cast("long"))))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits. Characters are sorted and counted in one pass, so a long text costs about its length."""
    n = F.length(text).cast("double")
    part = lambda run: F.when(run > 0, run / n * F.log2(run / n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.when(c == a["last"], F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + part(a["run"])).alias("sum")))
    total = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda a: F.lit(0.0) - a["sum"] - part(a["run"]))
    return F.when(F.length(text) > 0, total).otherwise(0.0)


def compact_count(n: Column) -> Column:
    """1234 as 1.2k, 25000 as 25k, 2500000 as 2.5M."""

    def short(x: Column, unit: str) -> Column:
        tenth = F.regexp_replace((F.floor(x * 10 + 0.5) / 10).cast("string"), r"\.0$", "")
        return F.concat(F.when(x < 10, tenth).otherwise(F.floor(x + 0.5).cast("string")), F.lit(unit))

    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, short(n / 1000, "k")).otherwise(short(n / 1_000_000, "M"))


# Shapes of ids.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
LOGIN = r"^[a-zA-Z0-9](?:[a-zA-Z0-9]|-(?=[a-zA-Z0-9])){0,38}$"
FULL_SHA = r"(?i)^[0-9a-f]{40}$"
OPT_OUT, ANONYMOUS = "opt-out", "anonymous"


def fits(value: Column, shape: str) -> Column:
    """Whether a value has a shape (UUID, LOGIN, FULL_SHA); false for null."""
    return F.coalesce(value.rlike(shape), F.lit(False))


def visitor(header: Column) -> Column:
    """The id to record for a request: a UUID in lower case, null for one that opted out, else `anonymous`; nothing else of what was sent is kept."""
    raw = F.trim(F.coalesce(header, F.lit("")))
    return F.when(raw == OPT_OUT, None).when(fits(raw, UUID), F.lower(raw)).otherwise(ANONYMOUS)


def djb2(text: Column) -> Column:
    """A 32-bit hash of a text's UTF-16 units, h = 33 h + unit from 5381, as a number from 0; null for null. For fingerprints that others compare, not for keys."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), 1), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.when(text.isNotNull(), F.aggregate(units, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF))))


def fingerprint(ids: Column) -> Column:
    """djb2 of an array of ids, sorted and joined, in base 36."""
    return F.lower(F.conv(djb2(F.array_join(F.sort_array(ids), "")).cast("string"), 10, 36))
