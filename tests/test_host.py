"""Host projections, due repositories, found repositories, shapes of ids and fingerprints."""

import json
import uuid

from pyspark.sql import functions as F

from siltmark.functions import text as T
from siltmark.operators import timeline as TL
from siltmark.sources import git, host


def answers(spark, payloads):
    return spark.createDataFrame([(k, p if p is None or isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)], "k int, payload string")


def test_repositories(spark):
    full = {"full_name": "o/n", "owner": {"login": "o"}, "name": "n", "description": "", "default_branch": "dev", "stargazers_count": 5, "forks_count": "7", "open_issues_count": 1.5, "language": 3, "license": {"spdx_id": "NOASSERTION"}, "topics": ["a", 1, None, *"bcdefghij"], "archived": True, "fork": "true", "private": 1, "size": -2, "secret": "x"}
    bare = {"full_name": "o/m", "owner": {"login": "o"}, "name": "m", "license": "MIT", "topics": "x", "html_url": "http://h", "stargazers_count": None}
    bad = [None, "", "{", "[]", "3", "null", {"message": "Not Found"}, {"full_name": "o/n", "owner": None, "name": "n"}, {"full_name": "", "owner": {"login": "o"}, "name": "n"}, {"full_name": "o/n", "owner": {"login": 4}, "name": "n"}]
    got = {r.k: r for r in host.repositories(answers(spark, [full, bare, *bad])).collect()}
    assert set(got) == {0, 1}
    a, b = got[0], got[1]
    assert (a.owner, a.name, a.description, a.html_url, a.clone_url, a.default_branch) == ("o", "n", None, "https://github.com/o/n", "https://github.com/o/n.git", "dev")
    assert (a.stars, a.forks, a.open_issues, a.language, a.license, a.topics, a.archived, a.fork, a.private, a.size_kb) == (5, 0, 1.5, None, None, list("abcdefgh"), True, False, False, -2)
    assert (b.html_url, b.default_branch, b.stars, b.license, b.topics, b.archived) == ("http://h", "main", 0, None, [], False) and "secret" not in a.asDict()


def test_people_and_their_repositories(spark):
    rows = [{"login": "x", "name": "N", "created_at": "2015-06-01T00:00:00Z", "public_repos": 3.9, "followers": -1}, {"login": "y", "created_at": "never", "followers": "9"}, {"name": "no login"}, "no"]
    got = {r.k: (r.login, r.name, r.joined_year, r.public_repos, r.followers) for r in host.people(answers(spark, rows)).collect()}
    assert got == {0: ("x", "N", 2015, 3, None), 1: ("y", None, None, None, None)}
    item = lambda lang, stars, name="r": {"language": lang, "stargazers_count": stars, "name": name}
    found = [{"items": [item("B", 9, "best"), item("A", 3), item("A", "x"), item("B", 1), item(None, 2)], "total_count": 50}, {"items": [item(None, 0, "")], "total_count": 1}, {"items": []}, {"items": "x"}, None]
    got = {r.k: (r.top_language, r.stars_received, r.stars_approximate, r.best_known) for r in host.repository_stats(answers(spark, found)).collect()}
    assert got == {0: ("B", 15, True, "best"), 1: (None, 0, False, None), 2: (None, None, False, None), 3: (None, None, False, None), 4: (None, None, False, None)}


def test_due_repositories(spark):
    settings = spark.createDataFrame([("off", False, "interval", 1.0, None), ("hours", True, "interval", 2.0, None), ("odd", True, "weekly", 0.1, None), ("day", True, "daily", None, "06:30"), ("bad_time", True, "daily", 1.0, "25:00"), ("null", None, None, None, None)], "owner string, enabled boolean, mode string, interval_hours double, daily_time string")
    repos = spark.createDataFrame([(o, u, t) for o in ("off", "hours", "odd", "day", "bad_time", "null", "no settings") for u, t in (("a", "2026-01-10 05:00:00"), ("b", "2026-01-10 06:31:00"), ("c", "2026-01-09 06:00:00"), ("d", None), ("", "2020-01-01 00:00:00"), (None, None))], "owner string, url string, at string").select("owner", "url", F.col("at").cast("timestamp").alias("scanned_ts"))
    due = lambda now: {o: [r.url for r in sorted(rows, key=lambda r: r.place)] for o, rows in _by(TL.due_repos(repos, settings, now).collect()).items()}
    assert due("2026-01-10 07:00:00") == {"hours": ["d", "c", "a"], "odd": ["d", "c"], "day": ["d", "c", "a"], "bad_time": ["d", "c"]}
    assert due("2026-01-10 06:00:00") == {"hours": ["d", "c"], "odd": ["d", "c"], "bad_time": ["d", "c"]}
    assert due("2026-01-10 02:00:00") == {"hours": ["d", "c"], "odd": ["d"]}


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.owner, []).append(r)
    return out


def test_repositories_are_found_with_branch_and_commit(spark, tmp_path):
    sha = lambda c: c * 40

    def put(path, text):
        p = tmp_path / "all" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("one/.git/HEAD", "ref: refs/heads/feature/x\n")
    put("one/.git/refs/heads/feature/x", sha("a") + "\n")
    put("one/.git/config", '[core]\n\tbare = false\n[remote "up"]\n\turl = no\n[remote "origin"]\n\turl = git@h.org:o/n.git\n\tpushurl = https://h.org/p/q.git\n[branch "m"]\n\tremote = origin\n')
    put("two/.git/HEAD", sha("b") + "\n")
    put("three/.git/HEAD", "ref: refs/heads/main\n")
    put("three/.git/packed-refs", f"# pack-refs\n{sha('c')} refs/heads/main\n^{sha('d')}\n{sha('e')} refs/tags/v1\n")
    put("three/.git/config", '[remote "origin"]\n\turl = /local/dir\n')
    put("a b/.git/HEAD", "ref: refs/heads/new\n")
    put("plain/README.md", "x")
    root = str(tmp_path / "all")
    got = {r.folder: (r.origin, r.branch, r["head"]) for r in git.find_repositories(spark, root).collect()}
    assert got == {"one": ("https://h.org/p/q.git", "feature/x", sha("a")), "two": (None, "main", sha("b")), "three": ("/local/dir", "main", sha("c")), "a b": (None, "new", None)}
    assert {r.folder for r in git.find_repositories(spark, root, ["one", " two ", "none"]).collect()} == {"one", "two"}
    assert {r.folder for r in git.find_repositories(spark, root, None, 2).collect()} == {"a b", "one"}
    (tmp_path / "empty").mkdir()
    assert git.find_repositories(spark, str(tmp_path / "empty")).collect() == []


def test_shapes_and_fingerprints(spark):
    one = str(uuid.UUID(int=7)).upper()
    rows = spark.createDataFrame([(one,), (f" {one} ",), ("opt-out",), ("x" * 9999,), ("",), (None,)], "h string")
    assert [r.v for r in rows.select(T.visitor(F.col("h")).alias("v")).collect()] == [one.lower(), one.lower(), None, "anonymous", "anonymous", "anonymous"]
    names = spark.createDataFrame([("a",), ("a-b",), ("-a",), ("a-",), ("a--b",), ("x" * 39,), ("x" * 40,), ("a_b",), (None,)], "n string")
    assert [r.v for r in names.select(T.fits(F.col("n"), T.LOGIN).alias("v")).collect()] == [True, True, False, False, False, True, False, False, False]

    def plain(text):
        h = 5381
        for k in range(0, len(raw := text.encode("utf-16-be")), 2):
            h = (h * 33 + int.from_bytes(raw[k : k + 2])) & 0xFFFFFFFF
        return h

    texts = ["", "a", "finding-1finding-2", "é日本", "😀" * 5, "z" * 3000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r.v for r in df.select(T.djb2(F.col("t")).alias("v")).collect()] == [*map(plain, texts), None]
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    base = lambda n: (base(n // 36) if n >= 36 else "") + digits[n % 36]
    ids = spark.createDataFrame([(["b", "a", "c"],), ([],)], "x array<string>")
    assert [r.v for r in ids.select(T.fingerprint(F.col("x")).alias("v")).collect()] == [base(plain("abc")), base(plain(""))]
