from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tokenledger.functions import dims, prompts, text
from tokenledger.functions.dims import DimFilters, TimeWindow, since_of


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_tickets(spark):
    cases = {
        "PAVA-12-login": ("PAVA-12", "branch"), "refs/heads/pava-3": ("PAVA-3", "branch"), "fix/1234-typo": ("1234", "branch_numeric"), "chore/sweep-2": None,
        "fix/ABC-1-chore/sweep-2": ("ABC-1", "branch"), "eng-7/chore/sweep-9": ("ENG-7", "branch"), "03-20-pava-2120_desc": ("PAVA-2120", "branch"), "fix/PAVA-42-and-1234": ("PAVA-42", "branch"),
        "main": None, "HEAD": None, "": None, None: None, "fix/12ab": None, "x/77": ("77", "branch_numeric"), "v8/375-adr-0091-pricing": ("375", "branch_numeric"),
    }
    got = column(spark, list(cases), text.ticket)
    assert [tuple(x) if x else None for x in got] == list(cases.values())
    assert column(spark, ["A-1", "77"], text.ticket_prefix) == ["A", ""]


def test_repos_and_paths(spark):
    urls = {
        "git@github.com:acme/repo.git": "github.com/acme/repo", "https://user@GitHub.com/acme/repo/": "github.com/acme/repo", "ssh://git@host.x:22/a/b.git": "host.x/a/b",
        "https://h.io/a/b?x=1#y": "h.io/a/b", "nonsense": None, "": None,
    }
    assert column(spark, list(urls), text.repo_of_url) == list(urls.values())
    assert column(spark, ["github.com/a/b", "local", "a/b.c/d", "x.y/z"], text.looks_like_repo) == [True, False, False, False]
    paths = {
        "src/a.py": "src/a.py", "/w/r/lib/../b": "b", "/etc/x": None, "http://x/y": None, "..\\out": None, "file:///w/r/c%20d": "c%20d", "./a//b/./c": "a/b/c", "/w/r": None, "": None,
    }
    assert column(spark, list(paths), lambda c: text.repo_path(c, F.lit("/w/r"))) == list(paths.values())
    assert column(spark, ["/a/b/", "C:\\x\\y", "z"], text.basename) == ["b", "y", "z"]
    assert column(spark, ["file:///a/b%20c+d"], text.path_of_uri) == ["/a/b c+d"]
    globs = [("github.com/a/r1", "*/a/r?", True), ("x", "*", True), ("ab.c", "a?.c", True), ("abxc", "a?.c", False), (None, "*", None)]
    df = spark.createDataFrame(globs, "v string, g string, w boolean")
    assert all(r[0] == r[1] for r in df.select(text.glob_match(F.col("v"), F.col("g")), "w").collect())
    assert text.glob_regex("a.*?") == r"^a\..*.$"


def test_ids_times_models(spark):
    uuid = "550E8400-e29b-41d4-a716-446655440000"
    assert column(spark, [f"cursor-{uuid}", " plain "], text.session_id) == [uuid.lower(), "plain"]
    a, b = column(spark, ["k", None], lambda c: text.uuid_of(c, F.lit("z")))
    assert len(a) == 36 and a != b
    at = column(spark, ["1704067200000", "2024-01-01T00:00:00Z", "bad", None], lambda c: text.timestamp_of(c).cast("string"))
    assert at == ["2024-01-01 00:00:00"] * 2 + [None, None]
    names = {
        "claude-opus-4-6": ("Claude Opus 4.6", None, False), "claude-haiku-4-5-20251001": ("Claude Haiku 4.5", None, False), "claude-haiku-4.5": ("claude-haiku-4.5", None, False),
        "claude-opus-4-7-thinking-high": ("Claude Opus 4.7", "thinking-high", False), "claude-4.5-opus-high-thinking": ("Claude Opus 4.5", "thinking-high", False), "claude-4.6-opus": ("Claude Opus 4.6", None, False),
        "gpt-5.3-codex": ("GPT-5.3 Codex", None, False), "gpt-5.3-codex-xhigh": ("GPT-5.3 Codex", "xhigh", False), "gpt-5-codexmax": ("GPT-5 Codex", "max", False), "gpt-4.1-mini": ("GPT-4.1", "mini", False), "gpt-4o": ("gpt-4o", None, False),
        "default": ("Cursor Auto", None, True), "(untagged)": ("(model not yet attributed)", None, True), "café-7": ("café-7", None, False),
    }
    assert [tuple(x) for x in column(spark, list(names), text.display_model)] == list(names.values())
    assert column(spark, ["claude-opus-4-7-thinking-high", "other"], text.model_label) == ["Claude Opus 4.7 · thinking-high", "other"]


def test_prompts(spark):
    cases = {
        "fix the login bug": ("bugfix", "high"), "explain the error": ("question", "medium"), "how do I fix this error": ("question", "medium"), "please rename this": ("refactor", "low"),
        "add a button": ("feature", "low"), "/help me fix": None, "hi": None, "<tag>": None, "update the readme": ("docs", "low"), "is it done?": ("question", "low"),
        "prefix only": None, "write a blog post about it": ("writing", "high"), "run the unit tests in the folder of the parser": ("testing", "medium"),
    }
    got = column(spark, list(cases), prompts.classify)
    assert [(x.category, x.confidence) if x else None for x in got] == list(cases.values())


def test_windows_and_filters():
    with pytest.raises(ValueError):
        TimeWindow(since="2024-01-01")
    with pytest.raises(ValueError):
        TimeWindow.parse("never")
    assert TimeWindow.parse("2024-01-01", "2024-01-02T00:00:00Z").aligned() == "day"
    assert TimeWindow.parse("2024-01-01T05:00:00").aligned() == "hour"
    assert TimeWindow.parse("2024-01-01T05:00:01").aligned() == "raw"
    assert TimeWindow.parse("2024-01-02", "2024-01-01").aligned() == "raw"
    f = DimFilters(providers=" a, b ,a,", branches=("refs/heads/x", "REFS/HEADS/x", ""), surfaces=("VSCode",))
    assert (f.providers, f.branches, f.surfaces) == (("a", "b"), ("x",), ("vscode",))
    now = datetime(2024, 3, 31, 15)
    assert [since_of(p, now) for p in ("today", "week", "2w", "1m", "13m", "all")] == [
        datetime(2024, 3, 31), datetime(2024, 3, 24), datetime(2024, 3, 17), datetime(2024, 2, 29), datetime(2023, 2, 28), None,
    ]
    with pytest.raises(ValueError):
        since_of("3y", now)


def test_dimensions(spark):
    df = spark.createDataFrame([(None, None, None, None, None), ("", "<s>", "unknown", "Refs/Heads/", "VSCode"), ("p", "m", "r", "refs/heads/b", "x")], "provider string, model string, repo_id string, git_branch string, surface string")
    got = [tuple(r) for r in df.select(*[f() for f in dims.NORMAL.values()]).collect()]
    u = "(untagged)"
    assert got == [("claude_code", u, u, u, "unknown"), ("claude_code", u, u, u, "vscode"), ("p", "m", "r", "b", "x")]
