"""Column expressions over names: tickets, globs, repository URLs, paths, ids, timestamps, model labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TICKET_DENYLIST = (
    "ADR", "CEP", "CHORE", "DEMO", "DRAFT", "FIX", "ISSUE", "ITER", "LIMIT", "PASS", "PR", "REFACTOR", "RFC", "ROUND", "STEP",
    "SWEEP", "TASK", "TMP", "TODAY", "TODO", "V", "VERSION", "WIP",
)
INTEGRATION_BRANCHES = ("main", "master", "develop", "HEAD")


def ticket(branch: Column) -> Column:
    """struct(id, source) of a branch name, or null: LETTERS-digits whose letters are no common word, else leading digits of the last part."""
    short = F.regexp_replace(branch, "^(?i:refs/heads/)", "")
    found = F.regexp_extract_all(short, F.lit("[A-Za-z]{2,}-[0-9]+"), F.lit(0))
    named = F.get(F.filter(found, lambda t: ~F.upper(F.split_part(t, F.lit("-"), F.lit(1))).isin(*TICKET_DENYLIST)), F.lit(0))
    digits = F.regexp_extract(F.element_at(F.split(short, "/"), -1), "^([0-9]+)(-|$)", 1)
    made = F.when(named.isNotNull(), F.struct(F.upper(named).alias("id"), F.lit("branch").alias("source"))).when(
        digits != "", F.struct(digits.alias("id"), F.lit("branch_numeric").alias("source"))
    )
    return F.when(~short.isin(*INTEGRATION_BRANCHES) & (short != ""), made)


def ticket_prefix(t: Column) -> Column:
    return F.when(F.instr(t, "-") > 0, F.split_part(t, F.lit("-"), F.lit(1))).otherwise("")


def glob_regex(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def glob_match(value: Column, glob: Column) -> Column:
    """``*`` and ``?`` globs held in a column."""
    quoted = F.regexp_replace(glob, r"([\\.+^$|(){}\[\]])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))
    return F.regexp_like(value, pattern)


def repo_of_url(url: Column) -> Column:
    """host/owner/repo of a git URL, in lower-case host; null if there is none."""
    u = F.trim(url)
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"^[^/@]*@", "")
    u = F.regexp_replace(u, r"^([^/:]+):([0-9]+)/", "$1/")
    u = F.regexp_replace(u, r"^([^/:]+):", "$1/")
    u = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"(\.git)?/*$", "")
    host, rest = F.split_part(u, F.lit("/"), F.lit(1)), F.regexp_replace(u, r"^[^/]*/*", "")
    return F.when((host != "") & (rest != ""), F.concat(F.lower(host), F.lit("/"), rest))


def looks_like_repo(repo: Column) -> Column:
    return repo.rlike(r"^[^/]*\.[^/]*/[^/]*/.*$")


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"[^/\\]*$", 0)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, outside of the generated code, which has a size limit."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _folded(path: Column) -> Column:
    """``path`` without empty parts, . and .., and without outer slashes."""
    push = lambda a, x: F.when(x.isin("", "."), a).when(
        x == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    ).otherwise(F.concat(a, F.array(x)))
    slowly = lambda c: F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), push), "/")
    # most paths hold no such part: they are not taken apart
    return let(F.regexp_replace(path, r"^/+|/+\z", ""), lambda c: F.when(c.rlike(r"(^|/)\.{0,2}(/|$)"), slowly(c)).otherwise(c))


def repo_root(root: Column) -> Column:
    return _folded(F.replace(root, F.lit("\\"), F.lit("/")))


def repo_path(path: Column, root: Column, base: Column | None = None) -> Column:
    """``path`` relative to ``root`` with / separators and .. folded; null outside of it or for other schemes. ``base``: the root, folded."""
    base = repo_root(root) if base is None else base

    def within(p: Column) -> Column:
        whole = F.when(p.startswith("/") | p.rlike("^[A-Za-z]:/"), p).otherwise(F.concat_ws("/", root, p))
        rest = let(F.struct(_folded(whole).alias("inside"), base.alias("base")), lambda x: F.when(x["inside"].startswith(F.concat(x["base"], F.lit("/"))), F.substr(x["inside"], F.length(x["base"]) + 2)))
        return F.when(~p.rlike("^[A-Za-z][A-Za-z0-9+.-]+:") | p.rlike("^[A-Za-z]:/"), F.nullif(rest, F.lit("")))

    return let(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "^file://(localhost)?", ""), within)


def uuid_of(*keys: Column) -> Column:
    """A stable UUID-shaped id of key fields."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def session_id(raw: Column) -> Column:
    """Known prefixes off; UUIDs in lower case."""
    uuid = F.lower(F.regexp_extract(raw, r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", 0))
    return F.when(uuid != "", uuid).otherwise(F.trim(raw))


def timestamp_of(raw: Column) -> Column:
    """Epoch milliseconds or ISO text."""
    number = F.timestamp_millis(F.when(raw.rlike("^[0-9]{1,18}$"), raw).cast("bigint"))
    return F.coalesce(number, F.when(~raw.rlike("^[0-9]*$"), raw).try_cast("timestamp"))


def path_of_uri(uri: Column) -> Column:
    return F.try_url_decode(F.replace(F.regexp_replace(uri, "^file://(localhost)?", ""), F.lit("+"), F.lit("%2B")))


#: Labels of rows whose model is not known yet. Fixed values.
UNATTRIBUTED, AUTO = "(model not yet attributed)", "Cursor Auto"


def _effort(raw: Column) -> Column:
    e = F.regexp_replace(raw, "^-+|-+$", "")
    turned = F.when(e.isin("high-thinking", "low-thinking"), F.concat(F.lit("thinking-"), F.split_part(e, F.lit("-"), F.lit(1)))).otherwise(e)
    return F.when(~e.isin("", "default"), turned)


def display_model(m: Column) -> Column:
    """struct(name, effort, placeholder): family and version, what follows them, and whether the model is not known yet.

    Names of other families stay as they are."""
    part = lambda pattern, k: F.regexp_extract(m, pattern, k)
    new = "^claude-(opus|sonnet|haiku)-([0-9]+)(?:-([0-9]+))?(?:-[0-9]+)*(?:-(.*))?$"
    old = "^claude-([0-9.]+)-(opus|sonnet|haiku)(?:-(.*))?$"
    gpt = "^gpt-([0-9.]+)(?:-(.*))?$"
    tail = part(gpt, 2)
    codex = tail.startswith("codex")
    behind = F.substr(tail, F.lit(6))
    made = lambda name, effort, placeholder=False: F.struct(name.alias("name"), effort.cast("string").alias("effort"), F.lit(placeholder).alias("placeholder"))
    version = F.concat_ws(".", part(new, 2), F.nullif(part(new, 3), F.lit("")))
    return (
        F.when(m == "(untagged)", made(F.lit(UNATTRIBUTED), F.lit(None), True))
        .when(m == "default", made(F.lit(AUTO), F.lit(None), True))
        .when(part(new, 1) != "", made(F.concat(F.lit("Claude "), F.initcap(part(new, 1)), F.lit(" "), version), _effort(part(new, 4))))
        .when(part(old, 2) != "", made(F.concat(F.lit("Claude "), F.initcap(part(old, 2)), F.lit(" "), part(old, 1)), _effort(part(old, 3))))
        .when((part(gpt, 1) != "") & codex, made(F.concat(F.lit("GPT-"), part(gpt, 1), F.lit(" Codex")), F.when((behind == "") | behind.startswith("-"), _effort(behind)).otherwise(behind)))
        .when(part(gpt, 1) != "", made(F.concat(F.lit("GPT-"), part(gpt, 1)), _effort(tail)))
        .otherwise(made(m, F.lit(None)))
    )


def model_label(m: Column) -> Column:
    """The name, with the effort behind a middle dot if there is one."""
    d = display_model(m)
    return F.concat_ws(" · ", d["name"], d["effort"])
