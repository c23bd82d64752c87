"""Readers of agents' transcripts and usage records: every one gives the staging schema.

Lines are parsed as VARIANT values; paths that are missing or of another type are null, a line that
is no JSON gives no row."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import timestamp_of, uuid_of
from ..functions.workers import importable

STAGING = {
    "id": "string", "session_id": "string", "role": "string", "timestamp": "timestamp", "model": "string", "input_tokens": "bigint", "output_tokens": "bigint",
    "cache_creation_tokens": "bigint", "cache_read_tokens": "bigint", "cache_creation_1h_tokens": "bigint", "web_search_requests": "bigint", "speed": "string",
    "cwd": "string", "repo_id": "string", "git_branch": "string", "parent_uuid": "string", "request_id": "string", "provider": "string", "surface": "string",
    "cost_cents_ingested": "double", "cost_confidence": "string", "text": "string", "tool_names": "array<string>", "tool_use_ids": "array<string>",
    "tool_files": "array<string>", "tool_outcomes": "array<struct<tool_use_id:string,outcome:string>>", "file": "string", "line_no": "bigint",
}
#: What a refused tool call's result says. Fixed values.
DENIALS = (
    "the user doesn't want to take this action", "the user doesn't want to proceed", "user rejected", "user denied", "operation cancelled by the user",
    "operation canceled by the user", "permission denied by user",
)
#: Splits of files whose numbers are broadcast; more of them meet their lines by a shuffle.
SMALL_ROWS = 200_000
#: Characters of a result that are looked at.
RESULT_CHARS = 2048
BLOCK = "struct<type:string,id:string,name:string,text:string,tool_use_id:string,is_error:variant,input:variant,content:variant>"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line_no, value of all complete lines; what follows a file's last line feed is left for a later read.

    Files are read split by split."""
    return numbered(raw_lines(spark.read, paths))


def raw_lines(reader, paths: str | list[str]) -> DataFrame:
    """Lines with their file, its size and the start of their split, from a batch or a streaming reader."""
    meta = {"file": "file_path", "block": "file_block_start", "size": "file_size"}
    text = reader.format("text").option("lineSep", "\n").load(paths)
    return text.select("value", *[F.col(f"_metadata.{c}").alias(n) for n, c in meta.items()])


def _splits(rows: DataFrame) -> DataFrame:
    """Per (file, block): the number of its first line, the place of that line in its task, and the place of a line that is not complete."""
    own = rows.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("value").cast("bigint") + 1).alias("bytes"), F.max("size").alias("size"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    order = W.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plain = ~F.lower("file").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$")  # the size of a compressed file tells nothing of its lines
    open_ = plain & (F.sum("bytes").over(W.partitionBy("file")) > F.col("size")) & F.lead("block").over(order).isNull()
    return own.select("file", "block", (before - F.col("first")).alias("shift"), F.when(open_, F.col("last")).alias("open"))


def numbered(raw: DataFrame) -> DataFrame:
    """file, line_no, value of ``raw_lines``, in the order of the file; blank lines count, but give no row.

    Two passes: the first counts lines and bytes of each split of a file and adds them up in the order of splits, one row each; in the
    second a line's number is that of its split's first line and its place in the split, which is read by one task. No file's lines come
    together. ``raw`` has to be read from files that do not change in between, or to tell the order itself (``at``). A file whose lines, with a line feed each, are longer
    than the file does not end with a line feed: its last line is not complete."""
    rows = raw if "at" in raw.columns else raw.withColumn("at", F.monotonically_increasing_id())
    splits = _splits(rows)
    few = splits.limit(SMALL_ROWS + 1).collect()  # SMALL_ROWS at most: counted once, where the plan would run the first pass twice
    if len(few) <= SMALL_ROWS:
        splits = F.broadcast(raw.sparkSession.createDataFrame(few, splits.schema))
    met = rows.join(splits, ["file", "block"]).where(~F.col("at").eqNullSafe(F.col("open")) & (F.trim("value") != ""))
    return met.select("file", (F.col("at") + F.col("shift")).alias("line_no"), "value")


def _held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` computed once a row: what a generator makes is not computed again by each filter and column that uses it."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def _parsed(rows: DataFrame) -> DataFrame:
    return _held(rows, "v", F.try_parse_json("value")).where("v IS NOT NULL")


def get(path: str, kind: str = "string", v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def first(*paths: str, kind: str = "string", v: str = "v") -> Column:
    return F.coalesce(*[get(p, kind, v) for p in paths])


def tokens(*paths: str) -> Column:
    return F.greatest(F.coalesce(first(*paths, kind="bigint"), F.lit(0)), F.lit(0))


def staged(rows: DataFrame, provider: str | None, **columns: Column) -> DataFrame:
    """``columns`` under the staging schema; the rest is null, tokens are 0."""
    out = []
    for name, kind in STAGING.items():
        c = columns.get(name)
        if c is None and name in ("file", "line_no") and name in rows.columns:
            c = F.col(name)
        if c is None and name == "provider" and provider:
            c = F.lit(provider)
        if c is None:
            c = F.lit(0) if name.endswith("_tokens") or name == "web_search_requests" else F.lit(None)
        out.append(c.cast(kind).alias(name))
    return rows.select(*out)


def outcome_of(is_error: Column, text: Column) -> Column:
    low = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(RESULT_CHARS)))
    denied = F.lit(False)
    for d in DENIALS:
        denied = denied | low.contains(d)
    return F.when(denied, "denied").when(F.coalesce(is_error, F.lit(False)), "error").otherwise("success")


def tool_files(blocks: Column) -> Column:
    """File arguments of tool uses, in order: which argument depends on the tool."""
    arg = lambda b, *names: F.array(*[F.try_variant_get(b["input"], f"$.{n}", "string") for n in names])

    def of(b: Column) -> Column:
        name = F.lower(F.trim(b["name"]))
        out = arg(b, "target_file", "file_path")
        for tools, names in (
            (("glob_file_search",), ("path", "glob_pattern", "pattern")),
            (("grep_search",), ("path", "include_pattern")),
            (("read_file", "edit_file", "write_file", "search_replace", "delete_file", "file_search", "apply_patch"), ("target_file", "file_path", "path", "filePath")),
            (("glob",), ("path", "pattern")),
            (("grep", "codebase_search"), ("path",)),
            (("notebookread", "notebookedit"), ("notebook_path", "file_path")),
            (("read", "write", "edit", "multiedit"), ("file_path",)),
        ):
            out = F.when(name.isin(*tools), arg(b, *names)).otherwise(out)
        return out

    return F.filter(F.flatten(F.transform(blocks, of)), lambda x: x.isNotNull() & (F.trim(x) != ""))


_USAGE = "struct<input_tokens:string,output_tokens:string,cache_creation_input_tokens:string,cache_read_input_tokens:string,speed:string,cache_creation:struct<ephemeral_1h_input_tokens:string>,server_tool_use:struct<web_search_requests:string>>"
#: A line with all that is read of it. Contents are of any kind, a text or a list of blocks and others; they are kept as values.
_ENVELOPE = (
    "type string, role string, uuid string, sessionId string, session_id string, timestamp string, cwd string, gitBranch string, parentUuid string, model string, id string, content variant, "
    f"usage {_USAGE}, message struct<id:string,model:string,content:variant,usage:{_USAGE}>"
)


def _listed(c: Column) -> Column:
    """The elements of a value that is a list."""
    return F.try_variant_get(c, "$", "array<variant>")


def _text(c: Column) -> Column:
    """A value that is a text."""
    return F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))


def _flag(c: Column) -> Column:
    """A value that is true or false."""
    return F.when(F.schema_of_variant(c) == "BOOLEAN", F.try_variant_get(c, "$", "boolean"))


def _result_text(c: Column) -> Column:
    """What a tool's result says: its text, or the texts of a list."""
    each = F.transform(_listed(c), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), _text(x)))
    return F.coalesce(F.array_join(each, " "), _text(c))


def _count(*fields: str) -> Column:
    """The first of the fields that holds a number, as whole tokens."""
    whole = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.col(c).try_cast("double").try_cast("bigint"))
    return F.greatest(F.coalesce(*[whole(c) for c in fields], F.lit(0)), F.lit(0))


def envelope(rows: DataFrame, provider: str = "claude_code") -> DataFrame:
    """Transcript lines: user and assistant envelopes, and flat sub-agent lines that name a role instead of a type.

    A line is parsed once, by one schema. Content that is a list gives its blocks, the objects in it with a type, whatever stands beside
    them; content that is a text stays one, also if it looks like a list."""
    v = _held(rows.where(F.rtrim("value", F.lit(" \t\r\n")).endswith("}")), "v", F.from_json("value", _ENVELOPE))
    role = F.when(F.col("v.type").isin("user", "assistant"), F.col("v.type")).when(F.col("v.type").isNull() & F.col("v.role").isin("user", "assistant"), F.col("v.role"))
    v = v.withColumn("role", role).where("role IS NOT NULL")
    said = F.coalesce("v.message.content", "v.content")
    blocks = F.filter(F.transform(_listed(F.col("said")), lambda x: F.try_variant_get(x, "$", BLOCK)), lambda b: b["type"].isNotNull())
    v = _held(v.withColumn("said", said), "blocks", F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>")))
    v = _held(v, "uses", F.filter("blocks", lambda b: b["type"] == "tool_use"))
    v = _held(v, "at", timestamp_of(F.col("v.timestamp"))).where("at IS NOT NULL")
    uses = F.col("uses")
    results = F.filter("blocks", lambda b: (b["type"] == "tool_result") & (F.trim(b["tool_use_id"]) != ""))
    u = lambda name: _count(f"v.message.usage.{name}", f"v.usage.{name}")
    spoken = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    mine = F.col("role") == "assistant"
    out = staged(
        v, provider,
        id=F.col("v.uuid"), session_id=F.coalesce("v.sessionId", "v.session_id"), role=F.col("role"), timestamp=F.col("at"),
        model=F.when(mine, F.coalesce("v.message.model", "v.model")),
        input_tokens=F.when(mine, u("input_tokens")).otherwise(0), output_tokens=F.when(mine, u("output_tokens")).otherwise(0),
        cache_creation_tokens=F.when(mine, u("cache_creation_input_tokens")).otherwise(0), cache_read_tokens=F.when(mine, u("cache_read_input_tokens")).otherwise(0),
        cache_creation_1h_tokens=u("cache_creation.ephemeral_1h_input_tokens"), web_search_requests=u("server_tool_use.web_search_requests"),
        speed=F.coalesce("v.message.usage.speed", "v.usage.speed"), cwd=F.col("v.cwd"), git_branch=F.col("v.gitBranch"), parent_uuid=F.col("v.parentUuid"),
        request_id=F.when(mine, F.coalesce("v.message.id", "v.id")), text=F.when(~mine, F.coalesce(F.nullif(spoken, F.lit("")), _text(F.col("said")))),
        tool_names=F.transform(uses, lambda b: F.trim(b["name"])), tool_use_ids=F.transform(uses, lambda b: F.trim(b["id"])), tool_files=tool_files(uses),
        tool_outcomes=F.transform(results, lambda b: F.struct(F.trim(b["tool_use_id"]).alias("tool_use_id"), outcome_of(_flag(b["is_error"]), _result_text(b["content"])).alias("outcome"))),
    )
    return out.where("id IS NOT NULL AND NOT (role = 'assistant' AND coalesce(model, '') = '<synthetic>')")


def _running(c: str, *more: str) -> Column:
    return F.last(F.col(c), ignorenulls=True).over(W.partitionBy("file", *more).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))


def token_counts(rows: DataFrame, provider: str = "codex") -> DataFrame:
    """Token-count events under the session, cwd, branch and model that went before; events without tokens are dropped."""
    v = _parsed(rows).withColumn("kind", get("$.type"))
    meta = F.col("kind") == "session_meta"
    v = v.withColumns({"m": F.when(F.col("kind") == "turn_context", get("$.payload.model")), "s": F.when(meta, get("$.payload.id")), "c": F.when(meta, get("$.payload.cwd")), "b": F.when(meta, get("$.payload.git.branch"))})
    v = v.withColumns({x: _running(x) for x in "mscb"}).where((F.col("kind") == "event_msg") & (get("$.payload.type") == "token_count"))
    last = "$.payload.info.last_token_usage."
    cached = tokens(last + "cached_input_tokens")
    out = staged(
        v, provider,
        id=uuid_of(F.lit(provider), F.col("s"), get("$.timestamp"), F.col("line_no")), session_id=F.col("s"), role=F.lit("assistant"), timestamp=timestamp_of(get("$.timestamp")), model=F.col("m"),
        input_tokens=F.greatest(tokens(last + "input_tokens") - cached, F.lit(0)), output_tokens=tokens(last + "output_tokens"), cache_read_tokens=cached, cwd=F.col("c"), git_branch=F.col("b"),
    )
    return out.where("input_tokens + output_tokens + cache_read_tokens > 0")


def turn_usage(rows: DataFrame, provider: str = "copilot", workspaces: DataFrame | None = None) -> DataFrame:
    """Usage events under the model of their turn; counts stand at data or at data.usage."""
    v = _parsed(rows).withColumn("kind", get("$.type"))
    v = v.withColumn("m", F.coalesce(F.when(F.col("kind").isin("assistant.turn_start", "assistant.usage"), get("$.data.model")), F.when(F.col("kind") == "session.model_change", get("$.data.newModel"))))
    v = v.withColumn("m", _running("m")).where("kind = 'assistant.usage'")
    u = lambda *n: tokens(*[f"$.data.{x}" for x in n], *[f"$.data.usage.{x}" for x in n])
    session = F.coalesce(first("$.data.sessionId", "$.sessionId"), F.regexp_extract("file", r"([^/]+)/[^/]*$", 1))
    cached = u("cached_input_tokens", "cacheReadTokens")
    out = staged(
        v, provider,
        id=F.coalesce(first("$.id"), uuid_of(F.lit(provider), session, get("$.timestamp"), F.col("line_no"))), session_id=session, role=F.lit("assistant"), timestamp=timestamp_of(get("$.timestamp")), model=F.col("m"),
        input_tokens=F.greatest(u("input_tokens", "inputTokens") - cached, F.lit(0)), output_tokens=u("output_tokens", "outputTokens"), cache_read_tokens=cached,
    ).where("input_tokens + output_tokens + cache_read_tokens > 0")
    if workspaces is None:
        return out
    w = workspaces.select(F.col("session_id").alias("__s"), F.col("cwd").alias("__c"), F.col("git_branch").alias("__b"))
    met = out.join(w, out["session_id"] == w["__s"], "left")
    return met.withColumns({"cwd": F.coalesce("cwd", "__c"), "git_branch": F.coalesce("git_branch", "__b")}).select(*STAGING)


def start_stop(rows: DataFrame, provider: str = "jetbrains_ai_assistant") -> DataFrame:
    """One row per message_stop; the model comes from the stop, else from the start of the same message."""
    v = _parsed(rows).withColumns({"kind": get("$.type"), "mid": first("$.id", "$.message.id")})
    v = v.withColumn("m", first("$.model", "$.message.model")).withColumn("m", _running("m", "mid")).where("kind = 'message_stop'")
    u = lambda n: tokens(f"$.usage.{n}", f"$.message.usage.{n}")
    return staged(
        v, provider,
        id=F.coalesce("mid", uuid_of(F.lit(provider), F.col("file"), F.col("line_no"))), session_id=first("$.session_id", "$.sessionId"), role=F.lit("assistant"), timestamp=timestamp_of(get("$.timestamp")), model=F.col("m"),
        input_tokens=u("input_tokens"), output_tokens=u("output_tokens"), cache_creation_tokens=u("cache_creation_input_tokens"), cache_read_tokens=u("cache_read_input_tokens"), request_id=F.col("mid"), surface=F.lit("jetbrains"),
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens > 0")


def request_tokens(v: str = "v") -> Column:
    """struct(i, o) of the first of the known shapes that has both counts, or of one that only tells the output."""
    n = lambda p: get(p, "bigint", v)
    both = lambda i, o: F.when((n(i) > 0) & (n(o) > 0), F.struct(n(i).alias("i"), n(o).alias("o")))
    return F.coalesce(
        both("$.result.metadata.promptTokens", "$.result.metadata.outputTokens"),
        both("$.result.usage.promptTokens", "$.result.usage.completionTokens"),
        both("$.usage.prompt_tokens", "$.usage.completion_tokens"),
        both("$.promptTokens", "$.completionTokens"),
        F.when(n("$.completionTokens") > 0, F.struct(F.lit(0).cast("bigint").alias("i"), n("$.completionTokens").alias("o"))),
    )


def request_model(price_list: DataFrame, agents: DataFrame, rows: DataFrame, v: str = "v") -> DataFrame:
    """``rows`` with model: the resolved one if it is priced, else the declared one without its prefix; ``auto`` through the agent's model."""
    declared = F.regexp_replace(F.coalesce(get("$.modelId", "string", v), F.lit("")), "^(copilot|github\\.copilot-chat)/", "")
    rows = rows.withColumns({"__resolved": get("$.result.metadata.resolvedModel", "string", v), "__declared": declared, "__agent": get("$.agent.id", "string", v)})
    p, a = price_list.select(F.col("model").alias("__priced")).distinct(), agents.select(F.col("agent_id").alias("__a"), F.col("model").alias("__by_agent"))
    rows = rows.join(p, (F.col("__resolved") == F.col("__priced")) & F.col("__resolved").rlike("^[a-z0-9.-]+$"), "left").join(a, F.col("__agent") == F.col("__a"), "left")
    own = F.when(F.col("__declared").isin("", "auto"), F.col("__by_agent")).otherwise(F.col("__declared"))
    return rows.withColumn("model", F.coalesce("__priced", own)).drop("__resolved", "__declared", "__agent", "__priced", "__a", "__by_agent")


def _slot(state: list, path: list) -> tuple | None:
    """(container, key, whether it was there) of the place that ``path`` names below ``state[0]``; what lacks on the way is made, and
    replaced where a number meets no list or a name no object. None for a path with other steps."""
    holder, key, there = state, 0, True
    for step in path:
        kind = dict if isinstance(step, str) else list if isinstance(step, int) and not isinstance(step, bool) and step >= 0 else None
        if kind is None:
            return None
        if not isinstance(holder[key], kind):
            holder[key] = kind()
        holder, key = holder[key], step
        there = key in holder if kind is dict else key < len(holder)
        if not there:
            holder.update({key: None}) if kind is dict else holder.extend([None] * (key + 1 - len(holder)))
    return holder, key, there


def _mutated(state: list, line: dict) -> None:
    """One line of a mutation log on ``state[0]``: 0 puts in the keys it has, 1 sets at a path, 2 appends at a path (none: requests)."""
    kind, value, path = line.get("kind"), line.get("v"), line.get("k")
    path = path if isinstance(path, list) else None
    if isinstance(kind, bool) or "v" not in line:
        return
    if kind == 0 and isinstance(value, dict) and isinstance(state[0], dict):
        state[0].update(value)
    elif kind == 1 and path is not None:
        if at := _slot(state, path):
            at[0][at[1]] = value
    elif kind == 2 and isinstance(value, list):
        if at := _slot(state, path or ["requests"]):
            holder, key, there = at
            if not there:
                holder[key] = []
            if isinstance(holder[key], list):
                holder[key].extend(value)


#: Lines of a log that are compacted together.
CHUNK_LINES = 20_000


def _is_mutation(line: dict) -> bool:
    return isinstance(line.get("kind"), int) and not isinstance(line.get("kind"), bool)


def _set_path(line: dict) -> tuple | None:
    """The path of a line that only sets a place below a name."""
    path = line.get("k")
    fine = line.get("kind") == 1 and "v" in line and isinstance(path, list) and path and isinstance(path[0], str)
    steps = fine and all(isinstance(x, (str, int)) and not isinstance(x, bool) and (isinstance(x, str) or x >= 0) for x in path)
    return tuple(path) if steps else None


def _compacted(rows: list[tuple[int, dict]]) -> list[tuple[int, dict]]:
    """Lines in order that leave the same state as ``rows``, whatever the state before them.

    Of sets below one name, without a line between that reads lengths or presence there (an append, a snapshot, anything else), those go that
    a later one overwrites: at the same place or above it. Appends at one place with nothing of that name between become one."""
    kept: dict[int, tuple[int, dict]] = {}
    runs: dict[str, dict] = {}  # by name: paths set since the last other line, as a tree whose leaves are numbers of lines
    tails: dict[str, int] = {}  # by name: the number of the append that was the last line there

    def overwritten(tree) -> None:
        for n in [tree] if isinstance(tree, int) else [x for x in tree.values()]:
            if isinstance(n, int):
                kept.pop(n, None)
            else:
                overwritten(n)

    for n, (at, line) in enumerate(rows):
        kept[n] = (at, line)
        path = _set_path(line)
        if path is not None:
            tails.pop(path[0], None)
            tree = runs.setdefault(path[0], {})
            for step in path[1:]:
                tree = tree.setdefault((type(step).__name__, step), {})
            overwritten(tree)
            tree.clear()
            tree["last"] = n
            continue
        where = line.get("k") if isinstance(line.get("k"), list) else []
        name = (where or ["requests"])[0]
        if line.get("kind") == 2 and isinstance(name, str):
            runs.pop(name, None)
            old = tails.get(name)
            if old is not None and isinstance(line.get("v"), list) and (kept[old][1].get("k") or ["requests"]) == (where or ["requests"]):
                kept[old] = (kept[old][0], {**kept[old][1], "v": kept[old][1]["v"] + line["v"]})
                del kept[n]
            elif isinstance(line.get("v"), list):
                tails[name] = n
            else:
                tails.pop(name, None)
        else:
            runs, tails = {}, {}
    return [kept[n] for n in sorted(kept)]


def _path_session(file: str) -> str | None:
    """A log in a folder of chat sessions is named after its session."""
    folder, _, name = file.rpartition("/")
    return name.rsplit(".", 1)[0] if folder.rpartition("/")[2].lower() == "chatsessions" else None


def _flat_records(line) -> list:
    for key in ("v", "requests", "messages"):
        if isinstance(line, dict) and isinstance(line.get(key), list):
            return line[key]
    return [line]


def folded_requests(rows: DataFrame) -> DataFrame:
    """(file, idx, session_id, v): each request of a mutation log in its last state.

    Lines patch a document at paths of any depth, each upon the state that the lines before it left. Stretches of a log are compacted first,
    each by itself, to lines that leave the same state, so a large file is read and parsed by many tasks; then a task goes through the
    lines that are left of its files one by one and holds the state of one file. A log in a ``chatSessions`` folder has its name for a session
    until it tells another. Lines without a kind are records themselves, under the session known by then; their idx follows the line."""

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(key: tuple, lines: list) -> pd.DataFrame:
            out = [(key[0], at, json.dumps(line)) for at, line in _compacted(lines)]
            return pd.DataFrame(out, columns=["file", "line_no", "value"])

        own, lines = None, []
        for batch in batches:
            for f, chunk, at, value in zip(batch["file"], batch["chunk"], batch["line_no"], batch["value"]):
                if (f, chunk) != own:
                    if lines:
                        yield told(own, lines)
                    own, lines = (f, chunk), []
                try:
                    line = json.loads(value)
                except ValueError:
                    continue
                if isinstance(line, (dict, list)):
                    lines.append((at, line if isinstance(line, dict) else {"requests": line}))
        if lines:
            yield told(own, lines)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "idx", "session_id", "item"]

        def text(x) -> str | None:
            return x if isinstance(x, str) else None

        def told(file: str, state: list, flat: list) -> pd.DataFrame:
            doc = state[0] if isinstance(state[0], dict) else {}
            made = doc.get("requests")
            own = [(file, k, text(doc.get("sessionId")), json.dumps(r)) for k, r in enumerate(made if isinstance(made, list) else []) if isinstance(r, dict)]
            return pd.DataFrame(own + flat, columns=columns)

        file, state, flat = None, [{}], []
        for batch in batches:
            for f, at, value in zip(batch["file"], batch["line_no"], batch["value"]):
                if f != file:
                    if file is not None:
                        yield told(file, state, flat)
                    session = _path_session(f)
                    file, state, flat = f, [{} if session is None else {"sessionId": session}], []
                line = json.loads(value)
                if _is_mutation(line):
                    _mutated(state, line)
                else:
                    doc = state[0] if isinstance(state[0], dict) else {}
                    flat += [(f, (at + 1) * 1_000_000 + k, text(doc.get("sessionId")), json.dumps(r)) for k, r in enumerate(_flat_records(line), 1) if isinstance(r, dict)]
        if file is not None:
            yield told(file, state, flat)

    importable(rows.sparkSession)
    stretch = F.floor(F.col("line_no") / CHUNK_LINES).alias("chunk")
    dealt = rows.select("file", stretch, "line_no", "value").repartition("file", "chunk").sortWithinPartitions("file", "chunk", "line_no")
    short = dealt.mapInPandas(compact, "file string, line_no bigint, value string")
    ordered = short.repartition("file").sortWithinPartitions("file", "line_no")
    made = ordered.mapInPandas(fold, "file string, idx bigint, session_id string, item string")
    return made.select("file", "idx", "session_id", F.try_parse_json("item").alias("v"))


def chat_requests(requests: DataFrame, provider: str = "copilot_chat") -> DataFrame:
    """A user row and an assistant row for each request (file, session_id, v, model) that has its token counts."""
    n = lambda c: F.coalesce(c, F.lit(0))
    counted = _held(requests, "t", request_tokens()).where("t IS NOT NULL")
    counted = _held(counted, "at", timestamp_of(get("$.timestamp"))).where("at IS NOT NULL")
    key = F.coalesce(get("$.requestId"), uuid_of(F.lit(provider), F.col("file"), get("$.timestamp")))
    roles = F.explode(F.array(F.lit("user"), F.lit("assistant")))
    rows = counted.select("*", key.alias("key"), get("$.message.text").alias("said"), roles.alias("r"))
    mine = F.col("r") == "assistant"
    user = F.concat(F.col("key"), F.lit("-user"))
    return staged(
        rows, provider,
        id=F.when(mine, F.col("key")).otherwise(user), session_id=F.col("session_id"), role=F.col("r"), timestamp=F.col("at"), model=F.when(mine, F.col("model")) if "model" in requests.columns else None,
        input_tokens=F.when(mine, n(F.col("t.i"))).otherwise(0), output_tokens=F.when(mine, n(F.col("t.o"))).otherwise(0), request_id=F.when(mine, F.col("key")), parent_uuid=F.when(mine, user), text=F.when(~mine, F.col("said")),
    )


def chat_documents(files: DataFrame) -> DataFrame:
    """Requests of whole JSON documents (file, value): an array, or an object with requests."""
    items = F.coalesce(get("$.requests", "array<variant>"), _listed(F.col("v")))
    # a text is read as JSON itself
    of = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_parse_json(F.try_variant_get(x, "$", "string"))).when(~F.is_variant_null(x), x)
    each = _parsed(files).select("file", get("$.sessionId").alias("session_id"), F.posexplode_outer(F.transform(items, of)).alias("idx", "v"))
    return each.where("idx IS NOT NULL")


def usage_events(rows: DataFrame, provider: str = "cursor") -> DataFrame:
    """Usage-export events: exact cents, below 0 counted as 0, above 100 000 dropped, as are events without tokens and cost."""
    v = _parsed(rows)
    cents = F.greatest(F.coalesce(get("$.tokenUsage.totalCents", "double"), F.lit(0.0)), F.lit(0.0))
    out = staged(
        v, provider,
        id=uuid_of(F.lit(provider), first("$.timestamp"), first("$.model"), *[first(f"$.tokenUsage.{x}") for x in ("inputTokens", "outputTokens", "cacheWriteTokens", "cacheReadTokens")]), role=F.lit("assistant"), timestamp=timestamp_of(first("$.timestamp")), model=first("$.model"),
        input_tokens=tokens("$.tokenUsage.inputTokens"), output_tokens=tokens("$.tokenUsage.outputTokens"), cache_creation_tokens=tokens("$.tokenUsage.cacheWriteTokens"), cache_read_tokens=tokens("$.tokenUsage.cacheReadTokens"),
        cost_cents_ingested=cents, cost_confidence=F.lit("exact"), surface=F.lit("cursor"),
    )
    return out.where("cost_cents_ingested <= 100000 AND (cost_cents_ingested > 0 OR input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens > 0)")


def conversation_store(rows: DataFrame, headers: DataFrame, newest_ms: int | None = None, default_model: str = "auto", provider: str = "cursor") -> DataFrame:
    """Key/value rows ``bubbleId:<conversation>:<message>``: time from the row, else from the conversation's header; only those after ``newest_ms``."""
    v = _parsed(rows.where("length(key) = 82 AND key LIKE 'bubbleId:%'")).withColumns({"conv": F.substring("key", 10, 36), "mid": F.substring("key", 47, 36)})
    h = headers.select(F.col("conversation_id").alias("conv"), F.col("created_ms").alias("__created"))
    v = v.join(h, "conv", "left").withColumn("at", F.coalesce(timestamp_of(first("$.createdAt")), F.timestamp_millis("__created")))
    if newest_ms is not None:
        v = v.where(F.unix_millis("at") > newest_ms)
    mine = first("$.type", kind="int") == 2
    return staged(
        v, provider,
        id=F.col("mid"), session_id=F.col("conv"), role=F.when(mine, "assistant").otherwise("user"), timestamp=F.col("at"), model=F.when(mine, F.coalesce(F.nullif(first("$.modelInfo.modelName"), F.lit("default")), F.lit(default_model))),
        input_tokens=tokens("$.tokenCount.inputTokens"), output_tokens=tokens("$.tokenCount.outputTokens"), surface=F.lit("cursor"), text=first("$.text"),
    ).where("timestamp IS NOT NULL AND (role = 'user' OR input_tokens + output_tokens > 0)")


def role_lines(rows: DataFrame, provider: str = "cursor") -> DataFrame:
    """Plain role/usage lines; a missing id is made of the line's fields."""
    v = _parsed(rows).withColumn("r", get("$.role")).where("r IN ('user', 'assistant')")
    return staged(
        v, provider,
        id=F.coalesce(first("$.id", "$.uuid"), uuid_of(F.lit(provider), F.col("file"), F.col("line_no"), get("$.timestamp"))), session_id=first("$.sessionId", "$.session_id", "$.conversationId"), role=F.col("r"), timestamp=timestamp_of(first("$.timestamp", "$.createdAt")),
        model=first("$.model"), input_tokens=tokens("$.usage.input_tokens", "$.usage.inputTokens"), output_tokens=tokens("$.usage.output_tokens", "$.usage.outputTokens"), cwd=first("$.cwd"), text=F.when(F.col("r") == "user", first("$.content", "$.text")),
    ).where("timestamp IS NOT NULL")


PRICE = "map<string,struct<input_cost_per_token:double,output_cost_per_token:double,cache_creation_input_token_cost:double,cache_read_input_token_cost:double>>"


def price_list(documents: DataFrame) -> DataFrame:
    """Rows of price-list documents (value): entries without both prices, and the sample entry, are dropped."""
    each = documents.select(F.explode(F.from_json("value", PRICE)).alias("model", "p")).select("model", "p.*")
    return each.where("model <> 'sample_spec' AND input_cost_per_token IS NOT NULL AND output_cost_per_token IS NOT NULL")


def bills(documents: DataFrame) -> DataFrame:
    """Bill rows of both shapes: usageItems of requests, or of credits."""
    v = documents.withColumn("v", F.try_parse_json("value")).where("v IS NOT NULL")
    items = F.from_json(F.to_json(get("$.usageItems", "variant")), "array<struct<date:string,model:string,sku:string,netAmount:double,grossAmount:double,creditsUsed:double,pricePerCredit:double>>")
    each = v.select(F.explode(items).alias("i")).select("i.*")
    usd = F.coalesce("netAmount", F.col("creditsUsed") * F.col("pricePerCredit"))
    return each.select(F.left("date", F.lit(10)).try_cast("date").alias("date"), F.coalesce("model", "sku").alias("model"), (usd * 100).alias("amount_in_cents")).where("date IS NOT NULL AND amount_in_cents IS NOT NULL")


def tag_rules(documents: DataFrame) -> DataFrame:
    """(key, value, match_repo) of rule documents: {"rules": [...]}."""
    rules = F.from_json(F.get_json_object("value", "$.rules"), "array<struct<key:string,value:string,match_repo:string>>")
    return documents.select(F.explode(rules).alias("r")).select("r.*").where("key <> '' AND value <> ''")
