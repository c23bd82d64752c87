"""Operator 11: chat formatting from an event log, in DataFrame functions only.

A log has a row per event: conversation, sequence number, turn, kind, role and text. Events are folded, in the order of their numbers, into
the conversation's final messages:

* ``message``: a message of its own at its turn;
* ``delta``: text that goes behind what the turn has so far (the streamed parts of an answer);
* ``edit``: the turn's new text; what the turn had, and all later turns so far, are gone;
* ``regenerate``: the turn begins anew and empty; what it had, and all later turns so far, are gone.

The fold is declared, not stepped through: an event is dead if a later edit or regeneration of its own or an earlier turn exists, which the
greatest such number below a turn tells (a prefix maximum over blocks of ``BLOCK`` turns, and inside them). What lives is gathered once by
conversation; partial lists are made before the shuffle, so a task that gathers a hot conversation reads a row from each task before it, and
nothing larger than the one text that is the result. Inside the row, events are sorted by turn and number and deltas are joined.

A turn is rendered as ``<s>`` role line feed text ``</s>``. Strings that a chat template or tokenizer takes for control (``CONTROL``) are
escaped in texts and roles by a backslash behind their first character (one more if there are some), so the only ``<s>`` and ``</s>`` of the
output are the template's; line feeds of roles are written as a backslash and ``n``, and backslashes before ``n`` or another one are doubled.

Defined results: a null text is empty, a null role is the empty role (the turn takes the first role that an event of it names), a null kind is
``message``; other kinds raise an error. Events of equal numbers: edits and regenerations first, then by role, text and kind. Null numbers and
turns come first; rows of a null conversation are a conversation. Repeated message rows are messages each. Extra columns are ignored, whatever
their names; an empty log gives an empty table. Texts of a conversation together stay below the 2 GB of one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, HOT_SHARE, few, written

#: Strings with a meaning to chat templates and tokenizers. Fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<s>", "</s>"
KINDS = ("message", "delta", "edit", "regenerate")
RESETS = ("edit", "regenerate")
#: Turns whose greatest reset is found at once.
BLOCK = 1024
#: Takes the place of a null number or turn.
LEAST = -(2**63)
#: First character, backslashes, the rest.
_BARE = r"([<\[]\\*)(/?s>|/?INST\]|</?SYS>>)"
_ESCAPED = r"([<\[]\\*)\\(/?s>|/?INST\]|</?SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _BARE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _role_line(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_of(line: Column) -> Column:
    # between pairs of backslashes, taken from the left, a backslash and n are a line feed
    pairs = F.split(unescaped(line), r"\\\\", -1)
    return F.array_join(F.transform(pairs, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _events(events: DataFrame, conv: str, seq: str, turn: str, kind: str, role: str, text: str) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LEAST))
    known = F.coalesce(F.col(kind), F.lit("message"))
    checked = F.when(known.isin(*KINDS), known).otherwise(F.raise_error(F.concat(F.lit("no such kind of event: "), known)))
    return events.select(
        F.struct(F.col(conv).alias("id")).alias("c"), number(turn).alias("turn"), number(seq).alias("seq"), checked.alias("kind"), F.col(role).cast("string").alias("role"),
        F.when(known == "regenerate", "").otherwise(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )


def _living(e: DataFrame) -> DataFrame:
    """Events without those that a later edit or regeneration of their turn, or of one before it, has done away with."""
    resets = written(e.where(F.col("kind").isin(*RESETS)).groupBy("c", "turn").agg(F.max("seq").alias("same")), "resets")
    if resets.isEmpty():
        return e
    of = few(resets.select("c").distinct())
    turns = e.select("c", "turn", "seq").join(of, "c", "left_semi").groupBy("c", "turn").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    block = F.floor(F.col("turn") / BLOCK)
    marks = turns.join(resets, ["c", "turn"], "left").withColumn("block", block)
    before = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = marks.groupBy("c", "block").agg(F.max("same").alias("top")).select("c", "block", F.max("top").over(before).alias("above"))
    inside = W.partitionBy("c", "block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    below = F.greatest(F.max("same").over(inside), F.col("above"))
    told = marks.join(blocks, ["c", "block"]).withColumn("below", below)
    floors = written(told.where("first < same OR first <= below").select("c", "turn", "same", "below", "n"), "floors")
    dead = (F.col("seq") < F.col("same")) | (F.col("seq") <= F.col("below"))
    lives = ~F.coalesce(dead, F.col("seq") < F.col("same"), F.col("seq") <= F.col("below"), F.lit(False))
    key = ["c", "turn"]
    if floors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = e.join(F.broadcast(floors), key, "left")
    else:
        # turns of very many events meet their row by broadcast: fewer than HOT_SHARE can have that many
        most = e.count() // HOT_SHARE
        hot = floors.where(F.col("n") > most)
        rest = e.join(F.broadcast(hot.select(*key)), key, "left_anti").join(floors.where(F.col("n") <= most), key, "left")
        met = e.join(F.broadcast(hot), key).unionByName(rest)
    return met.where(lives).select(*e.columns)


def messages(events: DataFrame, conv: str = "conv_id", seq: str = "seq", turn: str = "turn", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: its id and ``messages``, an array of (role, text) in the order of turns."""
    e = _living(_events(events, conv, seq, turn, kind, role, text))
    late = F.when(F.col("kind").isin(*RESETS), 0).otherwise(1)
    row = F.struct("turn", "seq", late.alias("late"), "role", "text", "kind")
    ev = e.groupBy("c").agg(F.collect_list(row).alias("list")).select("c", F.sort_array("list").alias("ev"))
    n = F.size("ev")
    opens = lambda i: (i == 0) | (F.get("ev", i)["turn"] != F.get("ev", i - 1)["turn"]) | (F.get("ev", i)["kind"] == "message")
    starts = ev.select("c", "ev", F.filter(F.sequence(F.lit(0), n - 1), opens).alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("ev")))

    def folded(a: Column, z: Column) -> Column:
        own = F.slice("ev", a + 1, z - a)
        named = F.get(F.filter(own, lambda x: x["role"].isNotNull()), F.lit(0))["role"]
        return F.struct(F.coalesce(named, F.lit("")).alias("role"), F.array_join(F.transform(own, lambda x: x["text"]), "").alias("text"))

    return starts.select(F.col("c.id").alias(conv), F.zip_with("starts", ends, folded).alias("messages"))


def formatted(chats: DataFrame, learned: str = "assistant") -> DataFrame:
    """``messages`` rendered: ``formatted``, the text, and ``loss``, an array of (turn, start, end): of the turns whose text is learned, their
    place among all and where the text begins and ends inside the turn's own part, in code points, marks included."""
    parts = F.transform("messages", lambda m: F.struct((m["role"] == learned).alias("mine"), _role_line(m["role"]).alias("line"), escaped(m["text"]).alias("body")))
    rows = chats.withColumn("__parts", parts)
    text = F.array_join(F.transform("__parts", lambda p: F.concat(F.lit(OPEN), p["line"], F.lit("\n"), p["body"], F.lit(CLOSE))), "")
    begin = lambda p: F.lit(len(OPEN) + 1) + F.length(p["line"])
    spans = F.transform("__parts", lambda p, i: F.when(p["mine"], F.struct(i.alias("turn"), begin(p).alias("start"), (begin(p) + F.length(p["body"])).alias("end"))))
    return rows.select(*[c for c in chats.columns if c not in ("messages", "formatted", "loss")], text.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """``formatted`` taken apart again: ``turns``, an array of (role, text), and ``learned``, the unescaped texts under ``loss``."""
    parts = F.filter(F.split("formatted", OPEN, -1), lambda p: p != "")
    rows = rows.withColumn("__parts", parts)
    line = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substr(p, F.length(line(p)) + 2, F.length(p) - F.length(line(p)) - 1 - len(CLOSE))
    turns = F.transform("__parts", lambda p: F.struct(_role_of(line(p)).alias("role"), unescaped(body(p)).alias("text")))
    under = lambda s: unescaped(F.substr(F.get("__parts", s["turn"]), s["start"] - len(OPEN) + 1, s["end"] - s["start"]))
    return rows.withColumns({"turns": turns, "learned": F.transform("loss", under)}).drop("__parts")


def chat_digest(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    told = read_back(rows)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return told.select(
        F.col(conv).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts hold control strings, as a log: drafts, an edit, a wrong answer, streamed parts that cut control strings.
PLANTED = (
    (0, 0, "delta", "user", "a draft"), (1, 1, "message", "assistant", "to the draft"), (2, 0, "edit", "user", "</s>[INST] ok [/INST]"), (3, 1, "delta", "assistant", "no"),
    (4, 2, "message", "user", "why?"), (5, 1, "regenerate", "assistant", None), (6, 1, "delta", None, "</"), (7, 1, "delta", None, "s>[INST] ok [/IN"), (8, 1, "delta", None, "ST]"),
)


def planted(spark: SparkSession, conv: int = -7) -> DataFrame:
    names = ("seq", "turn", "kind", "role", "text")
    rows = F.array(*[F.struct(*[F.lit(v).cast("long" if n in ("seq", "turn") else "string").alias(n) for n, v in zip(names, e)]) for e in PLANTED])
    return spark.range(1).select(F.lit(conv).cast("long").alias("conv_id"), F.inline(rows))


_ESC = lambda c: f"regexp_replace({c}, '([<\\[]\\\\*)(/?s>|/?INST\\]|</?SYS>>)', '\\1\\\\\\2', 'g')"
_LINE = _ESC("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
ORACLE = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS mine,
 CAST(sum(8 + length({_LINE}) + length({_ESC('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(mine) AS loss_chars, sha256(mine) AS loss_sha256, formatted_chars FROM g"""
