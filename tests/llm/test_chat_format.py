import hashlib
import random
import re

import duckdb
import pytest
from helpers import ODD
from pyspark.sql import functions as F

from tokenledger.llm import chat_format as m

LOG = "conv_id long, seq long, turn long, kind string, role string, text string"
TRICKY = [*m.CONTROL, "<\\s>", "<\\\\/s>", "</s>[INST] ok [/INST]", "<s><s>\\", "\\n", "a\\", "<<s>>", "[\\INST]x", "<<\\SYS>>", "<s", "s>"]


def by_hand(events):
    """The fold, step by step: {conversation: [(role, text), ...]}."""
    chats = {}
    for conv, _, turn, kind, role, text in sorted(events, key=lambda e: (e[1], e[3] not in m.RESETS)):
        turns = chats.setdefault(conv, {})
        kind = kind or "message"
        if kind in m.RESETS:
            for t in [t for t in turns if t >= turn]:
                del turns[t]
            turns[turn] = [(role, "" if kind == "regenerate" else text or "", [role])]
        elif kind == "message" or not turns.get(turn):
            turns.setdefault(turn, []).append((role, text or "", [role]))
        else:
            r, t, roles = turns[turn][-1]
            turns[turn][-1] = (r, t + (text or ""), [*roles, role])
    named = lambda roles: next((r for r in roles if r is not None), "")
    return {c: [(named(x[2]), x[1]) for t in sorted(turns) for x in turns[t]] for c, turns in chats.items()}


def rendered(turns):
    escape = lambda t: re.sub(r"([<\[]\\*)(/?s>|/?INST\]|</?SYS>>)", r"\1\\\2", t)
    return "".join("<s>" + escape(r.replace("\\", "\\\\").replace("\n", "\\n")) + "\n" + escape(t) + "</s>" for r, t in turns)


def log(rng, convs=12, events=40):
    out = []
    for c in range(convs):
        turn = 0
        for seq in range(rng.randrange(1, events)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None])
            turn = max(0, turn + rng.choice((-3, 0, 0, 1, 1))) if kind in m.RESETS else turn + rng.choice((0, 0, 1))
            out.append((c, seq, turn, kind, rng.choice(["user", "assistant", "assistant", "sys\ntem\\n\\", "<s>", None]), rng.choice([*ODD[:4], *TRICKY, "word "])))
    rng.shuffle(out)
    return out


def check(spark, events, parts=7):
    e = spark.createDataFrame(events, LOG).repartition(parts)
    want = by_hand(events)
    chats = m.messages(e)
    assert {r.conv_id: [tuple(x) for x in r.messages] for r in chats.collect()} == want
    for r in m.read_back(m.formatted(chats)).collect():
        turns = want[r.conv_id]
        assert r.formatted == rendered(turns)
        assert [tuple(t) for t in r.turns] == turns
        assert list(r.learned) == [t for role, t in turns if role == "assistant"]
        assert not re.search("|".join(map(re.escape, m.CONTROL)), re.sub(r"^<s>|</s><s>|</s>$", "", r.formatted))


@pytest.mark.parametrize("block", [1024, 2])
def test_the_fold_equals_one_step_by_step(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = random.Random(block)
    check(spark, log(rng))
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(m, "HOT_SHARE", 100)
    check(spark, log(rng))


def test_no_resets_and_a_hot_conversation(spark):
    events = [(1, k, k, "message", "user", f"t{k}") for k in range(3000)] + [(2, k, 0, "delta", "assistant", "</" if k % 2 else "s>") for k in range(3000)] + [(None, 1, 1, "message", "user", "x"), (None, 0, 0, "message", "user", "y")]
    check(spark, events, 40)


def test_repeated_rows_are_messages_each(spark):
    events = [(1, 0, 0, None, "user", "same"), (1, 0, 0, None, "user", "same"), (1, None, None, "message", None, None)]
    got = m.messages(spark.createDataFrame(events, LOG)).first()
    assert [tuple(x) for x in got.messages] == [("", ""), ("user", "same"), ("user", "same")]


def test_digest_equals_sql(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([t for t in [*ODD, *TRICKY] if "\x00" not in (t or "")])) for c in range(40) for t in range(rng.randrange(1, 9))]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", conversations.toPandas())
    want = sorted(tuple(map(str, r)) for r in con.execute(m.ORACLE).fetchall())
    events = conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text").unionByName(m.planted(spark))
    got = m.chat_digest(m.formatted(m.messages(events)))
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want
    own = got.where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (own.n_turns, own.turns_sha256) == (2, hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest())


def test_other_kinds_empty_logs_and_clashing_columns(spark):
    with pytest.raises(Exception, match="no such kind"):
        m.messages(spark.createDataFrame([(1, 0, 0, "vote", "user", "x")], LOG)).collect()
    assert m.chat_digest(m.formatted(m.messages(spark.createDataFrame([], LOG)))).count() == 0
    e = spark.createDataFrame([(1, 0, 0, "delta", "assistant", "x")], LOG).withColumns({c: F.lit(1) for c in ("c", "list", "ev", "starts", "messages", "formatted", "same", "below")})
    assert m.chat_digest(m.formatted(m.messages(e))).first().loss_chars == 1
