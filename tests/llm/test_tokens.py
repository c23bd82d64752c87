"""Token counts and packing against the tokenizer's own whole-text encoding."""

import random
import re
import struct
import zlib

import pytest
from helpers import ODD, frame, sentence
from tokenizers import Tokenizer

from tokenledger.llm.packing import pack, plan
from tokenledger.llm.token_counts import token_counts
from tokenledger.llm.tokens import TAIL_LETTERS, TAIL_SIGNS, units, vocabulary_path


def whole(name):
    t = Tokenizer.from_file(vocabulary_path(name))
    t.no_padding()
    t.no_truncation()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    rng, ids = random.Random(1), whole(name)
    parts = ["ther***", "Word,", "B!!", "é.", "x-", "̸", "A9%%%", "**a", "don't", "'ll", " ", "  ", "\n", "\t", "\xa0", " ", "\x85", "\x1c", "᠎", "​", "﻿", "́", "中", "😀", "½", "_", "<|endoftext|>", "<|startoftext|>", "Σ", "\x00", "1", "İ", "İ:", "ŉ!", "ǰ-", "ÀÉİ.,;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    got = units(vocabulary_path(name)).ids(texts)
    for t, b in zip(texts, got):
        assert list(struct.unpack(f"<{len(b) // 4}I", b)) == ids(t), repr(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_each_letter_before_each_sign(name):
    """All of U+00C0 to U+024F, in or out of the class of letters that a tail is cut behind."""
    own, ids = units(vocabulary_path(name)), whole(name)
    letters = [chr(k) for k in range(0xC0, 0x250)] + list("09AZaz")
    texts = [f"{before}{c}{s}{s}" for c in letters for s in TAIL_SIGNS for before in ("", "x ")]
    assert [len(b) // 4 for b in own.ids(texts)] == [len(ids(t)) for t in texts]
    assert "İ" not in re.findall(f"[{TAIL_LETTERS}]", "".join(letters)) and len(re.findall(f"[{TAIL_LETTERS}]", "".join(letters))) > 390


def test_token_counts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "\n\n"), (99, sentence(random.Random(2), 40_000))]
    docs = frame(spark, rows).withColumnRenamed("n_chars", "n_tokens")  # a clashing name is replaced
    ids = whole("word_bpe_49k.json")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs).collect())
    want = sorted((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t in rows)
    assert got == want
    assert token_counts(frame(spark, [])).count() == 0


def check_packing(rows, out, ids, size=2048):
    """All pieces are there, cut by the rules, and sequences hold them without gaps or overlaps."""
    want = []
    for i, t in rows:
        all_ids = [*ids(t), 0]
        first = (len(all_ids) - 1) % size + 1
        cuts = [0, *range(first, len(all_ids) + 1, size)]
        want += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *all_ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs), sum(r.length for r in out)


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, sentence(rng, rng.randrange(1, 1500))) for i in range(150)] + [(7, "same"), (7, "same"), (300, sentence(rng, 9000))]
    docs = frame(spark, rows).withColumnRenamed("source", "length")  # a clashing name
    out = pack(docs).collect()
    n, total = check_packing(rows, out, whole("byte_bpe_50k.json"))
    assert n <= total / 2048 * 1.05 + 1
    assert pack(frame(spark, [])).count() == 0


def test_one_length_holds_most_pieces(spark):
    rows = [(i, "same words here") for i in range(3000)]
    n, total = check_packing(rows, pack(frame(spark, rows)).collect(), whole("byte_bpe_50k.json"))
    assert n == -(-3000 // (2048 // (total // 3000)))


def test_plan_prefers_exact_complements():
    got = plan({10: 1, 6: 2, 4: 2, 3: 1, 7: 1}, 10)
    assert sum(times for _, times in got) == 4 and all(sum(c) == 10 for c, _ in got)
    assert sum(t for _, t in plan({5: 3, 2: 1, 1: 2}, 9)) == 3
    assert plan({}, 10) == []
    triples = plan({50: 1, 20: 1, 17: 1, 13: 1}, 100)
    assert triples == [((50, 20, 13, 17), 1)] or sorted(triples[0][0]) == [13, 17, 20, 50]


def test_a_plan_is_bounded_whatever_the_counts():
    rng = random.Random(6)
    for counts in ({n: rng.randrange(1, 10**9) for n in range(1, 2049)}, {n: 10**9 for n in range(1, 2049)}, {n: rng.randrange(1, 4) for n in range(1, 2049, 3)}):
        made = plan(counts, 2048)
        assert len(made) <= 2 * 2048  # every step leaves of some length less than it takes at once
        assert sum(len(c) for c, _ in made) <= 16 * 2048  # rows of the table that is broadcast
        used = {}
        for combo, times in made:
            assert sum(combo) <= 2048
            for n in combo:
                used[n] = used.get(n, 0) + times
        assert used == counts


def test_full_pieces_and_a_hot_length(spark, monkeypatch):
    from tokenledger.llm import packing

    monkeypatch.setattr(packing, "RANKED", 100)
    rng = random.Random(7)
    rows = [(i, "same words here") for i in range(900)] + [(5000, sentence(rng, 30_000)), (5001, None)]
    n, total = check_packing(rows, pack(frame(spark, rows)).collect(), whole("byte_bpe_50k.json"))
    assert n <= total / 2048 * 1.05 + 1
