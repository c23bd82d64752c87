"""Pairs of ids that are too rare to be broadcast keep their own counts."""

import random

from helpers import frame, sentence

from tokenledger.llm import lm_scoring as lm


def test_rare_pairs_meet_their_counts_by_a_join(spark, monkeypatch):
    rng = random.Random(8)
    docs = frame(spark, [(i, sentence(rng, rng.randrange(1, 60), 200)) for i in range(80)] + [(900, None), (901, "")])
    want = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "PAIRS", 200)
    got = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 + 1e-4 * abs(want[i]) for i in want)
