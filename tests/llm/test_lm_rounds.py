"""A shard's windows are gone through in all rounds by one task, and pairs that the model lacks are told by the pass that scores."""

import numpy as np
from test_models import counted

from tokenledger.llm import lm_scoring as lm

SIZE, MARK = 301, 300


def some(seed, n):
    rng = np.random.default_rng(seed)
    return [np.repeat(rng.integers(0, 150, k), 2) * 2 + np.tile([0, 1], k) for k in rng.integers(1, 40, n)]


def test_a_learner_goes_through_all_windows_in_every_round(monkeypatch):
    monkeypatch.setattr(lm, "LEARNED", 2 * lm.BATCH)
    texts = some(1, 300)
    model = lm.Model(*counted(texts, SIZE, MARK))
    w, g, f, _ = lm.chunks(texts, MARK)
    w, g, f = (a[: len(w) // lm.BATCH * lm.BATCH] for a in (w, g, f))
    assert len(w) > 3 * lm.BATCH and lm.ROUNDS == 2
    twice = lm.Learner(model)
    for at in range(0, len(w), 50):
        twice.add(w[at : at + 50], g[at : at + 50], f[at : at + 50])
    got = twice.done()
    monkeypatch.setattr(lm, "ROUNDS", 1)
    once = lm.Learner(model)
    for _ in range(2):
        once.add(w, g, f)
    want = once.done()
    assert got[-1] == len(w) and want[-1] == 2 * len(w)
    assert np.allclose(got[:-1] / got[-1], want[:-1] / want[-1], atol=1e-6)


def test_pairs_that_are_not_held_are_told_with_the_scores():
    texts, mark = some(2, 40), MARK
    near, keys, counts = counted(texts, SIZE, mark)
    kept = counts >= 3
    model = lm.Model(near, keys[kept], counts[kept])
    held = set(keys[kept].tolist())
    w, g, f, per = lm.chunks(texts, mark)
    scorer = lm.Scorer(model)
    scores, pairs, lack = scorer.told(w, g, f)
    assert (scores == scorer.log10(w, g, f)).all()
    ends = np.cumsum(lack)[np.cumsum(per) - 1]
    for t, part in zip(texts, np.split(pairs, ends[:-1])):
        assert part.tolist() == [x << 16 | y for x, y in zip([mark, *t.tolist()], [*t.tolist(), mark]) if x << 16 | y not in held]
