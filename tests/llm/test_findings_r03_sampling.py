"""The sampler's cost: lattice states are shared, and open sets drawn only where they can be the largest."""

import random

import numpy as np

from tidebook.llm import sp_sampling


def _texts():
    rng = random.Random(3)
    words = "then when pen open token a an é 日本語 😀 supercalifragilistic naïve".split()
    return [" ".join(rng.choices(words, k=n)) for n in (1, 2, 3, 40, 400, 1500)] + ["", None, " ", "x" * 300, "ab" * 3000]


def test_equal_rests_of_chunks_share_one_state():
    lattice, mark = sp_sampling.Lattice(), sp_sampling.SPACE
    chunks = [mark + w for w in ("then", "when", "pen", "n")] + ["x" * (sp_sampling.TOGETHER + 5), mark + "lone" + "y" * sp_sampling.TOGETHER]
    brief, long = chunks[:4], chunks[4:]
    for some in (brief, brief + long, long):
        lattice.build(np.array([ord(c) for c in "".join(some)], np.int32), np.array([len(c) for c in some]))
        rests = {c[i:] for c in some if len(c) <= sp_sampling.TOGETHER for i in range(len(c))}
        assert len(lattice.first) - 1 == len(rests) + sum(len(c) for c in some if len(c) > sp_sampling.TOGETHER)
        for c, state in zip(some, lattice.begin.tolist(), strict=True):  # every path of first options spells its chunk
            spelled = ""
            while state >= 0:
                option = int(lattice.first[state])
                spelled, state = spelled + lattice.names[lattice.code[option]], int(lattice.to[option])
            assert spelled == c


def test_open_sets_are_drawn_where_they_can_be_largest(monkeypatch):
    lattice, texts, walks = sp_sampling.Lattice(), _texts(), []
    ids, init = list(range(len(texts))), sp_sampling._Walk.__init__
    monkeypatch.setattr(sp_sampling._Walk, "__init__", lambda self, *a, **k: (init(self, *a, **k), walks.append(self))[0])
    plain = lambda: [(*x[:2], list(x[2]), *x[3:]) for x in sp_sampling.sample_batch(lattice, ids, texts, k=6)]
    want = plain()
    assert len(walks[0].open) < len(walks[0].option) / 4
    for reach in (1e9, 8.0, 0.0):  # all drawn; too few, so that the rest is drawn after all
        monkeypatch.setattr(sp_sampling, "REACH", reach)
        walks.clear()
        assert plain() == want
    assert any(w.whole for w in walks)
    w = walks[0]
    every = w._drawn(np.arange(len(texts)), np.diff(w.start))
    assert len(every) == len(w.option)
    # no draw lies above what is taken as the highest
    doc = np.repeat(np.arange(len(texts)), np.diff(w.start))
    assert (every <= w.run[:-1] - w.run[w.start[doc]] + w.before[doc] + sp_sampling.HIGHEST).all()
    assert sp_sampling.HIGHEST > -np.log(-np.log((2.0**32 - 0.5) / 2.0**32))
