"""The exhaustive step of the near-duplicate join: sliced blocks lose no link, and none of them is written."""

import random

from tidebook.llm import jaccard
from tidebook.llm.common import stage_table


def test_blocks_are_sliced_and_not_written(spark, monkeypatch):
    rng, written = random.Random(2), []
    for name, value in (("BLOCK", 2), ("PROBES", 3), ("SLICE", 4)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    monkeypatch.setattr(jaccard, "stage_table", lambda df, label: (written.append(label), stage_table(df, label))[1])
    bases = [sorted(rng.sample(range(10, 400), 20)) for _ in range(6)]
    sets = {i: sorted({1, *rng.sample(bases[i % 6], 19)}) for i in range(30)}  # one token in all, six groups of near copies
    near = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if near(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    rows = [(i, len(s), s, s, s, s) for i, s in sets.items()]
    held = stage_table(spark.createDataFrame(rows, "sig long, n long, tokens array<long>, p0 array<long>, p1 array<long>, p2 array<long>"), "held")
    parts = stage_table(spark.createDataFrame([], "node long, component long"), "parts")
    links = stage_table(spark.createDataFrame([], "a long, b long"), "links")
    apart = stage_table(spark.createDataFrame([(1, i, i, 0) for i in sets], "token long, sig long, part long, main long"), "open")
    found = {r.node: r.component for r in jaccard._exhausted(held, [links], parts, apart, 80).collect()}
    assert {i: found.get(i, i) for i in sets} == root and len(set(root.values())) < 30
    assert "blocks" not in written
