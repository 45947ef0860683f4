"""The quality ledger's cost and exactness: windows are sorted natively and only where one repeats."""

import random
from collections import Counter

from tidebook.llm import quality


def test_windows_are_sorted_natively_and_only_where_one_repeats(spark):
    rng = random.Random(7)
    texts = ["a b c a b c", "a a a a", "a b c d", "a b", "", None, "x y z q x y z y z q x y", *(" ".join(rng.choices("ab é ü_".split(), k=rng.randrange(40))) for _ in range(60))]
    led = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = led._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan and "translate(" not in plan
    for r in led.collect():
        words = (texts[r.doc_id] or "").split()
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        assert r.n_repeat_words == len({i + d for i, w in enumerate(windows) if seen[w] > 1 for d in range(3)})
    hashes = spark.createDataFrame([([1, 2, 3],), ([3, 1, 3],), (None,)], "h array<long>")
    assert [r.s and [tuple(x) for x in r.s] for r in hashes.selectExpr(quality._places("h") + " AS s").collect()] == [None, [(1, 1), (3, 0), (3, 2)], None]


def test_only_white_space_follows_an_ellipsis(spark):
    lines = ["a...", "a… \t", "a...\r", "a...\u2028", "a…\u0085", "a... b", "..."]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.n_ellipsis_lines for r in quality.ledger(df).collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
