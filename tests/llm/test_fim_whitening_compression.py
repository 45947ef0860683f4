"""Fill-in-middle, whitening and the compression classifier against brute force, on hand-made rows."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidebook.llm import compression, fim, whitening

SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11


def spelled_out(doc_id, text, pattern=r"[^\n]*\n|[^\n]+", rate=100, spm=50):
    """Brute force: the list of units itself."""
    text = text or ""
    units = [m[0] for m in re.finditer(pattern, text)]
    assert "".join(units) == text
    key = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "\na", "a\n\n\nb", "a\nb\nc\nd", "é\n𝔘𝔫\n\ncode points 🤦🏽‍♂️\n", "tail<", "<\n<P\n>S>\n<", "has <M> in it\nx", "<P>", "\r\n\x0b\n \n",
    "x" * 50_000 + "\n" * 50_000 + "y", "word " * 20_000,
]


def test_fim_equals_the_list_of_units(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab<>PSM \n\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i if i % 50 else None, t, i, "fim", "o") for i, t in enumerate(texts)] + [(8, TEXTS[8], 0, "fim", "o")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, fim string, output string")
    made = fim.transform(docs)
    assert made.columns == [*docs.columns, "fim_"]
    got = sorted((r.doc_id or -1, r.text or "", *r.fim_) for r in made.collect())
    assert got == sorted((d or -1, t or "", *spelled_out(d, t)) for d, t, *_ in rows)
    back = fim.query(docs).collect()
    assert sorted((r.doc_id or -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in back if r.form != "plain") == sorted(
        (d or -1, *want[:4], sha(want[4]), sha(t)) for d, t, *_ in rows if (want := spelled_out(d, t))[1] != "plain"
    )
    assert {r.restored_sha256 for r in back if r.form == "plain"} == {sha(t or "") for d, t, *_ in rows if spelled_out(d, t)[1] == "plain"}
    assert {r.form for r in back} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("unit", "pattern"), [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("char", r"(?s).")])
def test_every_cut_of_every_unit(unit, pattern):
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\té") for _ in range(rng.randrange(30)))
        units = [m[0] for m in re.finditer(pattern, text)]
        runs = fim.Runs(text, unit)
        assert runs.n == len(units)
        assert [runs.cut(u) for u in range(runs.n + 1)] == [len("".join(units[:u])) for u in range(runs.n + 1)]
        assert len(runs.start) <= len(text) + 1


def test_fim_rates_and_an_empty_table(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(300)], "doc_id long, text string")
    for rate, spm in ((0, 50), (40, 0), (100, 100)):
        got = {r.doc_id: tuple(r.fim) for r in fim.transform(docs, rate=rate, spm=spm).collect()}
        assert got == {i: spelled_out(i, "a\nb\nc\n", rate=rate, spm=spm) for i in range(300)}
    assert fim.query(docs.limit(0)).count() == 0
    other = fim.transform(docs, sentinels=("[p]", "[s]", "[m]")).select("text", fim.restored(F.col("fim.output"), F.col("fim.form"), ("[p]", "[s]", "[m]")).alias("t"))
    assert other.where("text <> t").count() == 0


# ---- 12


def exact_covariance(rows):
    n, d = len(rows), len(rows[0])
    means = [sum(Fraction(r[j]) for r in rows) / n for j in range(d)]
    return means, [[sum((Fraction(r[i]) - means[i]) * (Fraction(r[j]) - means[j]) for r in rows) / n for j in range(d)] for i in range(d)]


def test_error_free_transformations():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(200) * 10.0 ** rng.integers(-20, 20, 200), rng.standard_normal(200) * 10.0 ** rng.integers(-20, 20, 200)
    for pair, op in ((whitening.two_sum, Fraction.__add__), (whitening.two_product, Fraction.__mul__)):
        hi, lo = pair(a, b)
        assert all(Fraction(h) + Fraction(low) == op(Fraction(x), Fraction(y)) for h, low, x, y in zip(hi, lo, a, b, strict=True))


def test_covariance_keeps_what_plain_doubles_lose(spark):
    """Values far from nought, over many tasks and more parts than one merge takes: 25 digits are right."""
    rng = random.Random(2)
    rows = [[1e9 + rng.random(), 1e9 + rng.random() * 1e-4, rng.random() - 3e7] for _ in range(700)]
    rows = [*rows, *[r[:] for r in rows[:40]]]
    table = spark.createDataFrame([(r,) for r in rows], "x array<double>").repartition(75)
    found = whitening.moments(table, "x", 3)
    means, want = exact_covariance(rows)
    assert found.n == len(rows)
    assert all(abs(Fraction(h) + Fraction(low) - m) < abs(m) / 10**25 for h, low, m in zip(*found.mean, means, strict=True))
    hi, lo = found.covariance
    for i in range(3):
        for j in range(3):
            assert abs(Fraction(hi[i, j]) + Fraction(lo[i, j]) - want[i][j]) < math.sqrt(want[i][i] * want[j][j]) / 10**13
    assert abs(hi[1, 1] / float(want[1][1]) - 1) < 1e-15  # variance 1e-9 beside a mean square of 1e18
    assert whitening.moments(table.limit(0), "x", 3) is None


def test_eigen_of_close_and_equal_values():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    for values in ([5, 5 - 1e-9, 3, 2, 1, 1, 0.5, 0.4, 1e-8, 1e-12, 0, 0], [1] * 12):
        m = (q * np.array(values, dtype=float)) @ q.T
        m = (m + m.T) / 2
        got, v = whitening.eigen(m, np.zeros_like(m))
        assert np.allclose(got, values, atol=1e-14) and (np.diff(got) <= 1e-15).all()
        assert np.abs(v.T @ v - np.eye(12)).max() < 1e-14 and np.abs(m @ v - v * got).max() < 1e-14
        assert (v[np.abs(v).argmax(axis=0), np.arange(12)] > 0).all()


def test_whitening_against_exact_fractions(spark):
    rng = random.Random(6)
    good = [[rng.gauss(0, 1), rng.gauss(0, 0.5), rng.gauss(1, 0.2), rng.gauss(0, 0.1), rng.gauss(0, 0.05)] for _ in range(60)]
    good += [good[0][:] for _ in range(30)] + [[v + 1e-5 for v in good[1]]]  # a common vector, and one in the same steps of the grid
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [1.0, float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "w", 0.5) for i, v in enumerate(good)] + [(None, good[2], "w", 0.5), (3, good[3], "w", 0.5)] + [(900 + i, v, "w", 0.5) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n double").repartition(5)
    got = whitening.query(table).collect()
    on_grid = lambda v: tuple(math.floor(256 * c) for c in v)
    fit = sorted({on_grid(v) for v in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    means, cov = exact_covariance(fit)
    v = np.array([[float(c) for c in r] for r in cov])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [(i, on_grid(e)) for i, e, *_ in rows if i is None or i < 900]
    assert sorted((r.vec_id or -1, r.component, r.n, r.deviation) for r in got) == sorted(
        (i or -1, k, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept for k in (1, 2, 3, 4)
    )
    by = {(r.vec_id, r.component): r for r in got}
    signs = [math.copysign(1, by[5, k + 1].whitened * (np.array([float(a - m) for a, m in zip(dict(kept)[5], means, strict=True)]) @ vectors[:, k])) for k in range(4)]
    for i, x in kept:
        for k in range(4):
            want = signs[k] * (np.array([float(a - m) for a, m in zip(x, means, strict=True)]) @ vectors[:, k]) / math.sqrt(values[k])
            assert abs(by[i, k + 1].whitened - want) < 1e-9
            assert abs(by[i, k + 1].explained - values[k] / np.trace(v)) < 1e-12
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-12


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.query(spark.createDataFrame([], schema)).collect() == []
    assert whitening.query(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whitening.query(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in one) == [(v, k, 1, 0, None, None) for v in (1, 2) for k in (1, 2)]
    line = whitening.query(spark.createDataFrame([(i, [float(i), -2.0 * i]) for i in range(9)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-12
    far = whitening.query(spark.createDataFrame([(0, [1e30]), (1, [-1e30]), (2, [0.0])], schema)).collect()
    assert {r.deviation for r in far if r.vec_id < 2} == {None} and max(abs(r.whitened) for r in far) < 2


def test_whitening_of_the_given_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.query(rows).toPandas()
    x = np.unique(np.floor(256 * np.array(rows.toPandas()["embedding"].tolist(), dtype=float)), axis=0)
    cov = np.cov(x.T, bias=True)
    values = np.linalg.eigvalsh(cov)[::-1]
    first = got.groupby("component").first()
    assert np.allclose(first["explained"], values[:4] / np.trace(cov), rtol=1e-9) and (first["n"] == len(x)).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got["identity_error"].max() < 1e-12 and np.abs(np.cov(wide.T, bias=True) - np.eye(4)).max() < 1e-9


# ---- 13


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    rows = []
    for i in range(n):
        words, good = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))], i % 4 > 0
        if not good:
            words = [w + "$$$" for w in words] if i % 8 else [words[0]] * len(words)
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_compression_tells_good_from_bad_and_equals_a_plain_count(spark):
    rows = corpus()
    edge = [(1000, None), (1001, ""), (1002, "a"), (1003, "é" * 100_001), (1004, rows[1][1]), (1004, rows[1][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t, _ in rows] + [(i, t, 1.0, "x") for i, t in edge], "doc_id long, text string, score double, y string")
    labels = [(i, q) for i, _, q in rows] + [(1, 0), (2, None), (3, 9), (5555, 0), (None, 1)]
    model = compression.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(model.dictionaries) == 2
    out = compression.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "y", "score_"]
    got = {r.doc_id: r.score_ for r in out.collect()}

    def plain(text):
        data, sizes = (text or "").encode(), []
        n = math.ceil(len(data) / compression.PIECE)
        step = math.ceil(len(data) / n) if n else 1
        for start in range(0, len(data), step):
            part = data[start : start + step]
            sizes.append((len(part), *(len(zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(part)) for d in model.dictionaries)))
        x = [1, 0, 0, 0, 0]
        if sizes:
            bad, good = sum(s[1] for s in sizes), sum(s[2] for s in sizes)
            x = [1, 20 * (bad - good) / (bad + good + 40), 20 * min((b - g) / (b + g) for _, b, g in sizes), math.log((good + 20) / (len(data) + 40)), math.log(min(g / (n + 20) for n, _, g in sizes) + 0.02)]
        return 1 / (1 + math.exp(-sum(w * v for w, v in zip(model.weights, x, strict=True))))

    for i, text in [(r[0], r[1]) for r in rows[::25]] + edge:
        assert abs(got[i] - plain(text)) < 1e-9
    assert got[1004] == got[1] == got[None] and got[1000] == got[1001]
    held = [(got[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum((s >= 0.3) == (q == 1) for s, q in held) >= 0.97 * len(held)


def test_compression_learns_nothing_from_held_out_labels(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows]
    models = [compression.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in ([(i, q) for i, _, q in rows], flipped)]
    assert models[0] == models[1]


def test_compression_without_one_kind_of_label(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int")
    assert {r.score for r in compression.query(docs, labels()).collect()} == {0.5}
    assert {r.score for r in compression.query(docs, labels(*[(i, 1) for i in range(20)])).collect()} == {1.0}
    assert {r.predicted for r in compression.query(docs, labels(*[(i, 0) for i in range(20)])).collect()} == {0}
    assert compression.query(docs.limit(0), labels((1, 1))).count() == 0


def test_compression_on_the_given_table(spark):
    """Held-out labels of the given tables: nearly all good texts kept, most bad ones found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = compression.query(docs, labels).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").select("quality", "predicted", "score").collect()
    bad = [r.predicted for r in got if r.quality == 0]
    good = [r.predicted for r in got if r.quality == 1]
    assert sum(good) >= 0.985 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert sum((r.score - r.quality) ** 2 for r in got) / len(got) < 0.02
