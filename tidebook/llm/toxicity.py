"""Toxicity by a counterfactually regularised linear classifier over words and word beginnings.

Training: a bounded sample of labelled texts (MAX_TRAIN, drawn by a hash of the id), each text once. Features
whose share among toxic texts is significantly raised become the vocabulary. Sentences that name a group are
rewritten with a neutral term and with the next three terms of the list, not with all of them; the squared
change of the score is penalised, so that a mention alone moves no score. Scoring reads whole texts in Arrow batches.

Defined results: a null or empty text has no features and gets the base rate; labels that are null, or of ids
without a document, are ignored; of an id's conflicting labels the higher counts; with no toxic or no clean
training text all scores are 0; an empty table gives no rows; extra columns pass through :func:`score`.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import batches as arrow
from tidebook.llm.common import held_out, stage_table

#: Labelled rows that training reads, at most about.
MAX_TRAIN = 20_000
#: Features kept, at most; a feature's least support and least root of the likelihood ratio of its raised share.
MAX_FEATURES, MIN_SUPPORT, MIN_Z = 4096, 3, 4.5
#: Lengths of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)
#: Group terms that are swapped for one another, and the neutral term.
IDENTITY = (
    "women men girls boys gay lesbian bisexual transgender queer straight muslim muslims christian christians jewish jews hindu "
    "buddhist atheist black white asian african latino hispanic arab european american mexican chinese indian immigrant "
    "immigrants refugee refugees disabled deaf blind old young elderly frauen männer juden muslime christen schwarze "
    "femmes hommes juifs musulmans chrétiens noirs mujeres hombres judíos musulmanes cristianos negros"
).split()
NEUTRAL = "people"
SWAP_PENALTY = 10.0
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features(text: str | None) -> set[str]:
    """Lower-case words and, marked by ``*``, the beginnings of longer words."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def swaps(text: str, limit: int = 4) -> list[tuple[set[str], set[str]]]:
    """(features before, features after) of each group mention's sentence, with the term exchanged."""
    out = []
    for sentence in SENTENCE.findall(text.lower()):
        for term in WORD.findall(sentence):
            if term in GROUP:
                at = GROUP[term]
                others = [NEUTRAL, *(IDENTITY[(at + k) % len(IDENTITY)] for k in range(1, limit))]
                out += [(features(sentence), features(re.sub(rf"\b{re.escape(term)}\b", o, sentence))) for o in others]
    return out


GROUP = {term: i for i, term in enumerate(IDENTITY)}


@dataclass
class Model:
    bias: float = -100.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in features(text) & self.weights.keys())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) if self.weights else 0.0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of a bounded hash sample of labelled documents that are not held out; each text once."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("y"))
    )
    share = min(1.0, MAX_TRAIN / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about MAX_TRAIN ids and labels: a broadcast of a fixed size
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text IS NOT NULL")
    return stage_table(joined.groupBy(F.xxhash64("text").alias("h")).agg(F.max("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "toxic-train")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model()

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in features(text):
                    found.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_pydict(
                {"f": list(found), "t": [v[1] for v in found.values()], "c": [v[0] for v in found.values()]},
                schema=pa.schema([("f", pa.string()), ("t", pa.int64()), ("c", pa.int64())]),
            )

    seen, total = F.col("t") + F.col("c"), n1 + n0
    term = lambda k, of: F.when(k > 0, k * F.log(k * total / of)).otherwise(0.0)
    ratio = (
        term(F.col("t"), seen * n1) + term(F.col("c"), seen * n0)
        + term(n1 - F.col("t"), (total - seen) * n1) + term(n0 - F.col("c"), (total - seen) * n0)
    )
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * ratio))
    chosen = (
        arrow(rows).mapInArrow(counted, "f string, t long, c long")
        .groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where((seen >= MIN_SUPPORT) & (seen < total) & (F.col("t") * n0 > F.col("c") * n1))
        .withColumn("z", z).where(F.col("z") >= MIN_Z)
        .orderBy(F.col("z").desc(), "f").limit(MAX_FEATURES)
    )
    vocabulary = {r["f"]: i for i, r in enumerate(chosen.collect())}  # at most MAX_FEATURES
    if not vocabulary:
        return Model()

    def reduced(batches):
        import pyarrow as pa

        for batch in batches:
            xs, ys, kinds, signs = [], [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                xs.append(sorted(vocabulary[f] for f in features(text) & vocabulary.keys()))
                ys.append(y)
                kinds.append(0)
                signs.append([1] * len(xs[-1]))
                for before, after in swaps(text):
                    gone, come = (before - after) & vocabulary.keys(), (after - before) & vocabulary.keys()
                    if gone or come:
                        xs.append([vocabulary[f] for f in (*gone, *come)])
                        signs.append([-1] * len(gone) + [1] * len(come))
                        ys.append(0)
                        kinds.append(1)
            yield pa.RecordBatch.from_pydict(
                {"x": xs, "s": signs, "y": ys, "kind": kinds},
                schema=pa.schema([("x", pa.list_(pa.int32())), ("s", pa.list_(pa.int32())), ("y", pa.int32()), ("kind", pa.int32())]),
            )

    # equal rows are counted, so what reaches the driver is bounded by the sample and mostly far below it
    seen = arrow(rows).mapInArrow(reduced, "x array<int>, s array<int>, y int, kind int").groupBy("x", "s", "y", "kind").agg(F.count("*").alias("n"))
    return fit([(r["x"], r["s"], r["y"], r["kind"], r["n"]) for r in seen.collect()], list(vocabulary))


def fit(rows: list, names: list[str], rounds: int = 4000) -> Model:
    """Balanced logistic regression with an L2 term and the swap penalty, by accelerated gradient steps.

    ``rows``: (feature indices, signs, label, kind, count); kind 1 rows are differences of a swap.
    """
    import numpy as np

    w, b = np.zeros(len(names)), 0.0
    index = np.concatenate([np.array(x, dtype=int) for x, *_ in rows] or [np.zeros(0, int)])
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, *_ in rows])
    sign = np.concatenate([np.array(s, dtype=float) for _, s, *_ in rows] or [np.zeros(0)])
    y, kind, n = (np.array([r[k] for r in rows], dtype=float) for k in (2, 3, 4))
    real, swap = kind == 0, kind == 1
    weight = np.where(real, n, 0.0)
    for label in (0, 1):  # balanced
        part = real & (y == label)
        weight[part] *= 0.5 / max(1.0, weight[part].sum())
    share = np.where(swap, n / max(1.0, n[swap].sum()), 0.0)
    reach = np.bincount(owner, minlength=len(rows)).max(initial=1)
    step = 1.0 / (0.25 * (1 + reach) + 2 * SWAP_PENALTY * reach * bool(swap.any()) + 1e-5)
    look, look_b, t = w.copy(), b, 1.0
    for _ in range(rounds):
        z = np.bincount(owner, look[index] * sign, minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(z + look_b, -40, 40)))
        pull = weight * (p - y) + 2 * SWAP_PENALTY * share * z * swap
        slope = np.bincount(index, pull[owner] * sign, minlength=len(names)) + 1e-5 * look
        new, new_b = look - step * slope, look_b - step * (weight * (p - y)).sum()
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return Model(float(b), {f: float(v) for f, v in zip(names, w, strict=True)})


def score(docs: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """docs with the score of each whole text."""
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double"

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            values = pa.array([model.score(x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, column])

    return arrow(docs).mapInArrow(scored, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, unchanged."""
    column = "_toxicity"
    while column in docs.columns:
        column += "_"
    return score(docs, train(docs, labels), column).where(F.col(column) < threshold).drop(column)
