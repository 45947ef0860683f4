"""Language identification by error-correcting output codes.

Every learned language gets a codeword; one binary classifier over hashed byte n-grams predicts each bit; a
text's language is the codeword of least logistic loss, each bit weighted by the classifier's margin. The
classifiers' weights are log-odds of n-gram counts between the languages on either side of a bit, so training is
one aggregation over all training texts: languages x BUCKETS numbers, whatever the corpus.

Defined results: text that is null or has no letter is ``und`` with score 0; rows whose lang is null teach
nothing; with one learned language every other text gets it, with none ``und``; an empty table gives no rows;
extra columns pass through :func:`predict`. Texts are read whole, in chunks.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import batches as arrow
from tidebook.llm.common import held_out

#: n-gram lengths in bytes and hash buckets.
GRAMS, BUCKETS = (2, 3, 4), 1 << 14
CHUNK = 1 << 20
#: Bits of a codeword: BITS_PER x log2(languages), LEAST_BITS at least, and no more than there are ways to split the languages in two.
BITS_PER, LEAST_BITS, DRAWS = 12, 63, 50
#: Below this lead over the second codeword a text counts as ambiguous.
AMBIGUOUS = 0.2
SHARPNESS = 8.0
LETTER = regex.compile(r"\p{L}")


def grams(text: str):
    """Counts of the hashed n-grams of a lower-cased text, as a float32 array of BUCKETS."""
    import numpy as np

    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.float32)
    for start in range(0, len(data), CHUNK):
        part = data[start : start + CHUNK + max(GRAMS) - 1].astype(np.uint32)
        for n in GRAMS:
            code = np.zeros(max(0, min(CHUNK, len(part) - n + 1)), dtype=np.uint32)
            for k in range(n):
                code = code * np.uint32(257) + part[k : k + len(code)]
            code = (code * np.uint32(2654435761)) >> np.uint32(18)
            counts += np.bincount(code, minlength=BUCKETS)
    return counts


def codewords(n: int):
    """An n x bits array of -1 and 1: a seeded draw, without replacement, of the 2**(n-1) - 1 ways to split n languages in two.

    Of some draws the one counts in which the two nearest codewords lie furthest apart. Few languages have so few ways that every draw is all of
    them, the exhaustive code.
    """
    import numpy as np

    if n == 1:
        return np.ones((1, 1), dtype=np.float32)
    ways = (1 << (n - 1)) - 1
    bits, rng = min(ways, max(LEAST_BITS, int(np.ceil(BITS_PER * np.log2(n))))), random.Random(n)
    best, spread = None, -1.0
    for _ in range(DRAWS):
        splits: set[int] = set()
        while len(splits) < bits:
            splits.update(1 + rng.randrange(ways) for _ in range(bits - len(splits))) if bits < ways else splits.update(range(1, ways + 1))
        code = np.array([[1 if c >> i & 1 else -1 for c in sorted(splits)] for i in range(n)], dtype=np.float32)
        apart = (bits - code @ code.T) / 2 + np.eye(n) * 1e9
        if apart.min() > spread:
            best, spread = code, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: object
    weights: object

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, share of the best codeword, ambiguous)."""
        import numpy as np

        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0, False
        counts = grams(text)
        margin = SHARPNESS * (counts @ self.weights) / counts.sum()
        loss = np.logaddexp(0, -self.code * margin) @ np.abs(margin) / max(1e-9, float(np.abs(margin).sum()))
        share = np.exp(-(loss - loss.min()) * SHARPNESS)
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        lead = share[order[0]] - share[order[1]] if len(order) > 1 else 1.0
        return self.langs[order[0]], float(share[order[0]]), bool(lead < AMBIGUOUS)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count n-grams by language over all of ``docs``, then set one linear classifier per bit."""
    import numpy as np

    def counted(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for body, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                # each text weighs the same, so that a long one cannot stand for its language
                counts = grams(body.as_py()).astype(np.float64)
                total[name] = total.get(name, 0.0) + counts * (1000.0 / counts.sum())
        for name, counts in total.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "g", "n"])

    rows = docs.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    found = arrow(rows).mapInArrow(counted, "lang string, g int, n double").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    table: dict[str, np.ndarray] = {}
    for r in found.collect():  # languages x BUCKETS
        table.setdefault(r["lang"], np.ones(BUCKETS))[r["g"]] += round(r["n"], 6)
    langs = sorted(table)
    if not langs:
        return Model([], None, None)
    share = np.stack([table[x] / table[x].sum() for x in langs])
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        side = code[:, bit] > 0
        if side.all() or not side.any():
            continue
        weights[:, bit] = np.log(share[side].mean(0)) - np.log(share[~side].mean(0))
    return Model(langs, code, weights)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_ambiguous."""
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, lang_score double, lang_ambiguous boolean"
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.code, model.weights))  # languages x BUCKETS numbers at most

    def predicted(batches):
        import pyarrow as pa

        own = Model(*shared.value)
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column(at)]
            new = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_ambiguous"])

    return arrow(docs).mapInArrow(predicted, schema)


def query(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous")
    )
