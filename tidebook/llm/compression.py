"""Quality by compression: a text of the better kind compresses better with a dictionary of good text.

Two zstandard dictionaries are built from equal numbers of pieces of labelled good and bad texts. A text is cut into
pieces of about PIECE bytes, each compressed with both dictionaries; what is left of it under each, normalised, gives four
evidences: the difference of both sizes over their sum, for the whole text and for its worst piece, and the size
against the plain length, for the whole and for its most repetitive piece. A logistic curve fitted on labelled texts that no
dictionary has seen turns them into the probability of label 1.

Training reads a bounded sample of labelled texts (MAX_TRAIN, drawn by a hash of the id; each text once): one half
for the dictionaries, of which PIECES_PER_CLASS pieces a class reach the driver, the other for the curve, of which five numbers
a text do. Scoring reads whole texts in Arrow batches.

Defined results: a null or empty text leaves no evidence and gets the curve's value at nought; labels other than 0 and
1, null, or of ids without a document are ignored; of an id's conflicting labels the higher counts; without a good or
without a bad training text every score is the share of good ones (0.5 where there are none at all); repeated rows score alike;
an empty table gives no rows; extra columns pass through :func:`score`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import batches as arrow
from tidebook.llm.common import held_out, stage_table

#: Labelled rows that training reads, at most about.
MAX_TRAIN = 20_000
#: Bytes of a piece, of a dictionary; pieces a class, and of one text, that build a dictionary; level of compression.
PIECE, DICTIONARY, PIECES_PER_CLASS, PIECES_PER_TEXT, LEVEL = 512, 1 << 16, 4000, 4, 3
#: Bytes added to sizes, so that texts of a few bytes weigh little; weight of the curve's quadratic term.
FLOOR, RIDGE = 20.0, 1e-3


def cut(data: bytes, size: int = PIECE) -> list[bytes]:
    """data in equal pieces of at most ``size`` bytes."""
    n = -(-len(data) // size)
    step = -(-len(data) // n) if n else 1
    return [data[i : i + step] for i in range(0, len(data), step)]


@dataclass
class Model:
    """Dictionaries of bad and good text, the curve's weights (constant first), and the score where nothing can be compared."""

    dictionaries: list[bytes] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    share: float = 0.5

    def compressors(self) -> list:
        """A compressor by each dictionary, for one task; sizes hold neither the length, an id nor a checksum."""
        import zstandard

        return [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
            for d in self.dictionaries
        ]

    def score(self, text: str | None, compressors: list) -> float:
        import math

        if not self.weights:
            return self.share
        z = sum(w * x for w, x in zip(self.weights, evidence(text, compressors), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def evidence(text: str | None, compressors: list) -> list[float]:
    """1 and the four evidences of a text; all but the 1 are 0 for an empty one."""
    import math

    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    bad = good = 0
    worst = least = 1.0
    for piece in cut(data):
        b, g = (len(c.compress(piece)) for c in compressors)
        bad, good = bad + b, good + g
        worst, least = min(worst, (b - g) / (b + g)), min(least, g / (len(piece) + FLOOR))
    return [1.0, 20 * (bad - good) / (bad + good + 2 * FLOOR), 20 * worst, math.log((good + FLOOR) / (len(data) + 2 * FLOOR)), math.log(least + 0.02)]


def dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or, of too few pieces to train on, their own last bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(text, y, part) of a bounded hash sample of labelled documents that are not held out; each text once."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    share = min(1.0, MAX_TRAIN / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about MAX_TRAIN ids and labels: a broadcast of a fixed size
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text <> ''")
    each = joined.groupBy(F.xxhash64("text").alias("h")).agg(F.max("text").alias("text"), F.max("y").alias("y"))
    return stage_table(each.select("text", "y", F.pmod(F.xxhash64("h"), F.lit(2)).cast("int").alias("part")), "quality-train")


def _pieces(batches):
    """(y, piece) of at most PIECES_PER_TEXT pieces of each text, spread over the whole of it."""
    import pyarrow as pa

    for batch in batches:
        ys, out = [], []
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = cut(text.as_py().encode("utf-8", "replace"))
            picked = {k * len(own) // PIECES_PER_TEXT for k in range(PIECES_PER_TEXT)}
            out += [own[k] for k in sorted(picked)]
            ys += [y] * len(picked)
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(out, pa.binary())], names=["y", "piece"])


def fit(rows: list[tuple[list[float], int]], rounds: int = 60) -> list[float]:
    """Weights of a logistic curve over the evidences, by Newton steps with a quadratic term."""
    import numpy as np

    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (y - p) - RIDGE * w)
        w += step / max(1.0, float(np.abs(step).max()) / 4)
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    rows = training_rows(docs, labels, label)
    seen = {(r["part"], r["y"]): r["n"] for r in rows.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    total = sum(seen.values())
    share = sum(n for (_, y), n in seen.items() if y == 1) / total if total else 0.5
    if any((0, y) not in seen for y in (0, 1)) or not any(part for part, _ in seen):
        return Model(share=share)
    drawn = arrow(rows.where("part = 0").select("text", "y")).mapInArrow(_pieces, "y int, piece binary")
    drawn = stage_table(drawn.distinct(), "quality-pieces")
    kept = []
    for y in (0, 1):  # a bounded draw
        top = drawn.where(F.col("y") == y).orderBy(F.xxhash64("piece"), "piece").limit(PIECES_PER_CLASS)
        kept.append([bytes(r["piece"]) for r in top.select("piece").collect()])
    model = Model([dictionary(pieces) for pieces in kept], share=share)

    def measured(batches):
        import pyarrow as pa

        own = model.compressors()
        for batch in batches:
            values = [evidence(text.as_py(), own) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    sample = arrow(rows.where("part = 1").select("text", "y")).mapInArrow(measured, "x array<double>, y int").collect()
    model.weights = fit(sorted((list(r["x"]), r["y"]) for r in sample))
    return model


def score(docs: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """docs with the score of each whole text, under a name that is not taken."""
    while column in docs.columns:
        column += "_"
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double"

    def scored(batches):
        import pyarrow as pa

        own = model.compressors()
        for batch in batches:
            values = pa.array([model.score(x.as_py(), own) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, column])

    return arrow(docs).mapInArrow(scored, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
