"""Embedding whitening over a covariance in double-double, and a divide-and-conquer eigen-solve.

Sums and centred outer products are kept as unevaluated pairs (high, low) of doubles: sums by two-sum, products by Dekker's
split, both error-free, so a covariance carries about 106 bits whatever the number of rows or the order of tasks. Every task
holds one pair of d x d matrices; the tasks' pairs are merged in a tree of fan-in FAN, one row of the matrix a group, so no
group grows with the input. What reaches the driver is d x d, by the dimension alone. There LAPACK's ``syevd`` reduces the
matrix to tridiagonal form and solves that by divide and conquer; two steps of refinement in extended precision
against the double-double matrix bring vectors and values to full double precision.

:func:`moments`, :func:`eigen` and :func:`whiten` take vectors of doubles of any scale; :func:`query` applies them to vectors on a
grid of 1/256, where the sums are exact.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are left out, and so are vectors of
another length than the most common one (ties: the longest); a null id is kept; repeated rows are returned each, and count
once in the fit list; components without variance (under d * 2**-50 of the whole) have a null score and are left out of
the identity check, whose error is null where no component has any; a deviation that no long holds is null; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import batches as arrow
from tidebook.llm.common import stage_table, unstage

#: Pairs that one task merges; rows whose products are formed at once.
FAN, ROWS = 32, 512
#: Components returned.
COMPONENTS = 4
PART = "part long, i int, hi array<double>, lo array<double>"


# ---- error-free transformations over arrays of doubles


def two_sum(a, b):
    """(s, e) with s + e = a + b exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a):
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def two_product(a, b):
    """(p, e) with p + e = a * b exactly."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def pair_sum(ah, al, bh, bl):
    """The sum of two pairs, as a pair."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    return s + e, e - ((s + e) - s)


def pair_total(hi, lo):
    """The sum of pairs over the first axis, by halving."""
    import numpy as np

    while len(hi) > 1:
        half = len(hi) // 2
        h, low = pair_sum(hi[:half], lo[:half], hi[half : 2 * half], lo[half : 2 * half])
        hi, lo = (np.concatenate((h, hi[2 * half :])), np.concatenate((low, lo[2 * half :]))) if len(hi) % 2 else (h, low)
    return hi[0], lo[0]


def centred(x, mean_hi, mean_lo):
    """x - mean as pairs."""
    s, e = two_sum(x, -mean_hi)
    e = e - mean_lo
    return s + e, e - ((s + e) - s)


def outer_total(hi, lo):
    """Upper triangle of the sum of outer products of the rows, as a pair of d x d matrices."""
    import numpy as np

    d = hi.shape[1]
    out_hi, out_lo = np.zeros((d, d)), np.zeros((d, d))
    for i in range(d):
        p, e = two_product(hi[:, i : i + 1], hi[:, i:])
        e = e + (hi[:, i : i + 1] * lo[:, i:] + lo[:, i : i + 1] * hi[:, i:])
        out_hi[i, i:], out_lo[i, i:] = pair_total(p, e)
    return out_hi, out_lo


# ---- moments of a table of vectors


def _vectors(batch, d: int):
    """The first column, a list of d numbers each, in blocks of rows of doubles."""
    import numpy as np

    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)
    for since in range(0, len(flat), ROWS):
        yield flat[since : since + ROWS]


def _emitted(rows: list):
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    doubles = pa.list_(pa.float64())
    columns = [pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], doubles), pa.array([r[2] for r in rows], doubles)], names=["part", "i", "hi", "lo"])


def _merge(table):
    """One pair of the pairs of a group, in the order of their parts."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("part")
    hi, lo = (np.array(table.column(c).to_pylist()) for c in ("hi", "lo"))
    hi, lo = pair_total(hi, lo)
    doubles = pa.list_(pa.float64())
    head = [pa.array([table.column("part")[0].as_py() // FAN], pa.int64()), pa.array([table.column("i")[0].as_py()], pa.int32())]
    return pa.table([*head, pa.array([hi.tolist()], doubles), pa.array([lo.tolist()], doubles)], names=["part", "i", "hi", "lo"])


def _merged(parts: DataFrame, label: str) -> dict[int, tuple]:
    """row -> (high, low) of the sum over all parts."""
    import numpy as np

    level = stage_table(parts, label)
    last = level.agg(F.max("part").alias("p")).first()["p"] or 0
    while last > 0:
        above = stage_table(arrow(level).groupBy("i", F.floor(F.col("part") / FAN).alias("above")).applyInArrow(_merge, PART), label)
        unstage(level)
        level, last = above, last // FAN
    out = {r["i"]: (np.array(r["hi"]), np.array(r["lo"])) for r in level.collect()}  # d rows of at most d pairs
    unstage(level)
    return out


@dataclass
class Moments:
    """Rows, their exact sums as far as doubles' pairs reach, mean, and covariance (divisor n), all as pairs."""

    n: int
    sums: tuple
    mean: tuple
    covariance: tuple


def _quotient(hi, lo, n: int):
    """A pair divided by a whole number, as a pair."""
    q = hi / n
    p, e = two_product(q, float(n) + 0 * q)
    rest = ((hi - p) - e) + lo
    return two_sum(q, rest / n)


def moments(rows: DataFrame, column: str, d: int) -> Moments | None:
    """Mean and covariance of a column of arrays of ``d`` numbers; None for no rows. Two passes, so that centring precedes products."""
    import numpy as np

    vectors = rows.select(F.col(column).cast("array<double>").alias("v"))

    def summed(batches):
        hi, lo = np.zeros(d + 1), np.zeros(d + 1)
        for batch in batches:
            for x in _vectors(batch, d):
                x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
                hi, lo = pair_sum(hi, lo, *pair_total(x, np.zeros_like(x)))
        if hi[0]:
            yield _emitted([(0, hi, lo)])

    found = _merged(arrow(vectors).mapInArrow(summed, PART), "sums")
    if not found:
        return None
    hi, lo = found[0]
    n = int(hi[0])
    mean = _quotient(hi[1:], lo[1:], n)

    def multiplied(batches):
        hi, lo, seen = np.zeros((d, d)), np.zeros((d, d)), False
        for batch in batches:
            for x in _vectors(batch, d):
                hi, lo = pair_sum(hi, lo, *outer_total(*centred(x, *mean)))
                seen = True
        if seen:
            yield _emitted([(i, hi[i, i:], lo[i, i:]) for i in range(d)])

    table = _merged(arrow(vectors).mapInArrow(multiplied, PART), "products")
    high, low = np.zeros((d, d)), np.zeros((d, d))
    for i, pair in table.items():
        high[i, i:], low[i, i:] = _quotient(*pair, n)
        high[i:, i], low[i:, i] = high[i, i:], low[i, i:]
    return Moments(n, (hi[1:], lo[1:]), mean, (high, low))


def eigen(hi, lo):
    """(values, vectors as columns) of a symmetric matrix given as a pair, by falling value; a vector's largest entry is positive."""
    import numpy as np

    wide = np.longdouble
    matrix = hi.astype(wide) + lo.astype(wide)
    _, start = np.linalg.eigh(hi)  # LAPACK syevd: tridiagonal reduction, then divide and conquer
    x = start[:, ::-1].astype(wide)
    values = np.zeros(len(hi), dtype=wide)
    for _ in range(2):  # refinement after Ogita and Aishima: the error squares in each step
        r = np.eye(len(hi), dtype=wide) - x.T @ x
        s = x.T @ matrix @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        close = 2 * (np.sqrt((off**2).sum()) + np.sqrt((matrix**2).sum()) * np.sqrt((r**2).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(hi))] < 0, -1, 1)
    return values.astype(float), x.astype(float)


@dataclass
class Whitening:
    """What a task needs to whiten vectors: sums and their number, mean, the first components and their values, and the trace."""

    n: int
    sums: list[int]
    mean: tuple
    vectors: object
    values: object
    trace: float

    @property
    def kept(self):
        """Which of the components have variance."""
        return self.values > len(self.sums) * 2.0**-50 * self.trace

    def project(self, x):
        """Whitened scores of rows of doubles; NaN for a component without variance."""
        import numpy as np

        hi, lo = centred(x, *self.mean)
        scale = np.sqrt(np.where(self.kept, self.values, np.nan))
        return (hi @ self.vectors + lo @ self.vectors) / scale

    def deviation(self, x) -> list[int | None]:
        """Sums of squares of n * x - sums, for rows of whole numbers; None where no long holds it."""
        import numpy as np

        most = self.n * max(1, abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums), default=0)
        if most * most * x.shape[1] < 1 << 62:
            y = self.n * x - np.array(self.sums, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x)
        return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, column: str, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening by the first components of the rows' covariance."""
    import numpy as np

    found = moments(rows, column, d)
    if found is None:
        return None
    values, vectors = eigen(*found.covariance)
    sums = [int(h) + int(low) for h, low in zip(*found.sums, strict=True)]
    k = min(components, d)
    trace = math.fsum([*np.diag(found.covariance[0]), *np.diag(found.covariance[1])])
    return Whitening(found.n, sums, found.mean, np.ascontiguousarray(vectors[:, :k]), np.maximum(values[:k], 0.0), trace)


def whiten(rows: DataFrame, model: Whitening, column: str, out: str = "whitened") -> DataFrame:
    """rows with the array of each vector's scores, null entries for components without variance."""
    while out in rows.columns:
        out += "_"
    at, d = rows.columns.index(column), len(model.sums)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` array<double>"

    def projected(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            scores = model.project(flat)
            values = pa.array(scores.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1]), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return arrow(rows).mapInArrow(projected, schema)


def identity_error(rows: DataFrame, model: Whitening, column: str) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity."""
    import numpy as np

    k = int(model.kept.sum())
    if not k:
        return None
    scores = whiten(rows.select(column), model, column, "w").select(F.slice("w", 1, k).alias("w"))
    hi, lo = moments(scores, "w", k).covariance
    return float(np.abs((hi - np.eye(k)) + lo).max())


# ---- the query


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite entries."""
    big = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big))


def on_grid(vector: Column) -> Column:
    """Entries in whole steps of 1/256, downwards."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256))


def query(embeddings: DataFrame) -> DataFrame:
    """Per vector and component: n, deviation, whitened score, share explained, and the identity error of all."""
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "embedding").where(finite(F.col("embedding")))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    if d == 0:
        return spark.createDataFrame([], schema)
    # a filter above would be computed anew after the projection
    grid = rows.where(F.size("embedding") == d).select("vec_id", on_grid(F.col("embedding")).alias("x"))
    fitted = stage_table(grid.select("x").distinct(), "fit-list")
    model = fit(fitted, "x", d)
    error = identity_error(fitted, model, "x")
    unstage(fitted)
    k = len(model.values)

    def spelled(batches):
        import numpy as np
        import pyarrow as pa

        explained = model.values / model.trace if model.trace else np.full(k, np.nan)
        for batch in batches:
            for since in range(0, len(batch), 16 * ROWS):
                part = batch.slice(since, 16 * ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                scores, n = model.project(x.astype(np.float64)), len(x)
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n, dtype=np.int64)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(scores.ravel(), from_pandas=True),
                    pa.array(np.tile(explained, n), from_pandas=True),
                    pa.array([error] * (n * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return arrow(grid).mapInArrow(spelled, schema)
