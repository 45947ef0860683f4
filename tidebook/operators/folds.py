"""Order-dependent folds inside the JVM: one sorted array per key, folded by ``aggregate``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEC = "DECIMAL(24,6)"


def taker_sweep(levels: DataFrame, key: list[str], qty: str, limit: str) -> DataFrame:
    """Per key: contracts taken level by level up to ``limit`` and their cost; levels (price, size) ascending by price."""
    reach = f"filter(ls, l -> l.price <= {limit})"
    step = f"(a, l) -> named_struct('left', CAST(a.left - least(a.left, l.size) AS DECIMAL(24,6)), 'cost', CAST(a.cost + least(a.left, l.size) * l.price AS DECIMAL(38,12)))"
    gathered = levels.groupBy(*key, qty, limit).agg(F.array_sort(F.collect_list(F.struct("price", "size"))).alias("ls"))
    folded = gathered.select(*key, qty, F.expr(f"aggregate({reach}, named_struct('left', CAST({qty} AS {DEC}), 'cost', CAST(0 AS DECIMAL(38,12))), {step})").alias("s"))
    return folded.select(*key, F.expr(f"CAST({qty} - s.left AS {DEC})").alias("filled"), F.col("s.cost").alias("cost"))


def sequence_verdicts(frames: DataFrame) -> DataFrame:
    """frames (stream, ordinal, seq, recovery) with the verdict of each, in order of arrival, without a fold.

    The baseline is the largest number so far: only a frame that follows it by one moves it. A frame further ahead is a
    gap, and from there on every frame is ``degraded`` until a recovery, which sets the baseline to its own number. Frames
    without a number are ``unsequenced`` whatever the state.
    """
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    turns = frames.selectExpr("*", "sum(CAST(recovery AS INT)) OVER (PARTITION BY stream ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS turn")
    seen = turns.selectExpr("*", f"max(seq) OVER (PARTITION BY stream, turn ORDER BY ordinal {before}) AS top")
    cut = seen.selectExpr("*", "min(CASE WHEN seq > top + 1 AND NOT recovery THEN ordinal END) OVER (PARTITION BY stream, turn) AS gap_at")
    verdict = F.expr(
        "CASE WHEN recovery THEN 'recovered' WHEN seq IS NULL THEN 'unsequenced' WHEN ordinal > gap_at THEN 'degraded' WHEN top IS NULL THEN 'first' WHEN seq = top + 1 THEN 'ok'"
        " WHEN seq = top THEN 'duplicate' WHEN seq < top THEN 'out_of_order' ELSE 'gap' END"
    )
    return cut.withColumn("verdict", verdict).drop("turn", "top", "gap_at")


def reconciled(rows: DataFrame, level: list[str]) -> DataFrame:
    """Per level: executed, removed, added and unreconciled volume of rows (event_id, traded, delta).

    A decrease is first explained by traded volume that no decrease has explained yet; that pending volume is a running
    sum less its least value so far, so no fold is needed.
    """
    by = ", ".join(level)
    split = rows.selectExpr(*level, "event_id", "traded", "greatest(delta, 0) AS added", "greatest(-delta, 0) AS gone")
    run = split.selectExpr("*", f"sum(traded - gone) OVER (PARTITION BY {by} ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run")
    low = run.selectExpr("*", f"least(0, coalesce(min(run) OVER (PARTITION BY {by} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low")
    used = low.selectExpr("*", "least(gone, run + gone - traded - low) AS used")
    total = lambda c, name: F.sum(c).cast(DEC).alias(name)
    return used.groupBy(*level).agg(total("traded", "executed"), total(F.expr("gone - used"), "removed"), total("added", "added"), total(F.expr("traded - used"), "unreconciled"))
