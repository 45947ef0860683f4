"""Reports: calibration evidence, execution quality, equity, ladders, dataset health; with oracles in other terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import scalar as S
from tidebook.operators import backtest as engine
from tidebook.operators import book
from tidebook.plans.market import DAY, final_tops
from tidebook.tables import load, view

SEED, TOLERANCE = "seed-7", 1
#: Parameters of the health checks and their levels, from best to worst.
STALE_MS, AHEAD_DAYS, LEVELS = 3 * DAY, 2, ("HEALTHY", "DEGRADED", "CRITICAL")


def _ratio(total, n):
    return F.round(F.try_divide(total.cast("double"), n.cast("double")), 6).cast("decimal(18,6)")


def move_class(spark: SparkSession, d: str) -> DataFrame:
    """Every move of a reported queue by what explains it, the first of five classes; within a tolerance of one contract."""
    e = view(spark, d, "ev").selectExpr("CAST(event_id % 7 AS INT) AS q", "CAST(event_id % 5 AS INT) AS same", "CAST(event_id % 3 * 2 AS INT) AS better", "CAST(event_id % 4 * 2 AS INT) AS executed", "CAST(event_id % 6 AS INT) AS residual")
    return e.groupBy(move_of(*[F.col(c) for c in ("q", "same", "better", "executed", "residual")]).alias("class")).agg(F.count("*").alias("n"))


def move_of(q, same, better, executed, residual):
    within = lambda x: F.abs(x) < TOLERANCE
    return (
        F.when(within(q), F.when(within(same + better), "SAME_LEVEL_EXPLAINED").otherwise("STILL_UNEXPLAINED")).when(within(q - executed), "TRADE_EXPLAINED")
        .when(~within(better) & within(q - same - better), "BETTER_LEVEL_EXPLAINED").when(within(q - same), "SAME_LEVEL_EXPLAINED").when(residual < TOLERANCE, "POSSIBLE_TIMING_ALIAS").otherwise("STILL_UNEXPLAINED")
    )


def queue_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps between known readings of a probe's queue, and the least-squares share of removals that it felt."""
    w = "OVER (PARTITION BY probe_id ORDER BY seq_no)"
    steps = view(spark, d, "readings").where("queue IS NOT NULL").selectExpr(f"lag(queue) {w} - queue AS dq", f"executed - lag(executed) {w} AS dexec", f"removed - lag(removed) {w} AS drem").where("dq IS NOT NULL")
    c = F.col
    g = steps.agg(F.count("*").alias("steps"), F.count_if(c("dq") != 0).alias("moving"), F.sum("dq").alias("dq"), F.sum("dexec").alias("ex"), F.sum("drem").alias("rem"),
        F.count_if((c("dq") != 0) & (c("dexec") == 0) & (c("drem") == 0)).alias("unexplained"), F.sum((c("dq") - c("dexec")) * c("drem")).alias("num"), F.sum(c("drem") * c("drem")).alias("den"))
    return g.select("steps", "moving", _ratio(c("dq"), c("steps")).alias("mean_dq"), _ratio(c("ex"), c("steps")).alias("mean_exec"), _ratio(c("rem"), c("steps")).alias("mean_rem"), "unexplained", F.when(c("den") > 0, _ratio(c("num"), c("den"))).alias("naive_alpha"))


def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per fill model the confusion with what happened, the error of the time to fill and the bias of the queue at entry."""
    rows = view(spark, d, "modelled").join(view(spark, d, "probes").where("placed"), "probe_id")
    c, filled = F.col, F.col("terminal_state") == "filled"
    timed = c("would_fill") & filled & c("fill_time").isNotNull() & c("fill_ms").isNotNull()
    known = c("queue_at_entry").isNotNull() & c("queue").isNotNull()
    return rows.groupBy("model").agg(
        F.count("*").alias("probes"), F.count_if(c("would_fill") & filled).alias("tp"), F.count_if(c("would_fill") & ~filled).alias("fp"), F.count_if(~c("would_fill") & filled).alias("fn"), F.count_if(~c("would_fill") & ~filled).alias("tn"),
        _ratio(F.sum(F.when(timed, F.abs(c("fill_time") - (c("fill_ms") - c("ack_ms"))))), F.count_if(timed)).alias("time_error"), F.count_if(timed).alias("time_n"),
        _ratio(F.sum(F.when(known, c("queue_at_entry") - c("queue"))), F.count_if(known)).alias("queue_bias"), F.count_if(known).alias("queue_n"),
    )


def censoring(spark: SparkSession, d: str) -> DataFrame:
    """Placed, filled and censored probes and the censored ones' resting time, by planned dwell."""
    rest = F.when(F.col("censored") & F.col("cancel_ms").isNotNull(), F.col("cancel_ms") - F.col("ack_ms"))
    return view(spark, d, "probes").where("placed").groupBy("dwell_ms").agg(F.count("*").alias("n"), F.count_if(F.col("terminal_state") == "filled").alias("filled"), F.count_if("censored").alias("censored"), F.sum(rest).alias("resting_ms"))


def stratum_selection(spark: SparkSession, d: str) -> DataFrame:
    """Strata from the least sampled on; ties by a seeded hash. Of each, the market of least churn that is offered."""
    offered = view(spark, d, "ev").groupBy("market").agg(F.max("size").alias("depth"), F.count_if((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0)).alias("flow"), F.count_if(F.col("event_type") == "error").alias("churn"))
    offered = offered.withColumn("stratum", S.stratum(F.col("depth"), F.col("flow")))
    sampled = view(spark, d, "probes").groupBy("market").agg(F.count("*").alias("n")).join(offered.select("market", "stratum"), "market").groupBy("stratum").agg(F.sum("n").alias("n"))
    draw = lambda c: F.sha2(F.concat(F.lit(SEED), c.cast("string")), 256)
    first = offered.groupBy("stratum").agg(F.min_by("market", F.struct("churn", draw(F.col("market")).alias("d"))).alias("market"))
    ranked = first.join(sampled, "stratum", "left").select("stratum", "market", F.coalesce("n", F.lit(0)).alias("sampled")).withColumn("d", draw(F.col("stratum")))
    return ranked.selectExpr("stratum", "market", "sampled", "row_number() OVER (ORDER BY sampled, d) AS place")  # four rows


def exec_quality(spark: SparkSession, d: str) -> DataFrame:
    """The twenty figures of an execution report, in one row."""
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "cancelled").when(k % 7 == 1, "rejected").otherwise("done")
    orders = load(spark, d, "orders").select(k.alias("order_id"), status.alias("status"), F.when((k % 7 != 1) & (k % 10 != 0), F.lit(1000)).cast("long").alias("rested"), F.when(k % 4 != 0, 1000 + k % 5000).alias("ended"), F.lit(60).alias("quantity"))
    fills = view(spark, d, "fills").select("order_id", "qty", "price", "discount", "action", (F.col("l_linestatus") == "O").alias("maker"), F.when(F.col("market") % 5 != 0, F.lit("0.5").cast("decimal(4,2)")).alias("mid"),
        F.when(F.col("market") % 4 != 0, F.col("market") % 90).alias("queue"), F.when(F.col("l_returnflag") == "R", "crossed").otherwise("queue").alias("reason"))
    by_order = fills.groupBy("order_id").agg(F.sum("qty").alias("got"))
    captured = F.when(F.col("maker"), F.when(F.col("action") == "buy", F.col("mid") - F.col("price")).otherwise(F.col("price") - F.col("mid"))).cast("decimal(14,6)")
    rest = F.when(F.col("ended") > F.col("rested"), F.col("ended") - F.col("rested"))
    o = orders.join(by_order, "order_id", "left").agg(
        F.count("*").alias("submitted"), F.count("rested").alias("rested"), F.count_if(F.col("got") >= F.col("quantity")).alias("filled"), F.count_if(F.col("got") < F.col("quantity")).alias("partly_filled"), F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.count_if(F.col("status") == "rejected").alias("rejected"), F.count("got").alias("touched"), F.sum(rest).alias("resting_ms"), F.count(rest).alias("rest_n"))
    f = fills.agg(F.count("*").alias("fills"), F.count_if("maker").alias("maker_fills"), F.count_if(~F.col("maker")).alias("taker_fills"), F.sum("qty").cast("decimal(28,6)").alias("contracts"), F.sum(F.col("qty") * F.col("price").cast("decimal(4,2)")).cast("decimal(28,6)").alias("notional"),
        F.sum("discount").cast("decimal(28,6)").alias("fees"), F.count(captured).alias("capture_n"), F.sum(captured).alias("c"), F.count("queue").alias("queue_n"), F.sum("queue").alias("q"), F.count_if(F.col("reason") == "crossed").alias("crossed"))
    c = F.col
    return o.crossJoin(f).select(  # one row each
        "submitted", "rested", "filled", "partly_filled", "cancelled", "rejected", "fills", "maker_fills", "taker_fills", _ratio(c("touched"), c("submitted")).alias("fill_rate"), _ratio(c("cancelled"), c("fills")).alias("cancel_to_fill"),
        "contracts", "notional", "fees", _ratio(c("c"), c("capture_n")).alias("mean_capture"), "capture_n", "resting_ms", _ratio(c("resting_ms"), c("rest_n")).alias("mean_resting_ms"), "crossed", _ratio(c("q"), c("queue_n")).alias("mean_queue_at_entry"),
    )


def ladder_samples(spark: SparkSession, d: str) -> DataFrame:
    """Per series the last books of all expected members: captured are those that are there, valid or not; one hash over all, with
    ``null`` for a missing or invalid one. An empty valid book has a hash like another."""
    last = book.level_intervals(view(spark, d, "applied"), view(spark, d, "resets")).where("to_ms IS NULL")
    hashes = book.state_hash(last, ["market"])
    there = view(spark, d, "numbered").where("event_type <> 'purchase'").groupBy("market").agg(F.max_by(F.expr("epoch > 0 AND coalesce(ok, true)"), "event_id").alias("valid"))
    members = view(spark, d, "ev").select("series", "market").distinct().join(hashes, "market", "left").join(there, "market", "left")
    empty = F.sha2(F.concat(F.col("market").cast("string"), F.lit("\nyes:\nno:")), 256)
    members = members.withColumn("hash", F.when(F.coalesce("valid", F.lit(False)), F.coalesce("hash", empty)))
    counts = members.groupBy("series").agg(F.count("*").alias("expected"), F.count("valid").alias("captured"), F.count("hash").alias("vouched_for"))
    whole = book.ladder_hash(members, ["series"], "market").select("series", "hash")
    return counts.join(whole, "series").select("series", "expected", "captured", "vouched_for", (F.col("captured") == F.col("expected")).alias("complete"), "hash")


def health_checks(spark: SparkSession, d: str) -> DataFrame:
    """Eight checks of the dataset with their levels, and the worst of all."""
    ev, levels = view(spark, d, "ev"), view(spark, d, "applied")
    one = ev.agg(
        (F.max("ms") - F.max(F.when(F.col("event_type") == "view", F.col("ms")))).alias("silent"), F.count_if((F.col("event_type") == "error") & (F.col("size") > 200)).alias("write_failures"), (F.max("session") - F.min("session") + 1 - F.countDistinct("session")).alias("missing_days"),
        F.count_if((F.col("event_type") == "signup") & (F.col("size") > 400)).alias("overdue"),
    )
    holes = ev.selectExpr("ordinal", "lag(ordinal) OVER (PARTITION BY session ORDER BY ordinal) AS prev").agg(F.count_if(F.col("ordinal") != F.col("prev") + 1).alias("holes"))
    broken = levels.groupBy("market", "epoch").agg(F.max(F.col("cut").isNotNull()).alias("cut")).join(levels.groupBy("market").agg(F.max("epoch").alias("epoch")).withColumn("live", F.lit(True)), ["market", "epoch"], "left")
    gaps = broken.agg(F.count_if(F.col("cut") & F.col("live").isNotNull()).alias("outstanding"))
    checked = view(spark, d, "trades").agg(F.count_if((F.col("price") > F.lit(0.94)) & (F.col("size") > 100)).alias("confirmed"))
    series = ev.groupBy("series").agg(F.count_if(F.col("event_type") == "purchase").alias("n")).agg(F.count_if(F.col("n") == 0).alias("awaiting"))
    row = one.crossJoin(holes).crossJoin(gaps).crossJoin(checked).crossJoin(series)  # one row each
    at = lambda bad, level: F.when(bad, LEVELS.index(level)).otherwise(0)
    c = F.col
    checks = {
        "collector_heartbeat": (at(c("silent").isNull() | (c("silent") > STALE_MS), "CRITICAL"), c("silent")), "ingest_ordinal_contiguity": (at(c("holes") > 0, "CRITICAL"), c("holes")),
        "sequence_recovery": (at(c("outstanding") > 0, "CRITICAL"), c("outstanding")), "partition_runway": (at(c("missing_days") >= AHEAD_DAYS, "CRITICAL"), c("missing_days")), "database_writes": (at(c("write_failures") > 0, "CRITICAL"), c("write_failures")),
        "archive_currency": (at(c("overdue") > 0, "DEGRADED"), c("overdue")), "rest_validation": (at(c("confirmed") > 0, "DEGRADED"), c("confirmed")), "series_coverage": (F.lit(0), c("awaiting")),
    }
    listed = [F.struct(F.lit(k).alias("name"), level.alias("rank"), n.cast("long").alias("detail")) for k, (level, n) in checks.items()]
    listed.append(F.struct(F.lit("overall").alias("name"), F.greatest(*[level for level, _ in checks.values()]).alias("rank"), F.lit(None).cast("long").alias("detail")))
    names = F.array(*[F.lit(x) for x in LEVELS])
    return row.select(F.explode(F.array(*listed)).alias("x")).select("x.name", F.element_at(names, F.col("x.rank") + 1).alias("level"), "x.detail")


def _events(spark: SparkSession, d: str) -> DataFrame:
    deltas = view(spark, d, "deltas").selectExpr("market", "event_id AS seq", "ms", "'delta' AS kind", "side", "price", "delta AS size")
    trades = view(spark, d, "trades").selectExpr("market", "event_id AS seq", "ms", "'trade' AS kind", "taker_side AS side", "price", "size")
    gaps = view(spark, d, "resets").selectExpr("market", "event_id AS seq", "ms", "'gap' AS kind")
    return deltas.unionByName(trades).unionByName(gaps, allowMissingColumns=True)


def _backtest(spark: SparkSession, d: str, **more) -> DataFrame:
    from tidebook.plans.books import _shipped

    _shipped()
    return engine.run(_events(spark, d), **more)


def backtest_join_best(spark: SparkSession, d: str) -> DataFrame:
    """Every order's states of one strategy that joins both best prices."""
    return _backtest(spark, d)


def strategy_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All strategies under all fill models and three latencies."""
    return engine.summary(_backtest(spark, d, strategies=tuple(engine.STRATEGIES), models=tuple(engine.MODELS), latencies=(0, 3_600_000, DAY)))


_RAT = "CAST(round(CAST({} AS DOUBLE) / nullif(CAST({} AS DOUBLE), 0), 6) AS DECIMAL(18,6))"
_LEVEL = "CASE WHEN {} THEN '{}' ELSE 'HEALTHY' END"

ORACLES: dict[str, str] = {
    "move_class": """SELECT coalesce((SELECT min_by(c, i) FROM (VALUES (1, 'SAME_LEVEL_EXPLAINED', q = 0 AND s + b = 0), (2, 'STILL_UNEXPLAINED', q = 0), (3, 'TRADE_EXPLAINED', q = x), (4, 'BETTER_LEVEL_EXPLAINED', b <> 0 AND q = s + b),
        (5, 'SAME_LEVEL_EXPLAINED', q = s), (6, 'POSSIBLE_TIMING_ALIAS', r = 0)) v(i, c, hit) WHERE hit), 'STILL_UNEXPLAINED') AS class, count(*) AS n FROM (SELECT event_id % 7 AS q, event_id % 5 AS s, event_id % 3 * 2 AS b, event_id % 4 * 2 AS x, event_id % 6 AS r FROM events) e GROUP BY ALL""",
    "queue_steps": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY seq_no) AS k FROM readings WHERE queue IS NOT NULL), s AS (SELECT a.queue - b.queue AS dq, b.executed - a.executed AS ex, b.removed - a.removed AS rem FROM r a JOIN r b ON b.probe_id = a.probe_id AND b.k = a.k + 1)
        SELECT count(*) AS steps, count(nullif(dq, 0)) AS moving, {_RAT.format("sum(dq)", "count(*)")} AS mean_dq, {_RAT.format("sum(ex)", "count(*)")} AS mean_exec, {_RAT.format("sum(rem)", "count(*)")} AS mean_rem,
        CAST(sum(CAST(dq <> 0 AND ex + rem = 0 AS INT)) AS BIGINT) AS unexplained, {_RAT.format("sum((dq - ex) * rem)", "sum(rem * rem)")} AS naive_alpha FROM s""",
    "model_agreement": f"""SELECT model, count(*) AS probes, CAST(sum(w * f) AS BIGINT) AS tp, CAST(sum(w * (1 - f)) AS BIGINT) AS fp, CAST(sum((1 - w) * f) AS BIGINT) AS fn, CAST(sum((1 - w) * (1 - f)) AS BIGINT) AS tn,
        {_RAT.format("sum(abs(t))", "count(t)")} AS time_error, count(t) AS time_n, {_RAT.format("sum(b)", "count(b)")} AS queue_bias, count(b) AS queue_n FROM (SELECT model, CAST(would_fill AS INT) AS w, CAST(terminal_state = 'filled' AS INT) AS f,
        CASE WHEN would_fill AND terminal_state = 'filled' THEN fill_time - (fill_ms - ack_ms) END AS t, queue_at_entry - queue AS b FROM probes p JOIN modelled m ON m.probe_id = p.probe_id WHERE placed) x GROUP BY model""",
    "censoring": """SELECT dwell_ms, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (WHERE terminal_state = 'filled'), 0)::BIGINT AS filled, coalesce(sum(n) FILTER (WHERE censored), 0)::BIGINT AS censored, sum(r)::BIGINT AS resting_ms
        FROM (SELECT dwell_ms, terminal_state, censored, count(*) AS n, sum(cancel_ms - ack_ms) FILTER (WHERE censored) AS r FROM probes WHERE placed GROUP BY ALL) g GROUP BY dwell_ms""",
    "stratum_selection": f"""WITH o AS (SELECT market, (CASE WHEN max(size) < 100 THEN 'low' ELSE 'high' END) || '_depth/' || (CASE WHEN count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 2 = 0) < 3 THEN 'low' ELSE 'high' END) || '_flow' AS stratum, count(*) FILTER (WHERE event_type = 'error') AS churn FROM ev GROUP BY market),
        f AS (SELECT stratum, first(market ORDER BY churn, sha256('{SEED}' || market)) AS market FROM o GROUP BY stratum), n AS (SELECT f.stratum, f.market, (SELECT count(*) FROM probes p JOIN o ON o.market = p.market WHERE o.stratum = f.stratum) AS sampled FROM f)
        SELECT stratum, market, sampled, rank() OVER (ORDER BY sampled, sha256('{SEED}' || stratum)) AS place FROM n""",
    "exec_quality": f"""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 1 AND o_orderkey % 10 <> 0 THEN 1000 END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN 1000 + o_orderkey % 5000 END AS z, (SELECT sum(qty) FROM fills f WHERE f.order_id = o_orderkey) AS got FROM orders),
        f AS (SELECT *, CASE WHEN l_linestatus = 'O' AND market % 5 <> 0 THEN (0.5 - price) * CASE action WHEN 'buy' THEN 1 ELSE -1 END END AS cap, CASE WHEN market % 4 <> 0 THEN market % 90 END AS qq FROM fills),
        x AS (SELECT count(*) AS submitted, count(a) AS rested, count(*) FILTER (WHERE got >= 60) AS filled, count(*) FILTER (WHERE got < 60) AS partly_filled, count(*) FILTER (WHERE k % 7 = 0) AS cancelled, count(*) FILTER (WHERE k % 7 = 1) AS rejected, count(got) AS touched, CAST(sum(z - a) FILTER (WHERE z > a) AS BIGINT) AS resting_ms, count(*) FILTER (WHERE z > a) AS rn FROM o),
        y AS (SELECT count(*) AS fills, count(*) FILTER (WHERE l_linestatus = 'O') AS maker_fills, count(*) FILTER (WHERE l_linestatus <> 'O') AS taker_fills, CAST(sum(qty) AS DECIMAL(28,6)) AS contracts, CAST(sum(qty * CAST(price AS DECIMAL(4,2))) AS DECIMAL(28,6)) AS notional, CAST(sum(discount) AS DECIMAL(28,6)) AS fees,
          count(cap) AS capture_n, sum(cap) AS c, count(qq) AS qn, sum(qq) AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS crossed FROM f)
        SELECT submitted, rested, filled, partly_filled, cancelled, rejected, fills, maker_fills, taker_fills, {_RAT.format("touched", "submitted")} AS fill_rate, {_RAT.format("cancelled", "fills")} AS cancel_to_fill, contracts, notional, fees, {_RAT.format("c", "capture_n")} AS mean_capture, capture_n,
        resting_ms, {_RAT.format("resting_ms", "rn")} AS mean_resting_ms, crossed, {_RAT.format("q", "qn")} AS mean_queue_at_entry FROM x, y""",
    "ladder_samples": """WITH z AS (SELECT market, max(epoch) AS epoch, arg_max(epoch > 0 AND coalesce(ok, true), event_id) AS valid FROM numbered WHERE event_type <> 'purchase' GROUP BY market),
        l AS (SELECT h.* FROM held h JOIN z ON z.market = h.market AND z.epoch = h.epoch WHERE h.to_n IS NULL AND h.size > 0),
        h AS (SELECT z.market, CASE WHEN z.valid THEN sha256(z.market || chr(10) || 'yes:' || coalesce((SELECT string_agg(price || '@' || size, ',' ORDER BY price DESC) FROM l WHERE l.market = z.market AND side = 'yes'), '') || chr(10) || 'no:'
          || coalesce((SELECT string_agg(price || '@' || size, ',' ORDER BY price DESC) FROM l WHERE l.market = z.market AND side = 'no'), '')) END AS hash FROM z)
        SELECT series, count(*) AS expected, count(h.market) AS captured, count(hash) AS vouched_for, count(*) = count(h.market) AS complete, sha256(string_agg(m.market || '=' || coalesce(hash, 'null'), chr(10) ORDER BY CAST(m.market AS VARCHAR))) AS hash
        FROM (SELECT DISTINCT series, market FROM ev) m LEFT JOIN h ON h.market = m.market GROUP BY series""",
    "health_checks": f"""WITH c AS (SELECT (SELECT max(ms) FROM ev) - (SELECT max(ms) FROM ev WHERE event_type = 'view') AS silent, (SELECT sum(hi - lo + 1 - n) FROM (SELECT max(ordinal) AS hi, min(ordinal) AS lo, count(*) AS n, session FROM ev GROUP BY session) s) > 0 AS holey,
          (SELECT count(*) FROM (SELECT market, epoch FROM applied WHERE cut IS NOT NULL GROUP BY market, epoch) g JOIN (SELECT market, max(epoch) AS me FROM applied GROUP BY market) l ON l.market = g.market AND l.me = g.epoch) AS outstanding, (SELECT max(session) - min(session) + 1 - count(DISTINCT session) FROM ev) AS missing,
          (SELECT count(*) FROM ev WHERE event_type = 'error' AND size > 200) AS wf, (SELECT count(*) FROM ev WHERE event_type = 'signup' AND size > 400) AS od, (SELECT count(*) FROM trades WHERE price > 0.94 AND size > 100) AS cf,
          (SELECT count(*) FROM (SELECT series FROM ev EXCEPT SELECT series FROM ev WHERE event_type = 'purchase') s) AS aw, (SELECT count(*) FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.session = a.session AND b.ordinal = a.ordinal - 1) AND a.ordinal > (SELECT min(ordinal) FROM ev b WHERE b.session = a.session)) AS holes),
        r AS (SELECT unnest([struct_pack(name := 'collector_heartbeat', level := {_LEVEL.format(f"silent > {STALE_MS}", "CRITICAL")}, detail := silent), struct_pack(name := 'ingest_ordinal_contiguity', level := {_LEVEL.format("holey", "CRITICAL")}, detail := holes),
          struct_pack(name := 'sequence_recovery', level := {_LEVEL.format("outstanding > 0", "CRITICAL")}, detail := outstanding), struct_pack(name := 'partition_runway', level := {_LEVEL.format(f"missing >= {AHEAD_DAYS}", "CRITICAL")}, detail := missing),
          struct_pack(name := 'database_writes', level := {_LEVEL.format("wf > 0", "CRITICAL")}, detail := wf), struct_pack(name := 'archive_currency', level := {_LEVEL.format("od > 0", "DEGRADED")}, detail := od), struct_pack(name := 'rest_validation', level := {_LEVEL.format("cf > 0", "DEGRADED")}, detail := cf),
          struct_pack(name := 'series_coverage', level := 'HEALTHY', detail := aw)], recursive := true) FROM c)
        SELECT name, level, detail FROM r UNION ALL SELECT 'overall', CASE WHEN bool_or(level = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(level = 'DEGRADED') THEN 'DEGRADED' ELSE 'HEALTHY' END, NULL FROM r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (move_class, queue_steps, model_agreement, censoring, stratum_selection, exec_quality, ladder_samples, health_checks, backtest_join_best, strategy_matrix)
    return {f.__name__: f for f in own}
