"""Queries that are one declarative plan: scans, scalars, joins, aggregates, windows, sets and quality checks.

Each text runs in Spark as it stands and, through :func:`tidebook.tables.duck`, as its own oracle in DuckDB.
"""

from __future__ import annotations

SQL: dict[str, str] = {
    # ---- scans
    "slice_filter": "SELECT event_id, market, series, ms FROM ev WHERE series IN (1, 3) AND ms >= 1704067200000 AND ms < 1735689600000",
    "slice_describe": "SELECT count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, count(DISTINCT market) AS markets, count(DISTINCT series) AS n_series FROM ev",
    "export_query_orders": """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND $US(o_orderdate) >= 757382400000000""",
    # ---- scalars
    "time_parts": "SELECT event_id, CAST(floor(ms / 3600000) AS BIGINT) * 3600000 AS bucket_ms, CAST(floor(ms / 60000) AS BIGINT) AS minute, CAST(floor(ms / 3600000) AS BIGINT) % 24 AS hour_utc FROM ev",
    "json_fields": "SELECT event_id, $K(props) AS k FROM events",
    # ---- joins
    "enrich_left": "SELECT event_id, e.market, c_mktsegment, n_name FROM ev e LEFT JOIN customer ON c_custkey = e.market LEFT JOIN nation ON n_nationkey = c_nationkey",
    "gap_stream_left": "SELECT r.event_id, r.market, s.streams FROM resets r LEFT JOIN (SELECT market, count(DISTINCT stream) AS streams FROM deltas GROUP BY market) s ON s.market = r.market",
    "lateral_first_seen": "SELECT o.o_orderkey, f.first_key FROM orders o LEFT JOIN (SELECT o_custkey AS c, o_orderstatus AS st, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey, o_orderstatus) f ON f.c = o.o_custkey AND f.st = o.o_orderstatus",
    "semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM deltas d WHERE d.market = c_custkey)",
    "anti_not_exists_range": """SELECT d.event_id, d.market FROM deltas d LEFT JOIN (SELECT market, min(event_id) AS seed FROM resets GROUP BY market) s
        ON s.market = d.market WHERE s.seed IS NULL OR s.seed > d.event_id""",
    "seed_lookup": """SELECT market, coalesce(before_id, after_id) AS seed FROM (SELECT market, max(CASE WHEN ms <= 1719792000000 THEN event_id END) AS before_id,
        min(CASE WHEN ms > 1719792000000 THEN event_id END) AS after_id FROM resets GROUP BY market) s""",
    "interval_overlap": """WITH spans AS (SELECT stream, min(ms) AS a, max(ms) AS b FROM ev GROUP BY stream) SELECT stream, a, b FROM spans WHERE a < 1720000000000 AND b >= 1710000000000""",
    # ---- aggregates
    "filtered_counts": "SELECT event_type, count(*) FILTER (WHERE size > 10) AS large, CAST(avg(CAST(abs(size) AS DOUBLE)) FILTER (WHERE size > 10) AS DECIMAL(18,4)) AS mean_large FROM ev GROUP BY event_type",
    "percentile_disc_latency": "SELECT event_type, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY size) AS DOUBLE) AS p50, CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY size) AS DOUBLE) AS p90, CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY size) AS DOUBLE) AS p99 FROM ev GROUP BY event_type",
    "percentile_floor_rank": """SELECT event_type, max(CASE WHEN r = least(n, CAST(floor(0.9 * n) AS BIGINT) + 1) THEN size END) AS p90 FROM (SELECT event_type, size,
        row_number() OVER (PARTITION BY event_type ORDER BY size, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ev) x GROUP BY event_type""",
    "median_exact": "SELECT event_type, CAST(median(CAST(size AS DOUBLE)) AS DECIMAL(18,4)) AS med FROM ev GROUP BY event_type",
    "distinct_list": "SELECT market, $JOIN($LIST(event_type$/LIST, ',') AS kinds FROM ev GROUP BY market",
    "having_dupes": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "pearson": """SELECT event_type, CASE WHEN count(*) >= 3 AND var_pop(CAST(size AS DOUBLE)) > 0 THEN CAST(round(corr(CAST(size AS DOUBLE), CAST(event_id % 97 AS DOUBLE)), 6) AS DECIMAL(12,6)) END AS r FROM ev GROUP BY event_type""",
    "ols_origin": """SELECT series, CASE WHEN n >= 3 AND abs(sxx) > 1e-9 THEN CAST(round(sxy / sxx, 6) AS DECIMAL(18,6)) END AS slope FROM (SELECT series, count(*) AS n,
        sum(CAST(event_id % 13 AS DOUBLE) * CAST(event_id % 13 AS DOUBLE)) AS sxx, sum(CAST(event_id % 13 AS DOUBLE) * CAST(size AS DOUBLE)) AS sxy FROM ev GROUP BY series) s""",
    "error_metrics": """SELECT side, CAST(round(avg(abs(e)), 6) AS DECIMAL(18,6)) AS mae, CAST(round(sqrt(avg(e * e)), 6) AS DECIMAL(18,6)) AS rmse, CAST(round(avg(e), 6) AS DECIMAL(18,6)) AS bias
        FROM (SELECT side, CAST(post AS DOUBLE) - 10 AS e FROM levels) x GROUP BY side""",
    "fill_breakdown_multi": """SELECT CASE WHEN grouping(action) = 0 THEN 'action' WHEN grouping(l_linestatus) = 0 THEN 'status' ELSE 'flag' END AS dimension,
        coalesce(action, l_linestatus, l_returnflag) AS bucket, count(*) AS n, CAST(sum(qty) AS DECIMAL(28,6)) AS qty FROM fills GROUP BY GROUPING SETS ((action), (l_linestatus), (l_returnflag))""",
    "minute_health": "SELECT session, CAST(floor(ms / 60000) AS BIGINT) AS minute, count(*) AS frames, count(DISTINCT market) AS markets, max(ordinal) AS last_ordinal FROM ev GROUP BY session, CAST(floor(ms / 60000) AS BIGINT)",
    "top_blocked": "SELECT market, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY market ORDER BY n DESC, market LIMIT 8",
    "inventory_time_weighted": """SELECT market, CAST(round(sum(abs(inv) * held) / nullif(sum(held), 0), 6) AS DECIMAL(24,6)) AS mean_abs FROM (SELECT market, CAST(inv AS DOUBLE) AS inv,
        CAST(lead(ms) OVER (PARTITION BY market ORDER BY ms) - ms AS DOUBLE) AS held FROM (SELECT market, ms, sum(net) OVER (PARTITION BY market ORDER BY ms) AS inv FROM (
        SELECT market, ms, sum(CASE WHEN action = 'buy' THEN qty ELSE -qty END) AS net FROM fills GROUP BY market, ms) a) b) c GROUP BY market""",
    # ---- windows
    "latest_state": "SELECT market, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY us DESC, event_id DESC) AS r FROM ev) x WHERE r = 1",
    "ordinal_holes": "SELECT market, count(*) AS holes FROM (SELECT market, ordinal, lag(ordinal) OVER (PARTITION BY market ORDER BY ordinal) AS prev FROM ev) x WHERE prev IS NOT NULL AND ordinal <> prev + 1 GROUP BY market",
    "monotone_check": "SELECT count(*) AS violations FROM (SELECT us, lag(us) OVER (PARTITION BY session ORDER BY ordinal) AS prev FROM ev) x WHERE us < prev",
    "chrono_ranks": "SELECT stream, row_number() OVER (ORDER BY first_ms, stream) AS stream_rank FROM (SELECT stream, min(ms) AS first_ms FROM ev GROUP BY stream) s",
    "capture_gaps": """WITH spans AS (SELECT session, stream, min(ms) AS first_ms, max(ms) AS last_ms, count(DISTINCT market) AS markets FROM ev GROUP BY session, stream)
        SELECT prev_stream, stream, prev_last AS started_ms, first_ms AS ended_ms, first_ms - prev_last AS duration_ms, CASE WHEN session = prev_session THEN 'restart' ELSE 'unknown' END AS reason, markets
        FROM (SELECT *, lag(last_ms) OVER w AS prev_last, lag(stream) OVER w AS prev_stream, lag(session) OVER w AS prev_session FROM spans WINDOW w AS (ORDER BY first_ms, stream)) g WHERE first_ms > prev_last""",
    "level_running": "SELECT event_id, market, side, price, epoch, post FROM levels",
    "epochs": "SELECT market, epoch, count(*) AS n, min(event_id) AS first_id FROM epochs GROUP BY market, epoch",
    "change_points": """SELECT market, event_id, post FROM (SELECT market, event_id, post, lag(post) OVER (PARTITION BY market, side, price ORDER BY event_id) AS prev FROM levels) x WHERE prev IS NULL OR prev <> post""",
    "drawdown": """SELECT market, max(peak - run) AS max_drawdown FROM (SELECT market, run, max(run) OVER (PARTITION BY market ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS peak FROM (
        SELECT market, event_id, CAST(sum(delta) OVER (PARTITION BY market ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(24,6)) AS run FROM deltas) a) b GROUP BY market""",
    "rolling_window": "SELECT event_id, count(*) OVER (PARTITION BY market ORDER BY ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS n FROM ev",
    "last_values": """SELECT event_id, last_price FROM (SELECT event_id, kind, $LAST(price$/LAST OVER (PARTITION BY market ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_price
        FROM (SELECT event_id, market, 0 AS kind, CAST(NULL AS DECIMAL(12,6)) AS price FROM deltas UNION ALL SELECT event_id, market, 1, price FROM trades) u) x WHERE kind = 0""",
    # ---- order and sets
    "observation_order": """SELECT event_id, row_number() OVER (PARTITION BY market ORDER BY session, ms, ordinal, stream, kind, event_id) AS pos FROM (
        SELECT event_id, market, session, ms, ordinal, stream, CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS kind FROM ev) x""",
    "union_ranks": "SELECT kind, count(*) AS n, min(event_id) AS first_id FROM (SELECT 'delta' AS kind, event_id FROM deltas UNION ALL SELECT 'trade', event_id FROM trades UNION ALL SELECT 'reset', event_id FROM resets) u GROUP BY kind",
    "universe_diff": "SELECT market, 'added' AS change FROM (SELECT DISTINCT market FROM deltas EXCEPT SELECT DISTINCT market FROM resets) a UNION ALL SELECT market, 'kept' FROM (SELECT DISTINCT market FROM deltas INTERSECT SELECT DISTINCT market FROM resets) b",
    # ---- book
    "consistency": "SELECT market, epoch, count(*) AS n, count(CASE WHEN price < 0 OR price > 1 THEN 1 END) AS out_of_range, count(CASE WHEN post < 0 THEN 1 END) AS negative FROM levels GROUP BY market, epoch",
    # ---- portfolio
    # ---- quality
    "contract_semantics": """SELECT count(*) AS n, count(CASE WHEN price < 0 OR price > 1 THEN 1 END) AS bad_price, count(CASE WHEN price * 100 <> floor(price * 100) THEN 1 END) AS sub_cent,
        count(CASE WHEN ordinal IS NULL THEN 1 END) AS no_ordinal, max(ordinal) > min(ordinal) AS moves FROM deltas""",
    "coverage": "SELECT series, max(CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END) AS status, min(CASE WHEN event_type = 'purchase' THEN ms END) AS exercised_ms FROM ev GROUP BY series",
    # ---- evidence, risk and calibration
    "level_activity": """SELECT market, side, price, CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS DECIMAL(24,6)) AS added, CAST(sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS DECIMAL(24,6)) AS removed, count(*) AS n FROM applied WHERE ok GROUP BY market, side, price""",
    "tracking_windows": "SELECT market, event_id, ms AS opened_ms, lead(ms) OVER (PARTITION BY market ORDER BY event_id) AS closed_ms FROM resets",
    "volume_decrease": "SELECT count(*) AS n FROM (SELECT post, lag(post) OVER (PARTITION BY market, epoch, side, price ORDER BY event_id) AS prev FROM levels) x WHERE post < prev",
    "time_difference_orders": "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE $US(o_orderdate) >= 757382400000000 GROUP BY o_orderstatus",
    # ---- calendar, identifiers and text
    "days_between": "SELECT $UNNEST($SEQ(a, b)) AS day FROM (SELECT CAST(floor(min(ms) / 86400000) AS BIGINT) AS a, CAST(floor((max(ms) - 1) / 86400000) AS BIGINT) AS b FROM ev) x",
    "group_uuid": """SELECT series, bucket, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), concat('8', substr(h, 14, 3)), concat(substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1), substr(h, 18, 3)), substr(h, 21, 12)) AS id
        FROM (SELECT DISTINCT series, session AS bucket, $SHA(concat_ws('|', CAST(series AS $TEXT), CAST(session AS $TEXT))$/SHA AS h FROM ev) x""",
    "archive_parts": """SELECT event_type AS channel, CAST(floor(ms / 3600000) AS BIGINT) AS hour, count(*) AS n, count(DISTINCT market) AS markets, CAST(floor((count(*) + 49999) / 50000) AS BIGINT) AS parts FROM ev GROUP BY event_type, CAST(floor(ms / 3600000) AS BIGINT)""",
    "status_scalars": "SELECT (SELECT count(*) FROM deltas) AS deltas, (SELECT count(*) FROM trades) AS trades, (SELECT max(ms) FROM resets) AS last_reset_ms, (SELECT count(DISTINCT market) FROM ev) AS markets",
    "staleness": "SELECT stream, (SELECT max(ms) FROM ev) - max(ms) AS silent_ms, (SELECT max(ms) FROM ev) - max(ms) > 86400000 AS stale FROM ev GROUP BY stream",
    # ---- evidence between streams
    "queue_fold": """SELECT event_id, CAST(greatest(0, 300 - (max(used) - min(used))) AS DECIMAL(24,6)) AS queue_left FROM (SELECT event_id, sum(took) OVER (PARTITION BY market, side ORDER BY at_us) AS used FROM (
          SELECT event_id, market, side, us + span AS at_us, CAST(0 AS DECIMAL(24,6)) AS took FROM deltas CROSS JOIN (SELECT CAST(0 AS BIGINT) AS span UNION ALL SELECT 864000000000) e
          UNION ALL SELECT NULL, market, side, us, CASE WHEN delta > 0 THEN delta ELSE CAST(-delta * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(24,6)) END FROM deltas) u) c WHERE event_id IS NOT NULL GROUP BY event_id""",
    # ---- recovery, coverage of days and the summary of a replay
    "recovery_episodes": """SELECT e.market, e.opened_ms, e.faults, c.closed_ms, CASE WHEN c.closed_ms IS NULL THEN 'superseded' WHEN c.closed_ms - e.opened_ms <= 259200000 THEN 'recovered' ELSE 'timed_out' END AS status FROM (
          SELECT market, turn, min(ms) AS opened_ms, count(*) AS faults FROM (SELECT market, ms, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY market ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS turn FROM ev) f WHERE event_type = 'error' GROUP BY market, turn) e
        LEFT JOIN (SELECT market, ms AS closed_ms, row_number() OVER (PARTITION BY market ORDER BY event_id) - 1 AS turn FROM trades) c ON c.market = e.market AND c.turn = e.turn""",
    "partition_runway": """SELECT first_day, last_day, last_day - first_day + 1 AS days FROM (SELECT min(day) AS first_day, max(day) AS last_day FROM (SELECT day, day - row_number() OVER (ORDER BY day) AS island FROM (SELECT DISTINCT session AS day FROM ev) d) i GROUP BY island) r""",
    "replay_summary": """SELECT market, count(*) AS n, count(DISTINCT epoch) AS epochs, count(CASE WHEN NOT ok THEN 1 END) AS rejected, count(DISTINCT epoch) = 1 AND count(CASE WHEN NOT ok THEN 1 END) = 0 AS uninterrupted FROM applied GROUP BY market""",
    "transition_pairs": """SELECT market, event_type AS was, next_type AS became, count(*) AS n FROM (SELECT market, event_type, lead(event_type) OVER (PARTITION BY market ORDER BY event_id) AS next_type FROM ev) x WHERE next_type IS NOT NULL GROUP BY market, event_type, next_type""",
    "run_summary": """SELECT f.market, f.fills, f.qty, f.notional, o.orders, CAST(floor(CAST(f.notional AS DOUBLE) / CAST(f.qty AS DOUBLE) * 1000000) AS BIGINT) AS vwap_micros FROM (SELECT market, count(*) AS fills, CAST(sum(qty) AS DECIMAL(24,6)) AS qty, CAST(sum(qty * price) AS DECIMAL(28,6)) AS notional FROM fills GROUP BY market) f
        JOIN (SELECT market, count(DISTINCT order_id) AS orders FROM fills GROUP BY market) o ON o.market = f.market""",
}
