"""Derived views of the market domain over the given tables, as SQL that Spark and DuckDB both run.

``$``-marks stand for what the two dialects spell differently. Instants are epoch microseconds or milliseconds as
BIGINT, prices DECIMAL(12,6), sizes DECIMAL(24,6); strings never order anything.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_SPARK = {
    "$US(": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ",
    "$K(props)": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "$SEQ(": "sequence(",
    "$SHA(": "sha2(",
    "$/SHA": ", 256)",
    "$MAXBY(": "max_by(",
    "$MINBY(": "min_by(",
    "$LIST(": "sort_array(collect_set(",
    "$/LIST": "))",
    "$JOIN(": "array_join(",
    "$EXTRACT(": "regexp_extract(",
    "$TEXT": "STRING",
    "$UNNEST(": "explode(",
    "$EVEN(": "bround(",
    "$LAST(": "last_value(",
    "$/LAST": ", true)",
}
_DUCK = {
    "$US(": "epoch_us(",
    "$K(props)": "CAST(json_extract(props, '$.k') AS BIGINT)",
    "$SEQ(": "generate_series(",
    "$SHA(": "sha256(",
    "$/SHA": ")",
    "$MAXBY(": "arg_max(",
    "$MINBY(": "arg_min(",
    "$LIST(": "list_sort(list(DISTINCT ",
    "$/LIST": "))",
    "$JOIN(": "array_to_string(",
    "$EXTRACT(": "regexp_extract(",
    "$TEXT": "VARCHAR",
    "$UNNEST(": "unnest(",
    "$EVEN(": "round_even(",
    "$LAST(": "last_value(",
    "$/LAST": " IGNORE NULLS)",
}

#: name -> SQL over tables and views named before it.
VIEWS = {
    "ev": """SELECT event_id, user_id AS market, user_id % 8 AS series, event_id AS ordinal, $US(ts) AS us,
        CAST(floor($US(ts) / 1000) AS BIGINT) AS ms, CAST(floor($US(ts) / 864000000000) AS BIGINT) AS session,
        CAST(floor($US(ts) / 864000000000) AS BIGINT) * 2 + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS stream,
        event_type, CAST(round(value, 2) AS DECIMAL(24,6)) AS size, props FROM events""",
    "deltas": """SELECT event_id, market, series, session, stream, ordinal, us, ms, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side,
        CAST((event_id * 7 % 45 + 3) / 100.0 AS DECIMAL(12,6)) AS price,
        CAST(CASE WHEN event_type = 'signup' THEN -least(size, CAST(4 AS DECIMAL(24,6))) ELSE size END AS DECIMAL(24,6)) AS delta
        FROM ev WHERE event_type IN ('view', 'click', 'signup')""",
    "resets": "SELECT event_id, market, us, ms FROM ev WHERE event_type = 'error'",
    "trades": """SELECT event_id, market, us, ms, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS taker_side,
        CAST((event_id * 11 % 90 + 5) / 100.0 AS DECIMAL(12,6)) AS price, size FROM ev WHERE event_type = 'purchase'""",
    # every delta with its epoch (snapshots so far), running level size and whether it is applied
    "epochs": """SELECT * FROM (SELECT event_id, market, us, ms, side, price, delta, is_reset,
        sum(is_reset) OVER (PARTITION BY market ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM (
          SELECT event_id, market, us, ms, side, price, delta, 0 AS is_reset FROM deltas
          UNION ALL SELECT event_id, market, us, ms, NULL, NULL, NULL, 1 FROM resets) u) w WHERE is_reset = 0""",
    "levels": """SELECT event_id, market, us, ms, side, price, delta, epoch, CAST(sum(delta) OVER (PARTITION BY market, epoch, side, price
        ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(24,6)) AS post FROM epochs""",
    "applied": """SELECT *, cut IS NULL OR event_id < cut AS ok FROM (SELECT *, min(CASE WHEN post < 0 THEN event_id END)
        OVER (PARTITION BY market, epoch) AS cut FROM levels) c""",
    "fills": """SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS market, CAST(floor($US(l_shipdate) / 1000) AS BIGINT) AS ms,
        CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS action, CAST((l_suppkey % 99 + 1) / 100.0 AS DECIMAL(12,6)) AS price,
        CAST(round(l_quantity, 2) AS DECIMAL(24,6)) AS qty, l_linestatus, l_returnflag, CAST(round(l_discount, 2) AS DECIMAL(12,6)) AS discount FROM lineitem""",
    # probes of the queue, what models said of them, and readings of their place in it
    "probes": """SELECT event_id AS probe_id, market, ms AS ack_ms, CASE event_id % 5 WHEN 0 THEN 'filled' WHEN 1 THEN 'filled' WHEN 2 THEN 'cancelled' ELSE 'expired' END AS terminal_state, event_id % 5 > 2 AS censored,
        CASE WHEN event_id % 11 > 0 THEN ms + event_id % 700 END AS fill_ms, CASE WHEN event_id % 6 > 0 THEN ms + event_id % 900 * 10 END AS cancel_ms, CAST((event_id % 3 + 1) * 60000 AS BIGINT) AS dwell_ms, CASE WHEN event_id % 4 > 0 THEN event_id % 50 END AS queue,
        event_id % 9 > 0 AS placed FROM ev WHERE event_type = 'purchase'""",
    "modelled": """SELECT probe_id, k AS model, (probe_id + k) % 3 = 0 AS would_fill, CASE WHEN (probe_id + k) % 3 = 0 AND probe_id % 7 > 0 THEN probe_id % 900 END AS fill_time, CASE WHEN probe_id % 5 > 0 THEN probe_id % 60 END AS queue_at_entry
        FROM probes CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) m""",
    "readings": """SELECT market AS probe_id, event_id AS seq_no, CASE WHEN event_id % 6 > 0 THEN event_id * 31 % 300 END AS queue, sum(CASE WHEN event_id % 3 = 0 THEN event_id % 40 ELSE 0 END) OVER (PARTITION BY market ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS executed,
        sum(CASE WHEN event_id % 3 = 1 THEN event_id % 25 ELSE 0 END) OVER (PARTITION BY market ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS removed FROM ev""",
    # every event with its epoch and how many changes the book has seen in it; what each change left at its level
    "numbered": """SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY market, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM (
        SELECT e.event_id, e.market, e.ms, e.event_type, a.ok, a.side, a.price, a.delta, a.post,
          sum(CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY e.market ORDER BY e.event_id ROWS UNBOUNDED PRECEDING) AS epoch
        FROM ev e LEFT JOIN applied a ON a.event_id = e.event_id) u""",
    "held": """SELECT market, epoch, side, price, post AS size, event_id, ms, n AS from_n,
        lead(n) OVER (PARTITION BY market, epoch, side, price ORDER BY event_id) AS to_n FROM numbered WHERE ok""",
    # books polled from elsewhere: as they stand, as they stood some changes ago, and for days on end with faults
    "polls": """SELECT event_id AS poll_id, market, ms - event_id % 6 * 3600000 AS t0, ms AS t1, epoch, n,
        greatest(0, n - CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 5 END) AS from_n, (market + CAST(floor(ms / 864000000) AS BIGINT)) % 4 = 0 AS spoilt
        FROM numbered WHERE event_type = 'purchase'""",
    "polled": """SELECT p.poll_id, h.side, h.price, CAST(CASE WHEN p.spoilt AND h.side = 'yes' THEN h.size + 1 ELSE h.size END AS DECIMAL(24,6)) AS size
        FROM polls p JOIN held h ON h.market = p.market AND h.epoch = p.epoch AND h.from_n <= p.from_n AND (h.to_n IS NULL OR p.from_n < h.to_n) WHERE h.size > 0
        UNION ALL SELECT poll_id, 'yes', CAST(0.99 AS DECIMAL(12,6)), CAST(1 AS DECIMAL(24,6)) FROM polls WHERE spoilt""",
    # snapshots as they are stored: resets, books restated by the exchange in mid-stream, and own states; every fourth has lost nearly all of each size
    "wire": """SELECT event_id, market, ms, session AS stream, session * 864000000 AS started_ms, row_number() OVER (PARTITION BY session, market ORDER BY event_id) AS seq FROM ev""",
    "seeds": """SELECT n.event_id AS snapshot_id, n.market, n.ms, w.started_ms, w.stream, w.seq, n.epoch, n.n, n.event_id % 4 = 1 AS spoilt,
        CASE WHEN n.event_type = 'error' THEN CASE n.event_id % 3 WHEN 0 THEN 'ws_initial' WHEN 1 THEN 'ws_recovery' ELSE 'session_handoff' END
          WHEN n.event_type = 'purchase' THEN CASE WHEN n.event_id % 2 = 0 THEN 'ws_recovery' ELSE 'session_handoff' END ELSE 'local_materialized' END AS source
        FROM numbered n JOIN wire w ON w.event_id = n.event_id WHERE n.event_type = 'error' OR (n.event_type = 'purchase' AND n.event_id % 3 = 0) OR (n.ok AND n.event_id % 9 = 0)""",
    "seed_levels": """SELECT s.snapshot_id, h.side, h.price, CAST(CASE WHEN s.spoilt THEN h.size / 64 ELSE h.size END AS DECIMAL(24,6)) AS size
        FROM seeds s JOIN held h ON h.market = s.market AND h.epoch = s.epoch AND h.from_n <= s.n AND (h.to_n IS NULL OR s.n < h.to_n) WHERE h.size > 0 AND s.source <> 'ws_initial'""",
    "recorded": """SELECT n.event_id AS delta_id, n.market, n.ms, w.started_ms, w.stream, w.seq, n.side, n.price, n.delta, n.ok AS applied FROM numbered n JOIN wire w ON w.event_id = n.event_id WHERE n.ok IS NOT NULL""",
    "requests": """SELECT m.market * 3 + k AS request_id, m.market, CASE WHEN k = 1 THEN 1704067200000 ELSE 1704067200000 + m.market % 9 * 86400000 END AS from_ms,
        CASE WHEN k = 1 THEN 1704672000000 ELSE 1704672000000 + m.market % 9 * 86400000 END AS to_ms, CASE WHEN k = 2 THEN 1972 + m.market % 2 END AS to_stream, CAST(CASE WHEN k = 2 THEN 8 END AS BIGINT) AS to_seq
        FROM (SELECT DISTINCT market FROM ev) m CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x""",
    # frames as text: some cut short, without a type or a field, with a wrong side or price, of a kind that is only kept
    "frames": """SELECT ordinal, receive_ms, CASE WHEN ordinal % 17 = 0 THEN substr(whole, 1, 40) WHEN ordinal % 29 = 0 THEN replace(whole, '"type"', '"typ"') WHEN ordinal % 31 = 0 THEN replace(whole, '_dollars"', '_cents"')
          WHEN ordinal % 37 = 0 THEN replace(replace(whole, '"yes"', '"maybe"'), '"no"', '"perhaps"') WHEN ordinal % 41 = 0 THEN replace(whole, '"0.', '"x0.') WHEN ordinal % 43 = 0 THEN replace(replace(replace(whole, 'orderbook_delta', 'ticker'), '"trade"', '"ticker"'), 'orderbook_snapshot', 'ok')
          WHEN ordinal % 47 = 0 THEN replace(whole, 'market_ticker', 'ticker') ELSE whole END AS text
        FROM (SELECT event_id AS ordinal, ms AS receive_ms, concat('{"type":"', CASE event_type WHEN 'error' THEN 'orderbook_snapshot' WHEN 'purchase' THEN 'trade' ELSE 'orderbook_delta' END, '","sid":', CAST(session AS $TEXT), ',"seq":', CAST(event_id AS $TEXT), ',"msg":{"market_ticker":"M', CAST(market AS $TEXT), '",',
          CASE event_type WHEN 'error' THEN concat(CASE WHEN event_id % 3 = 0 THEN '"yes_dollars_fp":null' ELSE concat('"yes_dollars_fp":[["0.', CAST(event_id % 89 + 10 AS $TEXT), '00005","', CAST(size AS $TEXT), '"],["0.05","7"]]') END, CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"no_dollars_fp":[["0.1","2.5"]]' END)
            WHEN 'purchase' THEN concat('"trade_id":"t', CAST(event_id AS $TEXT), '","yes_price_dollars":"0.', CAST(event_id % 89 + 10 AS $TEXT), '","no_price_dollars":"0.', CAST(99 - event_id % 89 - 9 AS $TEXT), '","count_fp":"', CAST(size AS $TEXT), '","is_block_trade":', CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'null' END,
              ',"taker_', CASE WHEN event_id % 3 = 0 THEN 'outcome_' ELSE '' END, 'side":"', CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END, '","ts_ms":', CAST(ms AS $TEXT))
            ELSE concat('"price_dollars":"0.', CAST(event_id % 89 + 10 AS $TEXT), CASE WHEN event_id % 6 = 0 THEN '00015' ELSE '' END, '","delta_fp":"', CASE WHEN event_type = 'signup' THEN '-' ELSE '' END, CAST(size AS $TEXT), '","side":"', CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END, '"') END, '}}') AS whole FROM ev) w""",
    # what was seen of contracts over time; most observations change nothing
    "versions": """SELECT o_custkey AS market, CAST(floor($US(o_orderdate) / 1000) AS BIGINT) AS observed_ms, o_orderkey AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE 'active' END AS status,
        CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '' WHEN 2 THEN '' END AS result FROM orders""",
    # while a level holds a size; and what is reported of a queue, late: the own level, in some markets better ones too, and a little off
    "level_spans": """SELECT h.market, h.side, h.price, h.size, h.from_ms, coalesce(h.next_ms, e.end_ms) AS to_ms FROM (
          SELECT market, epoch, side, price, size, ms AS from_ms, lead(ms) OVER (PARTITION BY market, epoch, side, price ORDER BY event_id) AS next_ms FROM held) h
        LEFT JOIN (SELECT market, epoch, min(end_ms) AS end_ms FROM (SELECT market, epoch, ms AS end_ms FROM numbered WHERE NOT ok UNION ALL SELECT market, epoch - 1, ms FROM numbered WHERE event_type = 'error') x GROUP BY market, epoch) e
          ON e.market = h.market AND e.epoch = h.epoch WHERE h.size > 0""",
    "queue_polls": """SELECT p.probe_id, p.market, p.side, p.price, p.seq_no, p.at_ms, p.terminal_state, CASE WHEN (p.probe_id + p.seq_no) % 13 = 0 THEN NULL ELSE CAST(coalesce(sum(s.size), 0) + CAST((p.probe_id + p.seq_no) % 4 * 0.3 AS DECIMAL(12,6)) AS DECIMAL(24,6)) END AS queue
        FROM (SELECT n.event_id AS probe_id, n.market, n.side, n.price, k AS seq_no, n.ms + k * 43200000 AS at_ms, CASE n.event_id % 4 WHEN 0 THEN 'filled' WHEN 1 THEN 'cancelled' ELSE 'expired' END AS terminal_state
          FROM numbered n CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) x WHERE n.ok AND n.event_id % 5 = 0) p
        LEFT JOIN level_spans s ON s.market = p.market AND s.side = p.side AND (s.price = p.price OR (p.market % 4 = 0 AND s.price > p.price)) AND s.from_ms <= p.at_ms - 4000000 AND (s.to_ms IS NULL OR s.to_ms > p.at_ms - 4000000)
        GROUP BY p.probe_id, p.market, p.side, p.price, p.seq_no, p.at_ms, p.terminal_state""",
    # a contract's definition; 13th month and blank dates on purpose
    "markets": """SELECT p_partkey AS market, concat('KX', CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'RAIN' ELSE 'WIND' END, CAST(p_size % 4 AS $TEXT), '-',
        CASE WHEN p_partkey % 11 = 0 THEN 'SOON' ELSE concat('24', substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDECXXX', CAST(p_partkey % 13 * 3 + 1 AS INT), 3), lpad(CAST(p_partkey % 31 + 1 AS $TEXT), 2, '0')) END, '-T', CAST(p_size AS $TEXT)) AS ticker,
        CASE p_size % 6 WHEN 0 THEN 'active' WHEN 1 THEN ' Closed ' WHEN 2 THEN 'DETERMINED' WHEN 3 THEN 'settled' WHEN 4 THEN 'initialized' END AS status,
        CASE p_partkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN ' NO' WHEN 2 THEN 'Void' WHEN 3 THEN '' WHEN 4 THEN 'canceled' END AS result,
        CASE WHEN p_partkey % 5 = 0 THEN CAST((p_size % 3) * 0.5 AS DECIMAL(12,6)) END AS settlement_value,
        CASE p_partkey % 4 WHEN 0 THEN CAST(1 AS DECIMAL(12,6)) WHEN 1 THEN CAST(2 AS DECIMAL(12,6)) WHEN 2 THEN CAST(0 AS DECIMAL(12,6)) END AS notional_value,
        CASE p_size % 5 WHEN 0 THEN 'quadratic' WHEN 1 THEN 'quadratic_with_maker_fees' WHEN 2 THEN 'flat' WHEN 3 THEN 'unheard' END AS fee_type,
        CASE p_partkey % 3 WHEN 0 THEN CAST(0.5 AS DECIMAL(4,2)) WHEN 1 THEN CAST(2 AS DECIMAL(4,2)) END AS fee_multiplier, p_size, p_brand, p_type FROM part""",
}


def _expanded(text: str, given: tuple[str, ...] = ()) -> str:
    """The query with the views it names, and theirs, as common table expressions; those ``given`` are left as tables."""
    used: list[str] = []

    def need(body: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", body):
            if name in VIEWS and name not in used and name not in given:
                need(VIEWS[name])
                used.append(name)

    need(text)
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = text.strip()
    if not ctes:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes}, {body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes}, {body[4:].lstrip()}"
    return f"WITH {ctes} {body}"


def _dialect(text: str, marks: dict[str, str]) -> str:
    for mark, spelled in marks.items():
        text = text.replace(mark, spelled)
    return text


def duck(text: str) -> str:
    return _dialect(_expanded(text), _DUCK)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(spark: SparkSession, sf_dir: str, text: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run ``text`` over the tables of ``sf_dir``; names of tables are bound to frames, not to temporary views.

    ``given``: views that are there already, as a staged table that several plans read.
    """
    given = given or {}
    body = _dialect(_expanded(text, tuple(given)), _SPARK)
    used = [t for t in (*TABLES, *given) if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", body)]
    body = body.replace("{", "{{").replace("}", "}}")
    for t in used:
        body = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", body)
    return spark.sql(body, **{t: given[t] if t in given else load(spark, sf_dir, t) for t in used})


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    return query(spark, sf_dir, f"SELECT * FROM {name}", given)
