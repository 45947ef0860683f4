"""Exports, digests, the sealing of days and result bundles."""

import json
from decimal import Decimal

import pytest

from tidebook.sources import export, lake


@pytest.fixture()
def trades(spark):
    rows = [(f"t{i}", "s", i, f"M{i % 3}", Decimal("0.25"), Decimal("0.75"), Decimal(i), "yes", 1000 * i) for i in range(10)]
    return lake.typed(spark.createDataFrame(rows, "trade_id string, session_id string, ingest_ordinal long, market_ticker string, yes_price decimal(12,6), no_price decimal(12,6), count decimal(24,6), taker_outcome_side string, received_at_ms long"), lake.schema("trades"))


def test_scan_and_request(spark, trades, tmp_path):
    with_keys = trades.selectExpr("*", "'2024-01-0' || (ingest_ordinal % 2 + 1) AS date", "CASE WHEN ingest_ordinal > 0 THEN market_ticker END AS series")
    assert lake.write_partitioned(with_keys, str(tmp_path / "trades"), with_keys.schema) == 10
    table = export.scan(spark, str(tmp_path), "trades")
    got = export.select(table, export.Request("trades", 2000, 8000, tickers=("M1", "M2"), dates=("2024-01-01",), columns=("ingest_ordinal",)))
    assert sorted(r.ingest_ordinal for r in got.collect()) == [2, 4]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "date#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "PushedFilters" in plan and "received_at_ms" in plan.split("PushedFilters:")[1].split("]")[0]
    for bad in (export.Request("nothing"), export.Request("trades", events=("E",)), export.Request("trades", columns=("x",)), export.Request("trades", limit=0), export.Request("markets", from_ms=1)):
        with pytest.raises(ValueError):
            export.select(table, bad)


def test_text_is_lossless(spark, tmp_path):
    df = spark.createDataFrame([(Decimal("0.100000000000000001"), bytearray(b"\x00\xff"), [1, 2], None)], "d decimal(38,18), b binary, a array<int>, n string")
    for kind in ("csv", "ndjson"):
        export.write_text(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"d": "0.100000000000000001", "b": "00ff", "a": "[1,2]", "n": None}
    assert json.loads(spark.read.text(str(tmp_path / "ndjson")).first()[0]) == {"d": "0.100000000000000001", "b": "00ff", "a": "[1,2]", "n": None}


def test_digests_tell_changed_missing_and_extra_files(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(name)
    expected = spark.createDataFrame(export.digests(spark, str(tmp_path)).collect())
    assert export.verify(spark, str(tmp_path), expected).count() == 0
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "d.txt").write_text("d")
    assert {r.file: r.problem for r in export.verify(spark, str(tmp_path), expected).collect()} == {"a.txt": "digest", "b.txt": "missing", "d.txt": "extra"}


def test_a_day_is_dropped_only_when_all_rows_are_verified(spark):
    ledger = spark.createDataFrame([], "day string, state string, sealed_rows long, verified_rows long, version long")
    for to, rows in (("sealed", 10), ("archived", None), ("verified", 9)):
        ledger = export.moved(ledger, "d1", to, rows)
    with pytest.raises(ValueError, match="stays"):
        export.moved(ledger, "d1", "dropped")
    with pytest.raises(ValueError, match="cannot become"):
        export.moved(ledger, "d1", "archived")
    ledger = export.moved(export.moved(export.moved(spark.createDataFrame([], ledger.schema), "d2", "sealed", 10), "d2", "archived"), "d2", "verified", 10)
    assert lake.latest(export.moved(ledger, "d2", "dropped"), ["day"], "version").first().state == "dropped"
    exports = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", "x", True), ("b", "y", False), ("c", "x", None)], "day string, table string, verified boolean")
    assert [r.day for r in export.expirable(exports).collect()] == ["a"]
    late = spark.createDataFrame([("a", "sealed", 0), ("b", "verified", 0), ("c", "open", 9_000_000)], "day string, state string, end_ms long")
    assert [r.day for r in export.overdue(late, 10_000_000, 1).collect()] == ["a"]


def test_bundle(spark, tmp_path):
    empty = spark.createDataFrame([], "market long, price decimal(12,6)")
    tables = {n: empty for n in export.BUNDLE} | {"fills": spark.createDataFrame([(1, Decimal("0.5"))], empty.schema)}
    path = export.write_bundle(str(tmp_path), {"b": 1, "a": "x"}, tables, {"pnl": 1})
    assert path == export.write_bundle(str(tmp_path), {"a": "x", "b": 1}, tables, {"pnl": 1})
    manifest = json.loads(spark.read.text(f"{path}/manifest.json").first()[0])
    assert manifest["rows"] == {"orders": 0, "fills": 1, "positions": 0, "pnl": 0, "markouts": 0}
    assert spark.read.parquet(f"{path}/orders").schema.simpleString() == "struct<market:bigint,price:decimal(12,6)>"
    with pytest.raises(ValueError):
        export.write_bundle(str(tmp_path), {}, {"fills": empty}, {})
    assert "| a | unknown |" in export.report({"x": None}, [{"k": "a", "v": None}])


def test_contract_and_semantics(spark):
    rows = [("s", 1, 10, Decimal("0.5"), Decimal(1), Decimal(0), Decimal(1), True), ("s", 3, 11, Decimal("1.5"), Decimal(1), Decimal(1), Decimal(3), True), ("s", 2, 12, Decimal("0.5"), Decimal(1), Decimal(1), Decimal(9), False)]
    df = spark.createDataFrame(rows, "session_id string, ingest_ordinal long, received_at_ms long, price decimal(12,6), delta_count decimal(24,6), pre_count decimal(24,6), post_count decimal(24,6), applied boolean")
    assert lake.contract(df, lake.schema("deltas")) == []
    assert lake.contract(df.selectExpr("CAST(ingest_ordinal AS STRING) AS ingest_ordinal", "CAST(price AS DOUBLE) AS price", "1 AS other"), lake.schema("deltas")) == ["ingest_ordinal: string is not bigint", "price: double is not decimal(12,6)"]
    assert {r.name: r.n for r in lake.semantic_breaches(df).collect()} == {"arithmetic": 1, "price_range": 1, "order": 1}
