"""The state of markets by day: a day's history is worked out once, and a result that is first seen later is not known yet."""

from tidebook.sources import silver

DAY = 86_400_000


def test_both_tables_of_a_day_read_one_stored_history(spark):
    seen = [(1, 0, 1, "active", ""), (1, DAY - 1, 2, "closed", "yes"), (1, DAY, 3, "closed", "no"), (1, 3 * DAY, 4, "closed", "yes"), (2, DAY, 5, "active", None)]
    versions = spark.createDataFrame(seen, "market long, observed_ms long, version long, status string, result string")
    markets = spark.createDataFrame([(1, "KX", "flat", None)], "market long, series string, fee_type string, fee_multiplier decimal(4,2)")
    last, first = silver.observed(versions)
    for day, states in {"1970-01-01": {(1, "yes", DAY - 1, DAY - 1)}, "1970-01-02": {(1, "no", DAY, DAY), (2, None, DAY, None)}, "1970-01-04": {(1, "yes", 3 * DAY, DAY - 1), (2, None, DAY, None)}}.items():
        state, past = silver.market_state_of(last, first, markets, day)
        assert {(r.market, r.result, r.since_ms, r.result_first_observed_ms) for r in state.collect()} == states
        assert all("Window" not in df._jdf.queryExecution().toString() for df in (state, past))
        assert past.count() == {"1970-01-01": 2, "1970-01-02": 4, "1970-01-04": 5}[day]
        assert sorted(map(repr, silver.market_state(versions, markets, day)[1].collect())) == sorted(map(repr, past.collect()))
