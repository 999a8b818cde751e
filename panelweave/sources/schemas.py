"""Explicit schemas of every table that is read or kept."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

_TYPES = {
    "DATE": DateType(), "STRING": StringType(), "DOUBLE": DoubleType(), "BIGINT": LongType(),
    "BOOLEAN": BooleanType(), "TIMESTAMP_NTZ": TimestampNTZType(),
}


def schema(ddl: str) -> StructType:
    """StructType.fromDDL needs a running session; schemas here must exist without one."""
    fields = (f.split() for f in ddl.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in fields])


PRICES = schema("date DATE, ticker STRING, price DOUBLE")
OHLCV = schema(
    "date DATE, ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
)
MACRO = schema("date DATE, series STRING, value DOUBLE")
UNIVERSE = schema("ticker STRING, company STRING, sector STRING, industry STRING")
RANKINGS = schema("date DATE, ticker STRING, ranker_score DOUBLE, rank_by_date BIGINT")
SIGNALS = schema(
    "run_timestamp STRING, model_name STRING, signal_date DATE, regime_price_date DATE, regime_rule STRING, "
    "regime_risk_on BOOLEAN, regime_drawdown DOUBLE, cash_weight_when_off DOUBLE, ticker STRING, "
    "final_weight DOUBLE, final_weight_before_regime DOUBLE, branches STRING, avg_ranker_score DOUBLE, best_rank BIGINT"
)
HOLDINGS = schema(
    "ticker STRING, shares DOUBLE, avg_entry_price DOUBLE, last_price DOUBLE, market_value DOUBLE, "
    "last_signal_date DATE, last_price_date DATE, last_updated STRING, source STRING, current_weight DOUBLE"
)
QUOTES = schema("ticker STRING, current_price DOUBLE, previous_close DOUBLE, quote_status STRING")
VALUE_SNAPSHOTS = schema(
    "valuation_date DATE, previous_close_value DOUBLE, current_value DOUBLE, day_pnl DOUBLE, day_return DOUBLE, "
    "cash_value DOUBLE, cash_weight DOUBLE, stock_positions BIGINT, best_ticker STRING, best_day_pnl DOUBLE, "
    "worst_ticker STRING, worst_day_pnl DOUBLE, missing_quotes STRING"
)
PERFORMANCE = schema(
    "model_name STRING, signal_date DATE, signal_price_date DATE, evaluation_date DATE, "
    "portfolio_return DOUBLE, bench_return DOUBLE, excess_return DOUBLE, beat_bench BOOLEAN, holding_count BIGINT, "
    "cash_weight DOUBLE, best_ticker STRING, best_holding_return DOUBLE, worst_ticker STRING, "
    "worst_holding_return DOUBLE, missing_tickers STRING"
)
ANCHOR = schema("inception_date DATE, inception_value DOUBLE, bench_inception_price DOUBLE")
EVENTS = schema(
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
