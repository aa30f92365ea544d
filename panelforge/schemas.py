"""Schemas of the tables that the jobs exchange. Missing is NULL, never NaN; session time zone is UTC."""

BARS = "symbol string, ts timestamp, open double, low double, high double, close double, adjclose double, volume double"
CLEAN_BARS = "symbol string, ts timestamp, open double, low double, high double, close double, return double, valuevolume double"
SERIES = "symbol string, ts timestamp, value double"
PANEL = "symbol string, ts timestamp, ret double, valuevolume double, price double"
COVARIANCE = "ts timestamp, sym_i string, sym_j string, n bigint, value double"
HOLDINGS = "portfolio_id string, ts timestamp, symbol string, is_cash boolean, h double"
CHART_JSON = (
    "struct<timestamp:array<bigint>,indicators:struct<"
    "quote:array<struct<open:array<double>,low:array<double>,high:array<double>,close:array<double>,volume:array<double>>>,"
    "adjclose:array<struct<adjclose:array<double>>>>>"
)
SNAPSHOTS = "map<string,map<string,double>>"
CASH = "cash"
