"""All queries of the library outside the optional subpackages."""

from . import analytics_queries, cleaning_queries, daily_queries, forecast_queries, panel_queries, streaming_queries, terms_queries, trading_queries  # noqa: F401
from .cleaning_queries import r
from .forecast_queries import MEAN, moments_view
from .registry import ORACLES, QUERIES, query, rnd, view
from .strategy import strategy_report

for _days in (180, 365, 730):
    moments_view(f"m_back{_days}", None, _days * 86_400.0)
_SIGNALS = " UNION ALL ".join(f"SELECT 'look-back {n} days' AS portfolio_id, ts, symbol, {MEAN} AS signal FROM m_back{n}" for n in (180, 365, 730))
view("tb_book", f"""
    SELECT portfolio_id, ts, symbol, s / sum(abs(s)) OVER (PARTITION BY portfolio_id, ts) * 0.02 AS w FROM (
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY portfolio_id, ts ORDER BY signal DESC, symbol DESC) <= 5 THEN CAST(1 AS DOUBLE)
                     WHEN row_number() OVER (PARTITION BY portfolio_id, ts ORDER BY signal, symbol) <= 5 THEN -1 ELSE 0 END AS s
      FROM ({_SIGNALS}) WHERE signal IS NOT NULL)""", "m_back180", "m_back365", "m_back730")  # fmt: skip
# the cash weight is 1, so each period also earns the cash return
view("tb_gain", """
    SELECT b.portfolio_id, b.ts, sum(w * coalesce(ret, 0)) + coalesce(any_value(cash_ret), 0) AS gain, any_value(cash_ret) AS cash_ret
    FROM tb_book b JOIN tb_panel p ON p.ts = b.ts AND p.symbol = b.symbol JOIN tb_cash c ON c.ts = b.ts GROUP BY 1, 2""", "tb_book", "tb_panel", "tb_cash")  # fmt: skip
view("tb_worth", """
    SELECT *, exp(coalesce(sum(CASE WHEN gain > -1 THEN ln(1 + gain) END) OVER w, 0)) AS v FROM tb_gain
    WINDOW w AS (PARTITION BY portfolio_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    QUALIFY coalesce(min(gain) OVER w, 0) > -1""", "tb_gain")
view("tb_path", """
    SELECT *, lead(v) OVER (PARTITION BY portfolio_id ORDER BY ts) / v - 1 AS ret,
           v / max(v) OVER (PARTITION BY portfolio_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM tb_worth""", "tb_worth")  # fmt: skip
_REPORT = f""", s AS (
    SELECT portfolio_id, count(*) AS periods, min(drawdown) AS low, max(gain) FILTER (gain <= -1) IS NOT NULL AS bankrupt, avg(ret) AS ret, stddev_pop(ret) AS vol, avg(ret - cash_ret) AS excess, stddev_pop(ret - cash_ret) AS risk,
           round_even(count(*) / ((epoch(max(ts)) - epoch(min(ts))) / (86400 * 365.24)), 0) AS ppy FROM tb_path GROUP BY 1)
    SELECT portfolio_id, periods, bankrupt, {r('low', 'min_drawdown', 7)}, {r('ret * ppy', 'ann_ret', 7)}, {r('vol * sqrt(ppy)', 'ann_vol_ret', 7)},
           {r('excess * ppy / (risk * sqrt(ppy) + 1e-8)', 'sharpe', 6)} FROM s"""


@query("strategy_report", _REPORT, "tb_path")
def _(spark, sf):
    out = strategy_report(spark, sf)
    return out.select("portfolio_id", "periods", "bankrupt", *(rnd(c, 7).alias(c) for c in ("min_drawdown", "ann_ret", "ann_vol_ret")), rnd("sharpe", 6).alias("sharpe"))


__all__ = ["ORACLES", "QUERIES", "strategy_report"]
