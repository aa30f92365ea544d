"""Weight rules, trade filters and wealth curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as p, trades as t, weights as w
from . import forecast_queries, testbeds as tb  # noqa: F401 (its views)
from .cleaning_queries import r
from .panel_queries import D, s, universe
from .registry import query, rnd, shown, view

YEAR = 365.24 * 86_400
WD = f"SELECT symbol, {D}, {r('w')} FROM "
P = "portfolio_id"
PD = f"SELECT {P}, symbol, {D}, "


def signal(spark, sf):
    return tb.panel(spark, sf).where("ret is not null").select("ts", "symbol", (F.floor(F.col("ret") * 2) / 2).alias("signal"))


view("tb_signal", "SELECT ts, symbol, floor(ret * 2) / 2 AS signal FROM tb_panel WHERE ret IS NOT NULL", "tb_panel")


def weights(spark, sf):
    h = tb.holdings(spark, sf)
    return h.withColumn("w", F.col("h") / F.sum("h").over(t.book())).drop("h")


view("tb_w", "SELECT portfolio_id, ts, symbol, is_cash, h / sum(h) OVER (PARTITION BY portfolio_id, ts) AS w FROM tb_hold", "tb_hold")


def target(spark, sf):
    """Equal weights over what is held in even months, per portfolio and time."""
    own = weights(spark, sf).where("not is_cash and month(ts) % 2 = 0")
    return own.select(P, "ts", "symbol", (1.0 / F.count("*").over(t.book())).alias("w"))


view("tb_target", "SELECT portfolio_id, ts, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY portfolio_id, ts) AS w FROM tb_w WHERE NOT is_cash AND month(ts) % 2 = 0", "tb_w")


@query("w_uniform", f", u AS (SELECT ts, symbol, 1.5::DOUBLE / count(*) OVER (PARTITION BY ts) AS w FROM tb_univ), a AS (SELECT * FROM u UNION ALL SELECT ts, 'cash', 1 - sum(w) FROM u GROUP BY 1) {WD} a", "tb_univ")
def _(spark, sf):
    return shown(w.w_uniform(universe(spark, sf), 1.5))


@query("w_all_cash", f", a AS (SELECT ts, symbol, 0.0::DOUBLE AS w FROM tb_univ UNION ALL SELECT DISTINCT ts, 'cash', 1.0::DOUBLE FROM tb_univ) {WD} a", "tb_univ")
def _(spark, sf):
    return shown(w.w_all_cash(universe(spark, sf)))


@query("w_market", f", v AS (SELECT ts, symbol, w1 / nullif(w0, 0) AS x FROM m_vol), a AS (SELECT ts, symbol, x / sum(x) OVER (PARTITION BY ts) AS w FROM v WHERE x IS NOT NULL UNION ALL SELECT DISTINCT ts, 'cash', 0.0::DOUBLE FROM v WHERE x IS NOT NULL) {WD} a", "m_vol")
def _(spark, sf):
    return shown(w.w_market(tb.panel(spark, sf)))


RANKED = """k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY signal, symbol) AS up, row_number() OVER (PARTITION BY ts ORDER BY signal DESC, symbol DESC) AS down FROM tb_signal),
    g AS (SELECT ts, symbol, CASE WHEN down <= 3 THEN 1.0::DOUBLE WHEN up <= 2 THEN -1.0 ELSE 0.0 END AS s FROM k), n AS (SELECT ts, symbol, s / sum(abs(s)) OVER (PARTITION BY ts) AS w FROM g)"""


@query("w_rank_long_short", f", {RANKED}, a AS (SELECT ts, symbol, w * 2 AS w FROM n UNION ALL SELECT DISTINCT ts, 'cash', 1.0::DOUBLE FROM n) {WD} a", "tb_signal")
def _(spark, sf):
    return shown(w.w_rank_long_short(signal(spark, sf), 3, 2, 2.0))


@query("z_rank_turnover", f", {RANKED}, a AS (SELECT ts, symbol, w * 0.2 AS w FROM n UNION ALL SELECT ts, 'cash', -sum(w * 0.2) FROM n GROUP BY 1) {WD.replace('AS w', 'AS z')} a", "tb_signal")
def _(spark, sf):
    return shown(w.z_rank_turnover(signal(spark, sf), 3, 2, 0.1))


JOINED = "tb_w w LEFT JOIN tb_target g ON g.portfolio_id = w.portfolio_id AND g.ts = w.ts AND g.symbol = w.symbol"
WPD = "SELECT w.portfolio_id, w.symbol, CAST(w.ts AS DATE) AS ts, "


@query("w_fixed", f"{WPD} {r('coalesce(g.w, w.w)', 'w')} FROM {JOINED}", "tb_w", "tb_target")
def _(spark, sf):
    return shown(w.w_fixed(weights(spark, sf), target(spark, sf)), P, "symbol", "ts", "w")


@query("z_fixed", f"{WPD} {r('w.w + coalesce(g.w / 10, 0)', 'w')} FROM {JOINED}", "tb_w", "tb_target")
def _(spark, sf):
    z = target(spark, sf).withColumn("z", F.col("w") / 10).drop("w")
    return shown(w.z_fixed(weights(spark, sf), z), P, "symbol", "ts", "w")


@query("w_periodic", f"""{PD} {r("CASE WHEN month(ts) % 6 = 0 THEN CASE symbol WHEN 'Brand#1' THEN 0.6 WHEN 'Brand#2' THEN 0.4 ELSE w END ELSE w END", 'w')} FROM tb_w
    UNION ALL SELECT portfolio_id, symbol, {D}, w FROM (SELECT DISTINCT portfolio_id, ts FROM tb_w WHERE month(ts) % 6 = 0) b, (VALUES ('Brand#1', 0.6::DOUBLE), ('Brand#2', 0.4)) g(symbol, w)
    WHERE NOT EXISTS (SELECT 1 FROM tb_w w WHERE w.portfolio_id = b.portfolio_id AND w.ts = b.ts AND w.symbol = g.symbol)""", "tb_w")
def _(spark, sf):
    goal = spark.createDataFrame([("Brand#1", 0.6), ("Brand#2", 0.4)], "symbol string, w double")
    times = tb.panel(spark, sf).select("ts").where("month(ts) % 6 = 0")
    return shown(w.w_periodic(weights(spark, sf), goal, times), P, "symbol", "ts", "w")


@query("rebalance_dates", f"SELECT {D} FROM (SELECT ts, quarter(ts) AS q, lag(quarter(ts)) OVER (ORDER BY ts) AS b FROM tb_cal) WHERE q <> b", "tb_cal")
def _(spark, sf):
    return shown(w.rebalance_dates(tb.panel(spark, sf).select("ts"), "quarter"))


def _goals(spark, sf):
    return target(spark, sf).where("month(ts) = 6")


@query("w_proportional_to_target", f"""
    , c AS (SELECT ts, row_number() OVER (ORDER BY ts) AS n FROM (SELECT DISTINCT ts FROM tb_w)), q AS (SELECT DISTINCT portfolio_id, ts FROM tb_target WHERE month(ts) = 6),
    b AS (SELECT DISTINCT portfolio_id, c.ts, n FROM tb_w w JOIN c ON c.ts = w.ts), a AS (SELECT b.portfolio_id, b.ts, b.n, q.ts AS goal_ts FROM b ASOF LEFT JOIN q ON b.portfolio_id = q.portfolio_id AND b.ts <= q.ts),
    l AS (SELECT a.portfolio_id, a.ts, goal_ts, d.n - a.n AS k FROM a LEFT JOIN c d ON d.ts = goal_ts)
    SELECT w.portfolio_id, w.symbol, CAST(w.ts AS DATE) AS ts, {r('w.w + CASE WHEN k > 0 THEN (coalesce(g.w, 0) - w.w) / k ELSE 0 END', 'w')} FROM tb_w w JOIN l ON l.portfolio_id = w.portfolio_id AND l.ts = w.ts
    LEFT JOIN tb_target g ON g.portfolio_id = w.portfolio_id AND g.ts = l.goal_ts AND g.symbol = w.symbol
    UNION ALL SELECT l.portfolio_id, g.symbol, CAST(l.ts AS DATE), {r('g.w / k', 'w')} FROM l JOIN tb_target g ON g.portfolio_id = l.portfolio_id AND g.ts = l.goal_ts
    WHERE k > 0 AND NOT EXISTS (SELECT 1 FROM tb_w w WHERE w.portfolio_id = l.portfolio_id AND w.ts = l.ts AND w.symbol = g.symbol)""", "tb_w", "tb_target")
def _(spark, sf):
    return shown(w.w_proportional_to_target(weights(spark, sf), _goals(spark, sf)), P, "symbol", "ts", "w")


@query("target_faults", f"SELECT portfolio_id, {D}, round(sum(w), 6) + 0.0 AS total FROM (SELECT portfolio_id, ts, CASE WHEN month(ts) = 4 THEN w / 2 ELSE w END AS w FROM tb_target) GROUP BY 1, ts HAVING abs(sum(w) - 1) > 1e-9", "tb_target")
def _(spark, sf):
    own = target(spark, sf).withColumn("w", F.when(F.month("ts") == 4, F.col("w") / 2).otherwise(F.col("w")))
    return shown(w.target_faults(own), digits=6)


@query("w_adaptive", f", j AS (SELECT w.*, coalesce(g.w, 0) AS goal, count(g.w) OVER (PARTITION BY w.portfolio_id, w.ts) > 0 AS given FROM {JOINED}) {PD} {r('CASE WHEN given AND sqrt(sum((w - goal) * (w - goal)) OVER (PARTITION BY portfolio_id, ts)) > 0.5 THEN goal ELSE w END', 'w')} FROM j", "tb_w", "tb_target")
def _(spark, sf):
    return shown(w.w_adaptive(weights(spark, sf), target(spark, sf), 0.5), P, "symbol", "ts", "w")


@query("w_leverage_band", f", j AS (SELECT w.*, coalesce(g.w, 0) AS goal, count(g.w) OVER (PARTITION BY w.portfolio_id, w.ts) > 0 AS given, sum(CASE WHEN NOT is_cash THEN abs(w.w) END) OVER (PARTITION BY w.portfolio_id, w.ts) AS lev FROM {JOINED}) {PD} {r('CASE WHEN given AND (lev < 0.9 OR lev > 1.0) THEN goal ELSE w END', 'w')} FROM j", "tb_w", "tb_target")
def _(spark, sf):
    return shown(w.w_leverage_band(weights(spark, sf), target(spark, sf), 0.9, 1.0), P, "symbol", "ts", "w")


@query("rebalance_to_orders", f"""
    , v AS (SELECT *, sum(h) OVER (PARTITION BY portfolio_id, ts) AS v FROM tb_hold), o AS (SELECT v.*, h / v AS w, (coalesce(g.w, 0) - h / v) AS z FROM v LEFT JOIN tb_target g ON g.portfolio_id = v.portfolio_id AND g.ts = v.ts AND g.symbol = v.symbol)
    SELECT portfolio_id, o.symbol, CAST(o.ts AS DATE) AS ts, {r('w')}, {r('z')}, {r('z * v', 'u', 5)}, CASE WHEN NOT is_cash THEN round_even(z * v / price, 0) + 0.0 END AS shares FROM o LEFT JOIN tb_panel p ON p.ts = o.ts AND p.symbol = o.symbol""", "tb_hold", "tb_target", "tb_panel")
def _(spark, sf):
    out = w.rebalance_to_orders(tb.holdings(spark, sf), target(spark, sf), tb.panel(spark, sf))
    return out.select(P, "symbol", F.to_date("ts").alias("ts"), rnd("w").alias("w"), rnd("z").alias("z"), rnd("u", 5).alias("u"), (F.col("shares") + 0.0).alias("shares"))


@query("order_rejects", f"""
    , h AS (SELECT portfolio_id, ts, symbol, CASE WHEN symbol = 'Brand#3' AND month(ts) = 2 THEN NULL WHEN is_cash AND month(ts) = 5 THEN -1e12 ELSE h END AS h FROM tb_hold WHERE symbol <> 'Brand#4' OR month(ts) <> 8),
    b AS (SELECT portfolio_id, ts, count(*) FILTER (h IS NULL) AS gone, sum(h) AS v FROM h GROUP BY 1, 2)
    SELECT portfolio_id, {D}, 'missing holding' AS reason FROM b WHERE gone > 0 UNION ALL SELECT portfolio_id, {D}, 'no value' FROM b WHERE v <= 0
    UNION ALL SELECT DISTINCT portfolio_id, CAST(ts AS DATE), 'other universe' FROM tb_target g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.portfolio_id = g.portfolio_id AND h.ts = g.ts AND h.symbol = g.symbol)""", "tb_hold", "tb_target")
def _(spark, sf):
    h = tb.holdings(spark, sf).where("symbol <> 'Brand#4' OR month(ts) <> 8")
    h = h.withColumn("h", F.when(F.expr("symbol = 'Brand#3' AND month(ts) = 2"), None).when(F.expr("is_cash AND month(ts) = 5"), -1e12).otherwise(F.col("h")))
    return shown(w.order_rejects(h, target(spark, sf)))


@query("custom_policy", f", g AS (SELECT ts, symbol, price / sum(price) OVER (PARTITION BY ts) * CASE WHEN year(ts) = 1997 THEN 0.5 ELSE 1 END AS w FROM tb_panel) SELECT symbol, {D}, {r('w')}, abs(sum(w) OVER (PARTITION BY ts) - 1) <= 1e-9 AS ok FROM g", "tb_panel")
def _(spark, sf):
    from pyspark.sql import Window

    def by_price(own):
        share = F.col("price") / F.sum("price").over(Window.partitionBy("ts"))
        return own.select("ts", "symbol", (share * F.when(F.year("ts") == 1997, 0.5).otherwise(1.0)).alias("w"))

    return shown(w.custom_policy(tb.panel(spark, sf), by_price))


# ---- trades ----------------------------------------------------------------------------------------------------------

U = f"SELECT portfolio_id, symbol, {D}, {r('u + 0.0000123457', 'u', 4)} FROM "  # the shift keeps exact halves, which libraries round differently, from the last digit
FINANCED = "CASE WHEN is_cash THEN -coalesce(sum(CASE WHEN NOT is_cash THEN {0} END) OVER (PARTITION BY portfolio_id, ts), 0) ELSE {0} END"
view("tb_marked", "SELECT t.portfolio_id, t.ts, t.symbol, is_cash, u, CASE WHEN month(t.ts) = 7 AND t.symbol = 'Brand#6' THEN 0 ELSE valuevolume END AS vv, price FROM tb_trade t LEFT JOIN tb_panel p ON p.ts = t.ts AND p.symbol = t.symbol", "tb_trade", "tb_panel")
view("tb_f1", "SELECT * REPLACE (CASE WHEN NOT is_cash AND NOT coalesce(vv > 0, false) THEN 0 ELSE u END AS u) FROM tb_marked", "tb_marked")
view("tb_f2", "SELECT * REPLACE (CASE WHEN NOT is_cash AND abs(u) > 0.05 * vv THEN sign(u) * (0.05 * vv) ELSE u END AS u) FROM tb_f1", "tb_f1")
view("tb_f3", f"SELECT * REPLACE ({FINANCED.format('x')} AS u) FROM (SELECT *, coalesce(round_even(u / price, 0) * price, u) AS x FROM tb_f2)", "tb_f2")
view("tb_f4", "SELECT * REPLACE (CASE WHEN abs(u) < 2000 THEN 0 ELSE u END AS u) FROM tb_f3", "tb_f3")
view("tb_f5", f"SELECT * REPLACE ({FINANCED.format('u')} AS u) FROM tb_f4", "tb_f4")


def _market(spark, sf):
    quiet = F.expr("month(ts) = 7 AND symbol = 'Brand#6'")
    return tb.panel(spark, sf).withColumn("valuevolume", F.when(quiet, 0.0).otherwise(F.col("valuevolume")))


def _marked(spark, sf):
    return t.with_market(tb.trades(spark, sf), _market(spark, sf))


def _u(df):
    return shown(df.withColumn("u", F.col("u") + 0.0000123457), P, "symbol", "ts", "u", digits=4)


@query("self_financing", f"{U} tb_trade", "tb_trade")
def _(spark, sf):
    return _u(tb.trades(spark, sf))


@query("cancel_untraded", f"{U} tb_f1", "tb_f1")
def _(spark, sf):
    return _u(t.cancel_untraded(_marked(spark, sf)))


@query("cap_liquidity", f"{U} tb_f2", "tb_f2")
def _(spark, sf):
    return _u(t.cap_liquidity(t.cancel_untraded(_marked(spark, sf))))


@query("round_to_shares", f"{U} tb_f3", "tb_f3")
def _(spark, sf):
    return _u(t.round_to_shares(t.cap_liquidity(t.cancel_untraded(_marked(spark, sf)))))


@query("reject_small", f"{U} tb_f4", "tb_f4")
def _(spark, sf):
    return _u(t.reject_small(t.round_to_shares(t.cap_liquidity(t.cancel_untraded(_marked(spark, sf)))), 2000.0))


@query("apply_trade_filters", f"{U} tb_f5", "tb_f5")
def _(spark, sf):
    return _u(t.apply_trade_filters(tb.trades(spark, sf), _market(spark, sf), smallest=2000.0))


view("tb_ret_cash", "SELECT ts, symbol, ret FROM tb_panel UNION ALL SELECT ts, 'cash', cash_ret FROM tb_cash", "tb_panel", "tb_cash")


def returns_with_cash(spark, sf):
    own = tb.panel(spark, sf)
    return p.with_cash_rows(own, p.add_cash(own, tb.rates(spark, sf), 12.0)).select("ts", "symbol", "ret")


AFTER = "(h + u - CASE WHEN h.is_cash THEN paid ELSE 0 END)"


@query("step_holdings", f"""
    SELECT h.portfolio_id, h.symbol, CAST(h.ts AS DATE) AS ts, {r(f'CASE WHEN {AFTER} = 0 THEN 0 ELSE {AFTER} * (1 + ret) END', 'h_next', 2)} FROM tb_hold h JOIN tb_trade t ON t.portfolio_id = h.portfolio_id AND t.ts = h.ts AND t.symbol = h.symbol
    JOIN (SELECT portfolio_id, ts, sum(abs(u)) * 0.001 AS paid FROM tb_trade WHERE NOT is_cash GROUP BY 1, 2) c ON c.portfolio_id = h.portfolio_id AND c.ts = h.ts LEFT JOIN tb_ret_cash r ON r.ts = h.ts AND r.symbol = h.symbol""", "tb_hold", "tb_trade", "tb_ret_cash")
def _(spark, sf):
    u = tb.trades(spark, sf)
    costs = u.where("not is_cash").groupBy(P, "ts").agg((F.sum(F.abs("u")) * 0.001).alias("value"))
    return shown(t.step_holdings(tb.holdings(spark, sf), u, returns_with_cash(spark, sf), costs), P, "symbol", "ts", "h_next", digits=2)


@query("adjust_universe", f"""
    , l AS (SELECT portfolio_id, ts, sum(h) AS lost FROM tb_hold h WHERE NOT is_cash AND NOT EXISTS (SELECT 1 FROM tb_univ u WHERE u.ts = h.ts AND u.symbol = h.symbol) GROUP BY 1, 2)
    SELECT portfolio_id, symbol, {D}, {r('h', digits=2)} FROM (
      SELECT portfolio_id, ts, symbol, h FROM tb_hold h WHERE NOT is_cash AND EXISTS (SELECT 1 FROM tb_univ u WHERE u.ts = h.ts AND u.symbol = h.symbol)
      UNION ALL SELECT portfolio_id, ts, symbol, h + coalesce(lost, 0) FROM tb_hold LEFT JOIN l USING (portfolio_id, ts) WHERE is_cash
      UNION ALL SELECT b.portfolio_id, b.ts, u.symbol, 0.0 FROM (SELECT DISTINCT portfolio_id, ts FROM tb_hold) b JOIN tb_univ u ON u.ts = b.ts
        WHERE NOT EXISTS (SELECT 1 FROM tb_hold h WHERE h.portfolio_id = b.portfolio_id AND h.ts = b.ts AND h.symbol = u.symbol))""", "tb_hold", "tb_univ")
def _(spark, sf):
    return shown(t.adjust_universe(tb.holdings(spark, sf), universe(spark, sf)), P, "symbol", "ts", "h", digits=2)


view("tb_shorted", "SELECT portfolio_id, ts, symbol, is_cash, CASE WHEN is_cash THEN h - 9e5 ELSE h END AS h FROM tb_hold", "tb_hold")


@query("is_bankrupt", "SELECT portfolio_id, CAST(min(ts) AS DATE) AS since FROM (SELECT portfolio_id, ts FROM tb_shorted GROUP BY 1, 2 HAVING sum(h) <= 0) GROUP BY 1", "tb_shorted")
def _(spark, sf):
    h = tb.holdings(spark, sf).withColumn("h", F.when(F.col("is_cash"), F.col("h") - 9e5).otherwise(F.col("h")))
    return shown(t.is_bankrupt(h))


BM = "SELECT portfolio_id, CAST(t.ts AS DATE) AS ts, {} FROM tb_target t LEFT JOIN tb_ret_cash r ON r.ts = t.ts AND r.symbol = t.symbol GROUP BY 1, 2"


@query("benchmark_return", BM.format(r("sum(w * coalesce(ret, 0))", "bm_ret")), "tb_target", "tb_ret_cash")
def _(spark, sf):
    whole = returns_with_cash(spark, sf).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return shown(t.benchmark_return(target(spark, sf), whole, by=[P]))


@query("benchmark_return_gaps", BM.format(r("CASE WHEN count(*) = count(ret) THEN sum(w * ret) END", "bm_ret")), "tb_target", "tb_ret_cash")
def _(spark, sf):
    return shown(t.benchmark_return(target(spark, sf), returns_with_cash(spark, sf), by=[P]))


view("tb_mix", "SELECT 'a' AS portfolio_id, 'Brand#1' AS symbol, 0.05::DOUBLE AS w UNION ALL SELECT 'a', 'Brand#2', 0.04 UNION ALL SELECT 'a', 'cash', 0.91 UNION ALL SELECT 'b', 'Brand#3', 0.02 UNION ALL SELECT 'b', 'cash', 0.98")


def _mix(spark):
    rows = [("a", "Brand#1", 0.05), ("a", "Brand#2", 0.04), ("a", "cash", 0.91), ("b", "Brand#3", 0.02), ("b", "cash", 0.98)]
    return spark.createDataFrame(rows, "portfolio_id string, symbol string, w double")


GROWTH = "exp(coalesce(sum(ln(1 + {})) OVER (PARTITION BY {} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"


def filled(spark, sf):
    return returns_with_cash(spark, sf).withColumn("ret", F.coalesce("ret", F.lit(0.0)))


view("tb_ret_filled", "SELECT ts, symbol, coalesce(ret, 0) AS ret FROM tb_ret_cash", "tb_ret_cash")
view("tb_mix_n", "SELECT portfolio_id, count(*) AS n FROM tb_mix GROUP BY 1", "tb_mix")
KNOWN = "CASE WHEN coalesce(count(*) FILTER (WHERE {0} IS NULL) OVER (PARTITION BY {1} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN {2} END"


def _register_curves(gaps: str, source: str, returns) -> None:
    """Curves over returns without gaps, and over some with gaps, after which a portfolio's value is not known."""
    growth = KNOWN.format("ret", "symbol", GROWTH.format("ret", "symbol"))
    grid = f"(SELECT m.portfolio_id, n, c.ts FROM tb_mix_n m, (SELECT DISTINCT ts FROM {source}) c) k"

    @query(f"buy_and_hold_curve{gaps}", f""", g AS (SELECT ts, symbol, {growth} AS g FROM {source}), s AS (SELECT portfolio_id, ts, count(g) AS found, sum(w * 100 * g) AS total FROM g JOIN tb_mix USING (symbol) GROUP BY 1, 2)
        SELECT k.portfolio_id, CAST(k.ts AS DATE) AS ts, {r('CASE WHEN found = n THEN total END', 'v', 4)} FROM {grid} LEFT JOIN s ON s.portfolio_id = k.portfolio_id AND s.ts = k.ts""", source, "tb_mix", "tb_mix_n")
    def _(spark, sf):
        return shown(t.buy_and_hold_curve(_mix(spark).withColumn("h", F.col("w") * 100), returns(spark, sf)), digits=4)

    @query(f"constant_mix_curve{gaps}", f""", q AS (SELECT portfolio_id, ts, count(ret) AS found, sum(w * ret) AS total FROM {source} JOIN tb_mix USING (symbol) GROUP BY 1, 2),
        s AS (SELECT k.portfolio_id, k.ts, CASE WHEN found = n THEN total END AS r FROM {grid} LEFT JOIN q ON q.portfolio_id = k.portfolio_id AND q.ts = k.ts)
        SELECT portfolio_id, {D}, {r(KNOWN.format('r', 'portfolio_id', GROWTH.format('r', 'portfolio_id')), 'v', 6)} FROM s""", source, "tb_mix", "tb_mix_n")
    def _(spark, sf):
        return shown(t.constant_mix_curve(_mix(spark), returns(spark, sf)), digits=6)

    @query(f"drifted_weights{gaps}", f""", g AS (SELECT w.portfolio_id, w.ts, w.symbol, CASE WHEN w = 0 THEN 0 ELSE w * (1 + ret) END AS g FROM tb_w w LEFT JOIN {source} r ON r.ts = w.ts AND r.symbol = w.symbol)
        {PD} {r('g / CASE WHEN count(*) OVER (PARTITION BY portfolio_id, ts) = count(g) OVER (PARTITION BY portfolio_id, ts) THEN sum(g) OVER (PARTITION BY portfolio_id, ts) END', 'w', 6)} FROM g""", "tb_w", source)
    def _(spark, sf):
        return shown(t.drifted_weights(weights(spark, sf), returns(spark, sf)), P, "symbol", "ts", "w", digits=6)


_register_curves("", "tb_ret_filled", filled)
_register_curves("_gaps", "tb_ret_cash", returns_with_cash)
