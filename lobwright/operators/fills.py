"""Depth-sweep fills, round trips and trade summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobwright.functions.levels import px, sz
from lobwright.functions.scalars import KEYS, utc_day
from lobwright.operators.thin import thin
from lobwright.sources.stages import cut, per_key

EPS = 1e-9
DUST = 1e-12


@dataclass(frozen=True)
class Execution:
    latency: int = 1
    hold: int = 50
    fee_bps: float = 1.0
    spread_multiplier: float = 1.0
    depth_multiplier: float = 1.0
    partial_fill: bool = True
    min_fill_ratio: float = 0.5
    notional: float = 1000.0
    cooldown: int = 3
    # "entry": gap between entries.  "signal": a signal waits ``cooldown`` rows after the last accepted entry.
    cooldown_on: str = "entry"
    time_from: str = "entry"
    last_row: bool = False
    max_gap_us: int | None = None
    # A book whose levels follow from a few columns: these columns, and what adds ``bids`` and ``asks`` to rows that hold them.
    levels_from: tuple[str, ...] = ("bids", "asks")
    levels: Callable[[DataFrame], DataFrame] | None = None


def valid_top() -> str:
    b, a = px("bid", 0), px("ask", 0)
    return f"coalesce(mid_price > 0 and {b} > 0 and {a} > 0 and {sz('bid', 0)} > 0 and {sz('ask', 0)} > 0 and {b} <= {a}, false)"


def sweep(
    side: str, notional: float, spread_multiplier: str, depth_multiplier: str, partial_fill: bool = True
) -> Column:
    """Walks the opposite side until ``notional / mid`` is filled: struct(price, quantity, fill_ratio, slippage).

    Arguments other than ``notional`` are SQL text; the fold runs over the level array, so no row is expanded.
    """
    target = f"(double({float(notional)!r}) / greatest(mid_price, {EPS}D))"
    moved = f"(mid_price + (l.price - mid_price) * {spread_multiplier})"
    shown = f"(l.size * {depth_multiplier})"
    # What is left follows from the sum of the sizes so far, not from one subtraction after another: the last bits decide ties in rounding.
    left = f"({target} - s.seen)"
    usable = f"coalesce({left} > {DUST}D and l.price > 0 and l.size > 0 and {moved} > 0 and {shown} > 0, false)"
    take = f"least({shown}, {left})"
    start = "named_struct('seen', 0D, 'qty', 0D, 'value', 0D, 'best', double(null))"
    step = (
        f"if({usable}, named_struct('seen', s.seen + {shown}, 'qty', s.qty + {take}, "
        f"'value', s.value + {take} * {moved}, 'best', coalesce(s.best, {moved})), s)"
    )
    vwap, ratio = f"(s.value / greatest(s.qty, {EPS}D))", f"(s.qty / greatest({target}, {EPS}D))"
    filled = "s.qty > 0" if partial_fill else f"(s.qty > 0 and {ratio} >= 1)"
    nothing = "named_struct('price', 0D, 'quantity', 0D, 'fill_ratio', 0D, 'slippage', 0D)"
    finish = (
        f"if({filled}, named_struct('price', {vwap}, 'quantity', s.qty, 'fill_ratio', {ratio}, "
        f"'slippage', abs({vwap} - s.best)), {nothing})"
    )
    return F.expr(
        f"if({valid_top()}, aggregate(if({side} > 0, asks, bids), {start}, (s, l) -> {step}, s -> {finish}), {nothing})"
    )


def round_trips(
    signals: DataFrame,
    book: DataFrame,
    cfg: Execution = Execution(),
    by: tuple[str, ...] = (),
    carry: tuple[str, ...] = (),
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Entry and exit fills of every signal whose both legs fill well enough; no cooldown, no fees yet.

    ``signals``: keys, ``by``, ``event_idx``, ``action`` (not 0), ``carry``; it may override ``latency``,
    ``spread_multiplier`` and ``depth_multiplier`` per row.  ``book``: the rows replayed, with ``event_idx``,
    ``event_us``, ``regime``, ``mid_price``, ``bids``, ``asks``.  The book is met once, on (symbol, row): each signal asks
    for two rows, and when signals are few Spark broadcasts them and the book is not shuffled.  With ``cfg.levels`` the book is
    met without its levels, and only rows that are filled get them.
    """
    keys, by, carry = list(keys), list(by), list(carry)

    def setting(name, kind="double"):
        return F.col(name) if name in signals.columns else F.lit(getattr(cfg, name)).cast(kind)

    entry = F.col("event_idx") + setting("latency", "long")
    leg = F.explode(
        F.array(
            F.struct(F.lit(0).alias("leg"), entry.alias("at"), F.col("action").cast("int").alias("_side")),
            F.struct(F.lit(1).alias("leg"), (entry + cfg.hold).alias("at"), (-F.col("action")).cast("int").alias("_side")),
        )
    )
    legs = signals.select(
        *keys, *by, F.col("event_idx").alias("signal_index"), "action", *carry,
        setting("spread_multiplier").alias("_sm"), setting("depth_multiplier").alias("_dm"), leg.alias("_l"),
    ).select(*keys, *by, "signal_index", "action", *carry, "_sm", "_dm", "_l.leg", F.col("_l.at").alias("event_idx"), "_l._side")
    rows = book.select(*keys, "event_idx", "event_us", "regime", "mid_price", *cfg.levels_from)
    legs = cut(legs, "legs")  # its real size decides whether the book has to be shuffled
    last = per_key(book.groupBy(*keys).agg(F.max("event_idx").alias("_last")))
    fits = F.col("event_idx") <= F.col("_last") if cfg.last_row else F.col("event_idx") < F.col("_last")
    fill = sweep("_side", cfg.notional, "_sm", "_dm", cfg.partial_fill)
    met = legs.join(rows, [*keys, "event_idx"]).join(last, keys).filter(fits)
    filled = (
        (cfg.levels(met) if cfg.levels else met)
        .select(*keys, *by, "signal_index", "action", *carry, "leg", "event_idx", "event_us", "regime", fill.alias("_f"))
        .filter(F.col("_f.fill_ratio") >= cfg.min_fill_ratio)
    )
    side = {}
    for k, name in ((0, "_in"), (1, "_out")):
        side[name] = F.max(F.when(F.col("leg") == k, F.struct("event_idx", "event_us", "regime", "_f"))).alias(name)
    pairs = filled.groupBy(*keys, *by, "signal_index").agg(
        F.first("action").alias("action"), *[F.first(c).alias(c) for c in carry], *side.values()
    ).filter(F.col("_in").isNotNull() & F.col("_out").isNotNull())
    if cfg.max_gap_us is not None:
        pairs = pairs.filter(F.col("_out.event_us") - F.col("_in.event_us") <= cfg.max_gap_us)
    qty = F.least(F.col("_in._f.quantity"), F.col("_out._f.quantity"))
    move = F.col("_out._f.price") - F.col("_in._f.price")
    return pairs.select(
        *keys, *by, "signal_index",
        F.col("_in.event_idx").alias("entry_index"),
        F.col("_out.event_idx").alias("exit_index"),
        F.col("_in.event_us").alias("event_us"),
        F.col("_in.regime").alias("regime"),
        "action", *carry,
        qty.alias("quantity"),
        F.col("_in._f.price").alias("entry_price"),
        F.col("_out._f.price").alias("exit_price"),
        (qty * F.when(F.col("action") > 0, move).otherwise(-move)).alias("gross_pnl"),
        F.least(F.col("_in._f.fill_ratio"), F.col("_out._f.fill_ratio")).alias("fill_ratio"),
        F.col("_in._f.slippage").alias("entry_slippage"),
        F.col("_out._f.slippage").alias("exit_slippage"),
    ).filter(F.col("quantity") > 0)


def cool_down(trips: DataFrame, cfg: Execution, by: tuple[str, ...] = (), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Thins round trips.  Only trips that filled count, so a rejected fill blocks nothing."""
    gap = cfg.cooldown + (cfg.latency if cfg.cooldown_on == "signal" else 0)
    return thin(trips, [*keys, *by], "signal_index", gap)


def charge(trips: DataFrame, fee_bps=1.0) -> DataFrame:
    """Fees on the matched notional of both legs, and net PnL."""
    fee = fee_bps if isinstance(fee_bps, Column) else F.lit(float(fee_bps))
    q = F.col("quantity")
    cost = q * F.col("entry_price") * fee / F.lit(10000.0) + q * F.col("exit_price") * fee / F.lit(10000.0)
    return trips.withColumn("total_cost", cost).withColumn("net_pnl", F.col("gross_pnl") - F.col("total_cost"))


def replay(
    signals: DataFrame, book: DataFrame, cfg: Execution = Execution(), by: tuple[str, ...] = (), keys: tuple[str, ...] = KEYS
) -> DataFrame:
    trips = round_trips(signals, book, cfg, by, keys=keys)
    return charge(cool_down(trips, cfg, by, keys), cfg.fee_bps)


# ---------------------------------------------------------------- summaries

def equity_curve(trades: DataFrame, by: list[str], idx: str = "entry_index", block_rows: int = 65_536) -> DataFrame:
    """Cumulative net PnL and its running maximum per trade, from block totals and a pass inside each block."""
    t = trades.withColumn("_blk", F.floor(F.col(idx) / F.lit(block_rows)).cast("long"))
    inside = Window.partitionBy(*by, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_cum", F.sum("net_pnl").over(inside))
    t = t.withColumn("_peak", F.max("_cum").over(inside))
    blocks = t.groupBy(*by, "_blk").agg(F.sum("net_pnl").alias("_total"), F.max("_cum").alias("_top"))
    across = Window.partitionBy(*by).orderBy("_blk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    blocks = blocks.withColumn("_high", F.max(F.col("_base") + F.col("_top")).over(before))
    out = t.join(blocks.select(*by, "_blk", "_base", "_high"), [*by, "_blk"])
    return out.withColumns(
        {
            "equity": F.col("_base") + F.col("_cum"),
            "equity_peak": F.greatest(F.col("_base") + F.col("_peak"), F.col("_high")),
        }
    ).drop("_blk", "_cum", "_peak", "_base", "_high")


def summarize(trades: DataFrame, by: list[str], idx: str = "entry_index", block_rows: int = 65_536) -> DataFrame:
    """Counts, PnL, cost, turnover, trade days, cost survival and maximum drawdown per group.

    Drawdown follows the order of trades, so each block of ``block_rows`` event rows is folded into its total, highest
    and lowest equity and worst drop; the blocks, few, are then chained.  The trades themselves are read once.
    """
    fold = """aggregate(
        sort_array(collect_list(struct({idx} as at, net_pnl as net))),
        named_struct('cum', 0D, 'top', double(null), 'low', double(null), 'drop', 0D),
        (s, x) -> named_struct(
            'cum', s.cum + x.net, 'top', greatest(s.top, s.cum + x.net), 'low', least(s.low, s.cum + x.net),
            'drop', least(s.drop, s.cum + x.net - greatest(s.top, s.cum + x.net))))""".format(idx=idx)
    blocks = trades.groupBy(*by, F.expr(f"{idx} div {block_rows} as _blk")).agg(
        F.expr("count(*) as n"),
        F.expr("sum(gross_pnl) as gross"),
        F.expr("sum(total_cost) as cost"),
        F.expr("sum(abs(quantity)) as qty"),
        F.expr("sum(abs(quantity) * entry_price) as notional"),
        F.expr("collect_set(event_us div 86400000000) as days"),
        F.expr(f"{fold} as e"),
    )
    across = f"over (partition by {', '.join(by)} order by _blk rows between unbounded preceding and 1 preceding)"
    chained = blocks.selectExpr("*", f"coalesce(sum(e.cum) {across}, 0D) as _base")
    chained = chained.selectExpr("*", f"max(_base + e.top) {across} as _high")
    return (
        chained.groupBy(*by)
        .agg(
            F.expr("sum(n) as n_trades"),
            F.expr("sum(gross) as gross_pnl"),
            F.expr("sum(e.cum) as net_pnl"),
            F.expr("sum(cost) as total_cost"),
            F.expr("sum(qty) as turnover"),
            F.expr("sum(notional) as turnover_notional"),
            F.expr("sum(e.cum) / sum(n) as net_pnl_per_trade"),
            F.expr("least(min(e.drop), min(_base + e.low - _high), 0D) as max_drawdown"),
            F.expr("bigint(size(array_distinct(flatten(collect_list(days))))) as n_trade_days"),
        )
        .withColumn("cost_survival", F.expr("if(gross_pnl > 0, try_divide(net_pnl, gross_pnl), null)"))
    )


def fill_missing_groups(summary: DataFrame, spine: DataFrame, by: list[str]) -> DataFrame:
    """Groups without trades appear with zeros."""
    zeros = ["n_trades", "gross_pnl", "net_pnl", "total_cost", "turnover", "turnover_notional", "net_pnl_per_trade", "max_drawdown"]
    return spine.join(summary, by, "left").na.fill(0, [c for c in zeros if c in summary.columns])


def summarize_by_regime(trades: DataFrame, by: list[str]) -> DataFrame:
    """Overall (regime NULL, ``is_total`` true) and per-regime totals in one pass."""
    grouped = trades.select(*by, "regime", "gross_pnl", "net_pnl")
    cols = [F.col(c) for c in by]
    return grouped.groupingSets([[*cols, F.col("regime")], cols], *cols, F.col("regime")).agg(
        F.sum("gross_pnl").alias("gross_pnl"),
        F.sum("net_pnl").alias("net_pnl"),
        F.count("*").alias("n_trades"),
        (F.grouping("regime") == 1).alias("is_total"),
    )


def trade_days(trades: DataFrame, by: list[str]) -> DataFrame:
    day = trades.groupBy(*by, utc_day(F.col("event_us")).alias("_day")).agg(F.lit(1).alias("_one"))
    return day.groupBy(*by).agg(F.count("*").alias("n_trade_days"))


def worst_trades(trades: DataFrame, k: int = 25, order: tuple[str, ...] = ("symbol", "entry_index")) -> DataFrame:
    return trades.orderBy(F.round("net_pnl", 9), *order).limit(k)
