"""Book features: per-row geometry, order flow, returns, rolling statistics and regime inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.functions.levels import BOOK_LEVELS, SIDES, Levels, add, px, sz
from lobwright.functions.scalars import KEYS
from lobwright.operators.chunks import (
    CHUNK_ROWS,
    ChunkSql,
    add_rolling_median,
    add_rolling_z,
    add_trailing,
    chunk_window,
    drop_halo,
    sample_std,
    with_halo,
)
from lobwright.sources.stages import per_key

EPS = 1e-9
DEPTH_LEVELS = (1, 3, 5, 10, 20)
HORIZONS = (10, 50, 100)
WINDOWS = (20, 100, 500)
Z_ROWS = 300
LOOK_BACK = 501

# Names of the stored core columns, in order.
CORE_COLUMNS = (
    "origin_time", "received_time", "sequence_number", "symbol", "exchange", "event_time",
    "mid_price", "spread", "rel_spread", "microprice_deviation",
    "depth_imbalance_1", "depth_imbalance_5", "depth_imbalance_10", "total_depth_10",
    "ofi_1", "ofi_5", "realized_vol_20", "realized_vol_100", "spread_z_1m", "depth_z_1m",
    "liquidity_drought_score", "adverse_selection_score", "momentum_score", "choppiness_score",
    "latency_sensitivity_score", "depth_drop_top10", "vol_score",
    "future_ret_h", "cost_threshold_t", "label_horizon_events", "label_fee_bps", "label",
)


# ---------------------------------------------------------------- per-row

def price_features(df: DataFrame, eps: float = EPS) -> DataFrame:
    """Mid, spread, relative spread, microprice and its deviation."""
    lv = Levels(df.columns)
    b, a, bs, az = lv.px("bid", 0), lv.px("ask", 0), lv.sz("bid", 0), lv.sz("ask", 0)
    d = add(df, {"mid_price": f"({b} + {a}) / 2D", "spread": f"{a} - {b}"})
    d = add(
        d,
        {
            "rel_spread": f"spread / (mid_price + {eps}D)",
            "microprice": f"({a} * {bs} + {b} * {az}) / ({bs} + {az} + {eps}D)",
        },
    )
    return add(d, {"microprice_deviation": f"(microprice - mid_price) / (mid_price + {eps}D)"})


def depth_features(df: DataFrame, depth_levels: tuple[int, ...] = DEPTH_LEVELS, eps: float = EPS) -> DataFrame:
    """Depth, imbalance, ratio and slope over the first K levels of each side."""
    lv = Levels(df.columns)
    d = add(df, {f"{s}_depth_{k}": lv.depth(s, k) for k in depth_levels for s in SIDES})
    out: dict[str, str] = {}
    for k in depth_levels:
        b, a = f"bid_depth_{k}", f"ask_depth_{k}"
        out[f"total_depth_{k}"] = f"{b} + {a}"
        out[f"depth_imbalance_{k}"] = f"({b} - {a}) / ({b} + {a} + {eps}D)"
        out[f"depth_ratio_{k}"] = f"{b} / ({a} + {eps}D)"
        for s in SIDES:
            out[f"book_slope_{s}_{k}"] = f"{s}_depth_{k} / (abs({lv.px(s, 0)} - {lv.px(s, k - 1)}) + {eps}D)"
    return add(d, out)


def _distance(side: str) -> str:
    best = px(side, 0)
    gap = f"{best} - l.price" if side == "bid" else f"l.price - {best}"
    return f"({gap}) / (mid_price + {EPS}D)"


def distance_features(df: DataFrame) -> DataFrame:
    """Distance of each level from the best price as an array per side, and the size-weighted mean distance.

    Needs ``mid_price`` and the 1- and 20-level depths.
    """
    out: dict[str, str] = {}
    for s in SIDES:
        total = f"({s}_depth_{BOOK_LEVELS} + {EPS}D)"
        out[f"{s}_price_distance"] = f"transform({s}s, l -> {_distance(s)})"
        weighted = f"aggregate({s}s, 0D, (acc, l) -> acc + coalesce({_distance(s)} * l.size, 0D))"
        out[f"{s}_depth_weighted_distance"] = f"{weighted} / {total}"
        out[f"top_depth_share_{s}"] = f"{s}_depth_1 / {total}"
    return add(df, out)


def tensor_columns(df: DataFrame) -> DataFrame:
    """Normalised price and log size per level, one array per side and field."""
    out = {}
    for s in SIDES:
        out[f"{s}_price_norm"] = f"transform({s}s, l -> (l.price - mid_price) / (mid_price + {EPS}D))"
        out[f"{s}_size_log1p"] = f"transform({s}s, l -> log1p(greatest(l.size, 0D)))"
    return add(df, out)


def level_vector(levels: int = 10, scaler: dict[int, tuple[float, float]] | str | None = None) -> Column:
    """The model input of one row: ask price, ask size, bid price, bid size per level, as ``array<float>``.

    ``scaler`` holds a mean and a deviation for some cells, or names a column of ``fit_vector_scaler``, which covers all cells.
    """
    # Lambdas bind the mid and each cell, so the code of a row stays short however many levels there are.
    mid = f"(({px('bid', 0)} + {px('ask', 0)}) / 2D)"
    raw = ", ".join(cell for i in range(levels) for s in ("ask", "bid") for cell in (px(s, i), sz(s, i)))

    def finite(x: str) -> str:
        return f"if(abs(nanvl(coalesce({x}, 0D), 0D)) = double('Infinity'), 0D, nanvl(coalesce({x}, 0D), 0D))"

    cell = "if(k % 2 = 0, if(abs(m) < 1e-12D, 0D, try_divide(x - m, m)), log1p(greatest(x, 0D)))"
    cells = f"transform(array({mid}), m -> transform(array({raw}), (x, k) -> {cell}))[0]"
    cells = f"transform({cells}, x -> {finite('x')})"
    if isinstance(scaler, str):
        scaled = f"transform({cells}, (x, k) -> try_divide(double(float(x)) - {scaler}.mean[k], {scaler}.std[k]))"
        cells = f"transform({scaled}, x -> {finite('x')})"
    elif scaler:
        by_cell = [scaler.get(k, (0.0, 1.0)) for k in range(4 * levels)]
        means, stds = (", ".join(f"{float(v)!r}D" for v in c) for c in ([m for m, _ in by_cell], [s or 1.0 for _, s in by_cell]))
        cells = f"transform({cells}, (x, k) -> (x - array({means})[k]) / array({stds})[k])"
    return F.expr(f"transform({cells}, x -> float(x))")


def compact(df: DataFrame) -> DataFrame:
    """Core columns that exist, plus the book."""
    keep = [c for c in CORE_COLUMNS if c in df.columns]
    extra = [c for c in ("event_us", "event_idx", "bids", "asks") if c in df.columns]
    return df.select(*keep, *extra)


# ---------------------------------------------------------------- sequence features (inside a chunk)

def order_flow(df: DataFrame, win: ChunkSql, levels: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Order-flow imbalance, accumulated over levels.  The first row of a symbol has none."""
    top = max(levels)
    lv = Levels(df.columns)
    if lv.wide:
        d = add(df, {f"_prev_{s}_{i}_{f}": win.lag(f"{s}_{i}_{f}") for s in SIDES for i in range(top) for f in ("price", "size")})
    else:
        d = add(df, {f"_prev_{s}s": win.lag(f"slice({s}s, 1, {top})") for s in SIDES})

    def change(side: str, i: int) -> str:
        now, size = lv.px(side, i), lv.sz(side, i)
        price, was = f"_prev_{now}", f"_prev_{size}"
        better = ">" if side == "bid" else "<"
        return f"case when {now} {better} {price} then {size} when {now} = {price} then {size} - {was} else -{was} end"

    d = add(d, {f"ofi_level_{i + 1}": f"coalesce(({change('bid', i)}) - ({change('ask', i)}), 0D)" for i in range(top)})
    sums = {f"ofi_{k}": " + ".join(f"ofi_level_{i + 1}" for i in range(k)) for k in levels}
    return add(d, sums).drop(*[c for c in d.columns if c.startswith("_prev_")])


def return_features(
    df: DataFrame, win: ChunkSql, horizons: tuple[int, ...] = HORIZONS, windows: tuple[int, ...] = WINDOWS
) -> DataFrame:
    """Past returns, realised volatility, absolute-return sums, lag-1 autocorrelation and flip rate."""
    d = add(df, {f"_mid_{k}": win.lag("mid_price", k) for k in (1, *horizons)} | {"_pos": win.position()})
    cols = {"one_step": "coalesce(try_divide(mid_price, _mid_1) - 1D, 0D)"}
    for k in horizons:
        cols[f"mid_return_{k}"] = f"coalesce((mid_price - _mid_{k}) / (_mid_{k} + {EPS}D), 0D)"
        cols[f"log_return_{k}"] = f"coalesce(ln((mid_price + {EPS}D) / (_mid_{k} + {EPS}D)), 0D)"
    d = add(add(d, cols), {"_r1": win.lag("one_step")})
    d = add(d, {"_flip": "if(signum(one_step) = signum(_r1), 0D, 1D)"})
    # Lag-1 pairs of the last n rows are the last n - 1 rows that have a predecessor: x before, y now.
    d = add(d, {"_x": "coalesce(_r1, 0D)", "_y": "if(_r1 is null, 0D, one_step)", "_size": "abs(one_step)"})
    d = add(d, {"_xx": "_x * _x", "_yy": "_y * _y", "_xy": "_x * _y"})
    pairs_of = ("_x", "_y", "_xx", "_yy", "_xy")
    d = add_trailing(d, win, {"_size": set(windows), "_flip": set(windows), **{c: {n - 1 for n in windows} for c in pairs_of}}, {"one_step": set(windows)})
    out: dict[str, str] = {}
    for n in windows:
        need, cnt = max(2, n // 4), f"least(_pos, {n})"
        gate = f"{cnt} >= {need}"
        out[f"realized_vol_{n}"] = f"if({gate}, {sample_std(cnt, f'_m2_one_step_{n}')}, 0D)"
        out[f"abs_return_{n}"] = f"if({gate}, _sum__size_{n}, 0D)"
        out[f"up_down_flip_rate_{n}"] = f"if({gate}, _sum__flip_{n} / {cnt}, 0D)"
        pairs = f"least(_pos - 1, {n - 1})"
        k = f"greatest({pairs}, 1)"
        x, y, xx, yy, xy = (f"_sum_{c}_{n - 1}" for c in pairs_of)
        vx, vy = f"({xx} - {x} * {x} / {k})", f"({yy} - {y} * {y} / {k})"
        corr = f"if({vx} > 1e-24D and {vy} > 1e-24D, ({xy} - {x} * {y} / {k}) / sqrt({vx} * {vy}), 0D)"
        out[f"return_autocorr_{n}"] = f"if({pairs} >= {max(2, need - 1)}, {corr}, 0D)"
    gone = [f"_mid_{k}" for k in (1, *horizons)] + [c for c in d.columns if c.startswith(("_sum_", "_mean_", "_m2_"))] + [*pairs_of, "_r1", "_flip", "_size"]
    return add(d, out).drop(*gone)


def regime_features(df: DataFrame, win: ChunkSql, z_rows: int = Z_ROWS) -> DataFrame:
    """Rolling z-scores and the scores the regime rules read, but for ``depth_drop``."""
    d = add_rolling_z(
        df,
        {
            "vol_score": "realized_vol_100",
            "spread_z_1m": "rel_spread",
            "depth_z_1m": "total_depth_10",
            "ofi_proxy_score": "abs(ofi_5)",
            "momentum_score": "mid_return_50",
            "adverse_selection_score": "abs(mid_return_50)",
        },
        win,
        z_rows,
        max(20, z_rows // 5),
        EPS,
    )
    return add(
        d,
        {
            "spread_score": "spread_z_1m",
            "depth_score": "depth_z_1m",
            "imbalance_score": "abs(depth_imbalance_10)",
            "top_level_depletion_flag": "top_depth_share_bid < 0.05D",
            "spread_widening_flag": "spread_z_1m > 1D",
            "liquidity_drought_score": "spread_z_1m - depth_z_1m",
            "choppiness_score": "up_down_flip_rate_100",
            "latency_sensitivity_score": "abs(realized_vol_100) + abs(rel_spread)",
        },
    )


def depth_drop(df: DataFrame, rows: int = Z_ROWS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Depth against its trailing median.  The warm-up uses the rows there are; a median over the whole table would
    look ahead.  The last step inside a chunk, see ``add_rolling_median``."""
    d = add_rolling_median(df, "total_depth_10", rows, "_med", keys)
    return add(d, {"depth_drop_top10": f"(total_depth_10 - _med) / (abs(_med) + {EPS}D)"}).drop("_med")


def sequence_features(
    df: DataFrame, chunk_rows: int = CHUNK_ROWS, keys: tuple[str, ...] = KEYS, columns: tuple[str, ...] | None = None
) -> DataFrame:
    """Order flow, returns and regime inputs in one chunked pass: a single exchange and a single sort.

    ``columns`` names what to keep; without ``depth_drop_top10`` among them everything stays in the JVM.
    """
    win = ChunkSql(keys)
    out = return_features(order_flow(with_halo(df, back=LOOK_BACK, chunk_rows=chunk_rows), win), win)
    out = regime_features(out, win)
    if columns is None:
        return drop_halo(depth_drop(out, keys=keys))
    wanted = [c for c in columns if c != "depth_drop_top10"]
    if len(wanted) == len(columns):
        return drop_halo(out).select(*columns)
    hidden = [c for c in ("event_idx", "total_depth_10", *keys) if c not in wanted]
    return drop_halo(depth_drop(out.select("_chunk", "_home", *wanted, *hidden), keys=keys)).select(*columns)


def small_feature_set(df: DataFrame, chunk_rows: int = CHUNK_ROWS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The reduced feature set: other windows and gates, the same machinery."""
    eps = 1e-12
    win = ChunkSql(keys)
    d = with_halo(depth_features(price_features(df, eps), (1, 5, 10, 20), eps), back=200, chunk_rows=chunk_rows)
    d = add(d, {"_m1": win.lag("mid_price"), "_m10": win.lag("mid_price", 10), "_pos": win.position()})
    d = add(d, {f"ret_{k}": f"coalesce(try_divide(mid_price, _m{k}) - 1D, 0D)" for k in (1, 10)})
    d = add_trailing(d, win, moments={"ret_1": {20, 100}, "ret_10": {20}})
    out = {f"realized_vol_{n}": f"coalesce({sample_std(f'least(_pos, {n})', f'_m2_ret_1_{n}')}, 0D)" for n in (20, 100)}
    out["momentum_score"] = "if(_pos >= 2, _mean_ret_10_20, 0D)"
    d = add(d, out).drop(*[c for c in d.columns if c.startswith(("_mean_", "_m2_"))], "_m1", "_m10")
    return drop_halo(
        add_rolling_z(d, {"spread_z_100": "rel_spread", "depth_z_100": "total_depth_10"}, win, 100, 5, eps)
    )


def level_windows(
    df: DataFrame,
    vector: Column,
    window: int,
    stride: int = 1,
    chunk_rows: int = CHUNK_ROWS,
    group: tuple[str, ...] = (*KEYS, "split", "date"),
) -> DataFrame:
    """Sliding windows of ``window`` consecutive rows as ``array<array<float>>``, labelled by their last row.

    A window never crosses a group, rows whose label is missing end no window, and the stride phase is the row's
    position inside its group.  Needs ``pos``, the dense position of the row in its group.
    """
    w = chunk_window(group, "pos")
    out = with_halo(df.withColumn("_vec", vector), back=window - 1, chunk_rows=chunk_rows, idx="pos")
    out = out.withColumn("window", F.collect_list("_vec").over(w.rowsBetween(-(window - 1), 0)))
    full = (F.size("window") == window) & ((F.col("pos") - (window - 1)) % stride == 0) & F.col("label").isNotNull()
    return drop_halo(out.filter(full)).drop("_vec")


def with_group_position(df: DataFrame, group: tuple[str, ...] = (*KEYS, "split", "date")) -> DataFrame:
    """``pos``: the row's offset inside its group, for groups that are contiguous runs of ``event_idx``."""
    starts = per_key(df.groupBy(*group).agg(F.min("event_idx").alias("_first")))
    return df.join(starts, list(group)).withColumn("pos", F.col("event_idx") - F.col("_first")).drop("_first")
