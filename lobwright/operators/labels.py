"""Cost-aware direction labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobwright.functions.scalars import KEYS
from lobwright.operators.chunks import CHUNK_ROWS, chunk_window, drop_halo, with_halo
from lobwright.sources.stages import per_key

# Label order used by every matrix and probability vector.
LABELS = ("DOWN", "FLAT", "UP")


def label_columns(df: DataFrame, future_mid, horizon: int, fee_bps: float, buffer: float, eps: float) -> DataFrame:
    ret = (future_mid - F.col("mid_price")) / (F.col("mid_price") + eps)
    cost = F.col("rel_spread") * F.lit(1.0 + buffer) + F.lit(fee_bps / 10000.0)
    df = df.withColumns({"future_ret_h": ret, "cost_threshold_t": cost})
    r, c = F.col("future_ret_h"), F.col("cost_threshold_t")
    return df.withColumns(
        {
            "label": F.when(r > c, "UP").when(r < -c, "DOWN").otherwise("FLAT"),
            "label_horizon_events": F.lit(horizon).cast("long"),
            "label_fee_bps": F.lit(float(fee_bps)),
        }
    )


def add_labels(
    df: DataFrame,
    horizon: int = 50,
    fee_bps: float = 1.0,
    slippage_buffer: float = 0.5,
    eps: float = 1e-9,
    chunk_rows: int = CHUNK_ROWS,
    keys: tuple[str, ...] = KEYS,
    reset_every_us: int | None = None,
) -> DataFrame:
    """UP / DOWN when the return over ``horizon`` rows beats spread, fee and slippage buffer; the last rows drop out.

    Without a horizon the return is that of the row itself, and rows without one drop out.

    ``reset_every_us`` restarts the sequence at every such interval, as a job run window by window would.
    """
    if horizon <= 0:
        return label_columns(df, F.col("mid_price"), 0, fee_bps, slippage_buffer, eps).filter(F.col("future_ret_h").isNotNull())
    w = chunk_window(keys)
    out = with_halo(df, ahead=horizon, chunk_rows=chunk_rows)
    out = out.withColumn("_future", F.lead("mid_price", horizon).over(w))
    if reset_every_us:
        period = F.floor(F.col("event_us") / F.lit(reset_every_us))
        out = out.withColumn("_period", period).withColumn("_later", F.lead("_period", horizon).over(w))
        out = out.filter(F.col("_later") == F.col("_period")).drop("_period", "_later")
    out = drop_halo(out.filter(F.col("_future").isNotNull()))
    return label_columns(out, F.col("_future"), horizon, fee_bps, slippage_buffer, eps).drop("_future")


def class_return_means(df: DataFrame, split: str = "train", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean future return per class on one split, a column per class; an absent class counts as 0."""
    return per_key(
        df.filter(F.col("split") == split)
        .groupBy(*keys)
        .agg(
            *[
                F.coalesce(F.avg(F.when(F.col("label") == c, F.col("future_ret_h"))), F.lit(0.0)).alias(f"mean_{c.lower()}")
                for c in LABELS
            ]
        )
    )
