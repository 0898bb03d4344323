"""Small hand-made tables."""

from pyspark.sql import functions as F


def book(spark, n, mid=lambda i: 100.0, bids=None, asks=None, **columns):
    """``n`` snapshots of one symbol, one second apart: bids 99-L, asks 101+L, sizes 10, unless overridden per row."""
    rows = []
    for i in range(n):
        b = (bids or {}).get(i) or [(99.0 - k, 10.0) for k in range(20)]
        a = (asks or {}).get(i) or [(101.0 + k, 10.0) for k in range(20)]
        b = b + [(80.0, 10.0)] * (20 - len(b))
        a = a + [(120.0, 10.0)] * (20 - len(a))
        rows.append(("X", "S", i, i * 1_000_000, mid(i), "CALM_LIQUID", b, a, *[c[i] for c in columns.values()]))
    extra = "".join(f", {c} double" for c in columns)
    return spark.createDataFrame(
        rows,
        "exchange string, symbol string, event_idx long, event_us long, mid_price double, regime string, "
        "bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>" + extra,
    )


def signals(spark, idx, action=1):
    return spark.createDataFrame([("X", "S", i, action) for i in idx], "exchange string, symbol string, event_idx long, action int")


def mids(spark, values, keys=("X", "S")):
    return spark.createDataFrame(
        [(*keys, i, float(v)) for i, v in enumerate(values)], "exchange string, symbol string, event_idx long, mid_price double"
    ).withColumn("rel_spread", F.lit(0.001))
