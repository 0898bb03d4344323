"""The sweep adds up in the order of its SQL, so that a price halfway between two roundings falls on the same side."""

from pyspark.sql import functions as F

from lobwright.operators.fills import sweep
from lobwright.sources.book import event_levels


def test_a_price_on_the_edge_of_a_rounding(spark):
    # This quote is the only one of sf0.1 where one subtraction after another gives 1000.5845585, and sums of sizes the number below it.
    rows = event_levels(spark.createDataFrame([(73939, 81.25)], "arrival long, quote double")).selectExpr(
        "*", "(bids[0].price + asks[0].price) / 2D as mid_price")
    f = rows.withColumn("side", F.lit(-1)).select(sweep("side", 20000.0, "1.5D", "0.5D").alias("f")).first()["f"]
    price, target, seen, value = 1000.0 + 81.25 / 100.0, 0.0, 0.0, 0.0
    half = 0.05 + (73939 % 7) * 0.01
    bids = [(price - (half + 0.02 * i), ((73939 * 31 + 17 * i) % 97 + 10) / 10.0) for i in range(20)]
    mid = (bids[0][0] + price + half) / 2
    target, filled = 20000.0 / mid, 0.0
    for p, z in bids:
        take = max(0.0, min(z * 0.5, target - seen))
        seen, filled, value = seen + z * 0.5, filled + take, value + take * (mid + (p - mid) * 1.5)
    assert f["price"] == value / filled and round(f["price"], 6) == 1000.584558
    assert f["quantity"] == filled
