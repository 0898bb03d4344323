import pytest
from lobwright.operators.features import level_vector
from lobwright.sources.book import event_levels


@pytest.mark.parametrize("scaler", [None, "scaler", {0: (0.5, 2.0), 39: (1.0, 0.0)}])
def test_the_code_of_a_scaled_vector_compiles(spark, scaler):
    """Levels that are derived on reading are inlined into each cell; the code of forty cells was too long to compile, so rows were interpreted."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = spark.range(5).selectExpr("id as arrival", "id * 1D as quote", "struct(array_repeat(0.5D, 40) as mean, array_repeat(2D, 40) as std) as scaler")
        found = event_levels(rows).select("arrival", level_vector(10, scaler).alias("v")).selectExpr("v[0] + v[39] as s", "size(v) as n").collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert [r.n for r in found] == [40] * 5 and all(abs(r.s) < 10 for r in found)
