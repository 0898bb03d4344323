"""Snapshot schema, wide <-> array form, and the book view over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lobwright.functions.levels import BOOK_LEVELS, SIDES

META_COLUMNS = ("origin_time", "received_time", "sequence_number", "symbol", "exchange")


def level_columns(levels: int = BOOK_LEVELS) -> list[str]:
    return [f"{s}_{i}_{f}" for s in SIDES for f in ("price", "size") for i in range(levels)]


def book_columns(levels: int = BOOK_LEVELS) -> list[str]:
    return [*META_COLUMNS, *level_columns(levels)]


def wide_schema(levels: int = BOOK_LEVELS, value_type: T.DataType | None = None) -> T.StructType:
    value_type = value_type or T.FloatType()
    fields = [
        T.StructField("origin_time", T.TimestampType()),
        T.StructField("received_time", T.TimestampType()),
        T.StructField("sequence_number", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("exchange", T.StringType()),
    ]
    return T.StructType(fields + [T.StructField(c, value_type) for c in level_columns(levels)])


def numeric_levels(df: DataFrame, levels: int = BOOK_LEVELS) -> DataFrame:
    """Wide level columns as doubles.  Values that are not numbers, and NaN, become NULL."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    wide = set(level_columns(levels))

    def cell(name: str) -> str:
        if name not in wide:
            return f"`{name}`"
        value = f"try_cast({name} as double)" if name in text else f"double({name})"
        return f"nanvl({value}, null) as {name}"

    return df.selectExpr(*[cell(c) for c in df.columns])


def pack_levels(df: DataFrame, levels: int = BOOK_LEVELS) -> DataFrame:
    """Wide level columns to ``bids``/``asks``."""
    arrays = []
    for side in SIDES:
        items = ", ".join(f"struct({side}_{i}_price as price, {side}_{i}_size as size)" for i in range(levels))
        arrays.append(f"array({items}) as {side}s")
    wide = set(level_columns(levels))
    return numeric_levels(df, levels).selectExpr(*[c for c in df.columns if c not in wide], *arrays)


def unpack_levels(df: DataFrame, levels: int = BOOK_LEVELS) -> DataFrame:
    """``bids``/``asks`` to wide level columns."""
    wide = [
        f"{side}s[{i}].{field} as {side}_{i}_{field}" for side in SIDES for field in ("price", "size") for i in range(levels)
    ]
    return df.selectExpr(*[c for c in df.columns if c not in ("bids", "asks")], *wide)


def prepare(spark: SparkSession) -> None:
    """Event times are UTC wherever they are turned into text or days.

    The JVM never compiles a method above 8000 bytes.  Rows of this many columns give longer ones, which Spark would let run
    interpreted; with the limit it falls back to short methods for such a subtree.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_quotes(spark: SparkSession, sf_dir: str, defects: bool = False) -> DataFrame:
    """The narrow rows of ``events_book``: its columns but for the levels, and ``quote``, from which ``event_levels`` derives them."""
    ev = read_events(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    if len(ev.inputFiles()) < cores:
        # Fewer files than cores: spread the narrow rows before each becomes forty levels wide.
        ev = ev.select("event_id", "ts", "event_type", "value").repartition(cores, "event_id")
    ev = ev.selectExpr("*", "date_format(cast(ts as timestamp), 'yyyy-MM-dd HH:mm:ss.SSSSSS') as _text")
    origin = received = "_text"
    seq = "event_id"
    if defects:
        origin = "if(event_id % 89 = 0, 'bad', _text)"
        received = "if(event_id % 979 = 0, 'bad', _text)"
        seq = "case when event_id % 107 = 0 then null when event_id % 127 = 0 then event_id - 300 else event_id end"
    return ev.selectExpr(
        f"{origin} as origin_time", f"{received} as received_time", f"bigint({seq}) as sequence_number",
        "event_type as symbol", "'SIM' as exchange", "event_id as arrival", "value as quote",
    )


#: What ``event_levels`` reads.
QUOTE_COLUMNS = ("arrival", "quote")


def event_levels(df: DataFrame, defects: bool = False, levels: int = BOOK_LEVELS) -> DataFrame:
    """Adds ``bids`` and ``asks``, derived from ``arrival`` and ``quote``.

    Forty levels are fifty times as wide as what they follow from, so tables are sorted, shuffled and stored without them and get
    them where they are read; levels that nothing reads are not computed.
    """
    mid, half = "(1000D + quote / 100D)", "(0.05D + (arrival % 7) * 0.01D)"

    def level(k: int, sign: str, i: int) -> tuple[str, str]:
        return f"{mid} {sign} ({half} + 0.02D * {i})", f"((arrival * 31 + {17 * i} + {7 * k}) % 97 + 10) / 10D"

    sides = {}
    for k, (side, sign) in enumerate((("bid", "-"), ("ask", "+"))):
        cells = [level(k, sign, i) for i in range(levels)]
        if defects and side == "ask":
            best = f"{mid} - {half}"
            price, size = cells[0]
            cells[0] = (f"case when arrival % 101 = 0 then {best} - 0.01D when arrival % 109 = 0 then {best} else {price} end", size)
            if levels > 3:
                price, size = cells[3]
                cells[3] = (price, f"if(arrival % 113 = 0, null, {size})")
        elif defects:
            price, size = cells[0]
            cells[0] = (price, f"if(arrival % 103 = 0, 0D, {size})")
        sides[f"{side}s"] = "array(" + ", ".join(f"struct({p} as price, {z} as size)" for p, z in cells) + ")"
    return df.selectExpr("*", *[f"{sql} as {name}" for name, sql in sides.items()])


def events_book(spark: SparkSession, sf_dir: str, defects: bool = False, levels: int = BOOK_LEVELS) -> DataFrame:
    """A snapshot table derived from every row of ``events`` by arithmetic any engine evaluates alike.

    ``defects=True`` adds the faults the cleaning and audit operators look for, at fixed event-id residues.
    """
    return event_levels(events_quotes(spark, sf_dir, defects), defects, levels).drop("quote")


def events_wide(spark: SparkSession, sf_dir: str, defects: bool = False, levels: int = BOOK_LEVELS) -> DataFrame:
    """The same table in the wide form providers deliver."""
    return unpack_levels(events_book(spark, sf_dir, defects, levels), levels)
