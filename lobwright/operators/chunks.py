"""Windows over long sequences: chunk + halo.

``partitionBy(symbol)`` would put a symbol's whole history into one task.  Instead each symbol is cut into chunks of
``chunk_rows`` consecutive events; a row is also sent to the neighbouring chunks that look back at it (``back`` rows)
or ahead at it (``ahead`` rows).  Windows run inside (symbol, chunk), and the borrowed rows are dropped afterwards.
Parallelism is rows / chunk_rows and the overhead (back + ahead) / chunk_rows, whatever the skew between symbols.

Rolling statistics are merged from pieces, see ``add_trailing``: a window of 500 rows is five windows of 100, each of five of
20, and only those are summed row by row.  Pieces are added or merged, never subtracted, so nothing cancels, whatever levels
the values had before, and no result depends on where a chunk begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T

from lobwright.functions.levels import add
from lobwright.functions.scalars import KEYS

CHUNK_ROWS = 65_536


def with_halo(
    df: DataFrame, back: int = 0, ahead: int = 0, chunk_rows: int = CHUNK_ROWS, idx: str = "event_idx"
) -> DataFrame:
    """Copies each row into every chunk that needs it; ``_home`` marks the chunk that owns it."""
    first = f"greatest({idx} - {ahead}, 0) div {chunk_rows}"
    last = f"({idx} + {back}) div {chunk_rows}"
    return df.selectExpr("*", f"{idx} div {chunk_rows} as _home", f"explode(sequence({first}, {last})) as _chunk")


def chunk_window(keys: tuple[str, ...] = KEYS, idx: str = "event_idx"):
    return Window.partitionBy(*keys, "_chunk").orderBy(idx)


class ChunkSql:
    """Window expressions inside one chunk, as SQL text."""

    def __init__(self, keys: tuple[str, ...] = KEYS, idx: str = "event_idx"):
        self.w = f"partition by {', '.join(keys)}, _chunk order by {idx}"

    def lag(self, c: str, n: int = 1) -> str:
        return f"lag({c}, {n}) over ({self.w})"

    def lead(self, c: str, n: int = 1) -> str:
        return f"lead({c}, {n}) over ({self.w})"

    def position(self) -> str:
        return f"row_number() over ({self.w})"

    def trailing(self, agg: str, n: int) -> str:
        return f"{agg} over ({self.w} rows between {n - 1} preceding and current row)"


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_chunk = _home").drop("_chunk", "_home", "_pos")


#: Windows below twice ``SHORT`` rows are native frames; longer ones are made of pieces of ``SHORT``, then of ``LONG`` rows.
SHORT, LONG = 20, 100


def pieces(n: int) -> list[tuple[int, int]]:
    """(rows, offset) of the shorter windows that make up the trailing ``n`` rows; itself for a native frame."""
    if n < 2 * SHORT:
        return [(n, 0)]
    step = SHORT if n <= 2 * LONG else LONG
    rest = n % step
    return [(rest, 0)] * (rest > 0) + [(step, rest + step * k) for k in range(n // step)]


def add_trailing(df: DataFrame, win: ChunkSql, sums: dict[str, set[int]] | None = None, moments: dict[str, set[int]] | None = None, pos: str = "_pos") -> DataFrame:
    """Sums ``_sum_{column}_{n}``, and means and squared deviations ``_mean_{column}_{n}``, ``_m2_{column}_{n}``, of trailing rows.

    ``sums`` and ``moments`` name columns without nulls and their window lengths; ``pos`` is the row's place in its chunk.
    Moments are merged pairwise around the mean of the newest piece, so a constant series has no deviation.
    """
    wanted = {kind: {c: set(ns) for c, ns in (given or {}).items()} for kind, given in (("sum", sums), ("mean", moments))}
    for lengths in (ns for given in wanted.values() for ns in given.values()):
        open_ = list(lengths)
        while open_:
            for rows, _ in pieces(open_.pop()):
                if rows not in lengths:
                    lengths.add(rows)
                    open_.append(rows)
    every = sorted({n for given in wanted.values() for ns in given.values() for n in ns if n >= 2 * SHORT}, key=lambda n: (n > 2 * LONG, n))
    frames: dict[str, str] = {}
    for kind, given in wanted.items():
        for c, ns in given.items():
            for n in (n for n in ns if n < 2 * SHORT):
                if kind == "sum":
                    frames[f"_sum_{c}_{n}"] = win.trailing(f"sum({c})", n)
                else:
                    frames[f"_mean_{c}_{n}"] = win.trailing(f"avg({c})", n)
                    frames[f"_m2_{c}_{n}"] = f"{win.trailing(f'var_pop({c})', n)} * least({pos}, {n})"
    d = add(df, frames)
    for level in ([n for n in every if n <= 2 * LONG], [n for n in every if n > 2 * LONG]):
        lagged: dict[str, str] = {}
        joined: dict[str, str] = {}
        centred: dict[str, str] = {}
        for kind, given in wanted.items():
            for c, n in ((c, n) for c, ns in given.items() for n in level if n in ns):
                def past(stat: str, rows: int, offset: int, c: str = c) -> str:
                    if not offset:
                        return f"_{stat}_{c}_{rows}"
                    lagged[f"_lag_{stat}_{c}_{rows}_{offset}"] = win.lag(f"_{stat}_{c}_{rows}", offset)
                    return f"_lag_{stat}_{c}_{rows}_{offset}"

                if kind == "sum":
                    joined[f"_sum_{c}_{n}"] = " + ".join(f"coalesce({past('sum', *p)}, 0D)" for p in pieces(n))
                    continue
                newest = f"_mean_{c}_{pieces(n)[0][0]}"
                parts = [(past("mean", *p), past("m2", *p), f"greatest(least({pos} - {p[1]}, {p[0]}), 0)") for p in pieces(n)]
                apart = " + ".join(f"{k} * (coalesce({m}, {newest}) - {newest})" for m, _, k in parts)
                joined[f"_mean_{c}_{n}"] = f"{newest} + ({apart}) / least({pos}, {n})"
                centred[f"_m2_{c}_{n}"] = " + ".join(f"coalesce({q}, 0D) + {k} * power(coalesce({m}, _mean_{c}_{n}) - _mean_{c}_{n}, 2)" for m, q, k in parts)
        d = add(add(add(d, lagged), joined), centred).drop(*lagged)
    kept = {f"_{stat}_{c}_{n}" for stat, given in (("sum", sums), ("mean", moments), ("m2", moments)) for c, ns in (given or {}).items() for n in ns}
    return d.drop(*({*frames, *[f"_{s}_{c}_{n}" for k, s in (("sum", "sum"), ("mean", "mean"), ("mean", "m2")) for c, ns in wanted[k].items() for n in ns]} - kept))


def sample_std(n: str, m2: str) -> str:
    """Sample deviation from count and squared deviations; NULL below two rows."""
    return f"if({n} >= 2, sqrt({m2} / greatest({n} - 1, 1)), null)"


def add_rolling_z(df: DataFrame, inputs: dict[str, str], win: ChunkSql, n: int, min_rows: int, eps: float) -> DataFrame:
    """``out -> z`` of each input against its own trailing ``n`` rows; 0 until ``min_rows`` are there."""
    d = add(df, {f"_x_{o}": c for o, c in inputs.items()} | {"_at": win.position()})
    d = add_trailing(d, win, moments={f"_x_{o}": {n} for o in inputs}, pos="_at")
    cnt = f"least(_at, {n})"
    # No deviation at all means that the row equals the mean, whose last bit may differ.
    d = add(d, {o: f"if({cnt} >= {min_rows} and _m2__x_{o}_{n} <> 0, (_x_{o} - _mean__x_{o}_{n}) / ({sample_std(cnt, f'_m2__x_{o}_{n}')} + {eps}D), 0D)" for o in inputs})
    return d.drop("_at", *[c for o in inputs for c in (f"_x_{o}", f"_mean__x_{o}_{n}", f"_m2__x_{o}_{n}")])


def add_rolling_median(df: DataFrame, column: str, n: int, out: str, keys: tuple[str, ...] = KEYS, idx: str = "event_idx") -> DataFrame:
    """Median of the trailing ``n`` rows (of those there are) inside each chunk.

    A sliding ``percentile`` rebuilds a map of ``n`` values for every row; here each chunk, whose size is bounded, passes
    once through Arrow and pandas keeps a sorted window.  Rows keep their partitioning and order, so nothing is shuffled.
    Run it last: an opaque step hides unused columns from the optimizer, so select what is needed first.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(table):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        order = np.argsort(table.column(idx).to_numpy(), kind="stable")
        values = pd.Series(table.column(column).to_numpy()[order])
        median = np.empty(len(values))
        median[order] = values.rolling(n, min_periods=1).median().to_numpy()
        return table.append_column(out, pa.array(median, from_pandas=True))

    return df.groupBy(*keys, "_chunk").applyInArrow(run, schema)
