"""Cooldown thinning: accept events in order, each at least ``gap`` rows after the last accepted one.

The rule is sequential, but what a block of rows passes on is only how many rows of the next block are still blocked,
a number below ``gap``.  So each block is summarised as a map from "blocked on entry" to "blocked on exit"; maps compose,
first within groups of blocks, then across groups; and once every block knows its entry state all blocks are thinned in
parallel.  No task sees more than one block of rows, or one group of summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobwright.sources.stages import cut

BLOCK_ROWS = 2048
GROUP_BLOCKS = 1024


def _compose(maps: str, first: str, blocked: str) -> str:
    """State after a run of (at, map) summaries; a missing position accepts nothing and frees the row."""
    return f"aggregate({maps}, named_struct('at', {first} - 1, 'r', {blocked}), (s, x) -> named_struct('at', x.at, 'r', {_NEXT})).r"


_ENTRY = "if(x.at = s.at + 1, s.r, 0L)"
_NEXT = f"x.map[int({_ENTRY})]"


def _entries(maps: str, first: str, blocked: str) -> str:
    """The entry state of every summary in the run."""
    start = f"named_struct('at', {first} - 1, 'r', {blocked}, 'out', cast(array() as array<struct<at:bigint,r:bigint>>))"
    step = f"named_struct('at', x.at, 'r', {_NEXT}, 'out', concat(s.out, array(named_struct('at', x.at, 'r', {_ENTRY}))))"
    return f"aggregate({maps}, {start}, (s, x) -> {step}).out"


def thin(df: DataFrame, by: list[str], idx: str, gap: int, block_rows: int = BLOCK_ROWS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Rows of ``df`` accepted in ``idx`` order per ``by``.  ``idx`` must be unique inside a group."""
    if gap <= 1:
        return df
    df = cut(df, "candidates")
    width = max(block_rows, gap)
    states = f"sequence(0L, {gap - 1}L)"
    blocks = df.groupBy(*by, F.expr(f"{idx} div {width} as _b")).agg(F.expr(f"sort_array(collect_list({idx})) as _items"))
    # The first free row after the block, for every number of rows blocked on entry.
    through = f"aggregate(_items, r + _b * {width}, (s, x) -> if(x >= s, x + {gap}, s))"
    groups = (
        blocks.selectExpr(*by, "_b", f"transform({states}, r -> greatest({through} - (_b + 1) * {width}, 0L)) as _map")
        .groupBy(*by, F.expr(f"_b div {group_blocks} as _g"))
        .agg(F.expr("sort_array(collect_list(named_struct('at', _b, 'map', _map))) as _maps"))
    )
    first, last = f"(_g * {group_blocks})", f"((_g + 1) * {group_blocks} - 1)"
    group_map = f"transform({states}, r -> if(element_at(_maps, -1).at = {last}, {_compose('_maps', first, 'r')}, 0L))"
    top = groups.groupBy(*by).agg(F.expr(f"sort_array(collect_list(named_struct('at', _g, 'map', {group_map}))) as _top"))
    group_entry = top.selectExpr(*by, f"inline({_entries('_top', '0L', '0L')}) as (_g, _r)")
    block_entry = groups.join(group_entry, [*by, "_g"]).selectExpr(
        *by, f"inline({_entries('_maps', first, '_r')}) as (_b, _r)"
    )
    kept = (
        f"aggregate(_items, cast(array() as array<bigint>), (out, x) -> "
        f"if(x >= coalesce(try_element_at(out, -1) + {gap}, _r + _b * {width}), concat(out, array(x)), out))"
    )
    accepted = blocks.join(block_entry, [*by, "_b"]).selectExpr(*by, f"explode({kept}) as {idx}")
    return df.join(accepted, [*by, idx], "left_semi")
