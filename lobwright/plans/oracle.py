"""The same answers in plain SQL, as building blocks for DuckDB.

Every block is a common table expression written from the definition of the operator (direct window frames, unnested
levels, list folds), not from the plan Spark runs.
"""

from __future__ import annotations

from lobwright.operators.regimes import RULES, SETTINGS, THRESHOLDS
from lobwright.operators.score import FIXED_INTERCEPTS, FIXED_WEIGHTS
from lobwright.operators.tune import MARGIN_QUANTILES, NAIVE_GRID

K = "exchange, symbol"
W = "partition by exchange, symbol order by event_idx"


def rows(n: int, agg: str) -> str:
    return f"{agg} over ({W} rows between {n - 1} preceding and current row)"


def book(defects: bool) -> str:
    def arr(side: int) -> str:
        sign = "-" if side == 0 else "+"
        price = f"_mid {sign} (_half + 2e-2 * i)"
        size = f"((event_id * 31 + 17 * i + {7 * side}) % 97 + 10) / 1e1"
        if defects and side == 1:
            price = (
                f"case when i = 0 and event_id % 101 = 0 then _mid - _half - 1e-2 "
                f"when i = 0 and event_id % 109 = 0 then _mid - _half else {price} end"
            )
            size = f"case when i = 3 and event_id % 113 = 0 then null else {size} end"
        if defects and side == 0:
            size = f"case when i = 0 and event_id % 103 = 0 then 0e0 else {size} end"
        return f"list_transform(range(20), lambda i: {{'price': {price}, 'size': {size}}})"

    seq, origin, received = "event_id", "_text", "_text"
    if defects:
        seq = "case when event_id % 107 = 0 then null when event_id % 127 = 0 then event_id - 300 else event_id end"
        origin = "case when event_id % 89 = 0 then 'bad' else _text end"
        received = "case when event_id % 979 = 0 then 'bad' else _text end"
    return f"""
      select {origin} as origin_time, {received} as received_time, ({seq})::bigint as sequence_number,
             event_type as symbol, 'SIM' as exchange, event_id as arrival, {arr(0)} as bids, {arr(1)} as asks
      from (select *, 1e3 + value / 1e2 as _mid, 5e-2 + (event_id % 7) * 1e-2 as _half,
                   strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as _text from events)"""


def timed(source: str) -> str:
    return f"""
      select *, coalesce(try_cast(origin_time as timestamp), try_cast(received_time as timestamp)) as event_time,
             epoch_us(coalesce(try_cast(origin_time as timestamp), try_cast(received_time as timestamp))) as event_us
      from {source}"""


def clean(source: str, drop_crossed: bool = True) -> str:
    crossed = "and bids[1].price <= asks[1].price" if drop_crossed else ""
    return f"""
      select * exclude (sequence_number, ord), coalesce(sequence_number, -1) as sequence_number,
             row_number() over (partition by exchange, symbol order by event_us, coalesce(sequence_number, -1), arrival) - 1 as event_idx
      from (select *, 0 as ord from {source}) where event_us is not null and bids[1].price > 0 and asks[1].price > 0
        and bids[1].size > 0 and asks[1].size > 0 {crossed}"""


def _sum(side: str, k: int) -> str:
    return f"coalesce(list_sum(list_transform({side}s[1:{k}], lambda l: l.size)), 0)"


def row_features(source: str, eps: str = "1e-9", levels=(1, 3, 5, 10, 20)) -> str:
    deep = ", ".join(f"{_sum(s, k)} as {s}_depth_{k}" for k in levels for s in ("bid", "ask"))
    out = []
    for k in levels:
        b, a = f"bid_depth_{k}", f"ask_depth_{k}"
        out += [
            f"{b} + {a} as total_depth_{k}",
            f"({b} - {a}) / ({b} + {a} + {eps}) as depth_imbalance_{k}",
            f"{b} / ({a} + {eps}) as depth_ratio_{k}",
            f"{b} / (abs(bids[1].price - bids[{k}].price) + {eps}) as book_slope_bid_{k}",
            f"{a} / (abs(asks[1].price - asks[{k}].price) + {eps}) as book_slope_ask_{k}",
        ]
    return f"""
      select *, (microprice - mid_price) / (mid_price + {eps}) as microprice_deviation, {", ".join(out)}
      from (select *, spread / (mid_price + {eps}) as rel_spread,
                   (asks[1].price * bids[1].size + bids[1].price * asks[1].size)
                     / (bids[1].size + asks[1].size + {eps}) as microprice, {deep}
            from (select *, (bids[1].price + asks[1].price) / 2e0 as mid_price,
                         asks[1].price - bids[1].price as spread from {source}))"""


def order_flow(source: str) -> str:
    def change(side: str, better: str) -> str:
        now, was = f"{side}s[i]", f"p_{side}s[i]"
        return (
            f"(case when {now}.price {better} {was}.price then {now}.size when {now}.price = {was}.price "
            f"then {now}.size - {was}.size else -{was}.size end)"
        )

    return f"""
      select * exclude (p_bids, p_asks, terms), list_sum(terms[1:1]) as ofi_1, list_sum(terms[1:5]) as ofi_5,
             list_sum(terms[1:10]) as ofi_10, terms
      from (select *, list_transform(range(1, 11),
                     lambda i: coalesce({change('bid', '>')} - {change('ask', '<')}, 0e0)) as terms
            from (select *, lag(bids) over ({W}) as p_bids, lag(asks) over ({W}) as p_asks from {source}))"""


def returns(source: str) -> str:
    past = ", ".join(f"lag(mid_price, {k}) over ({W}) as m{k}" for k in (1, 10, 50, 100))
    cols = []
    for k in (10, 50, 100):
        cols.append(f"coalesce((mid_price - m{k}) / (m{k} + 1e-9), 0e0) as mid_return_{k}")
        cols.append(f"coalesce(ln((mid_price + 1e-9) / (m{k} + 1e-9)), 0e0) as log_return_{k}")
    rolled = []
    for n in (20, 100, 500):
        need = max(2, n // 4)
        full = f"{rows(n, 'count(*)')} >= {need}"
        rolled += [
            f"case when {full} then {rows(n, 'stddev_samp(one_step)')} else 0e0 end as realized_vol_{n}",
            f"case when {full} then {rows(n, 'sum(abs(one_step))')} else 0e0 end as abs_return_{n}",
            f"case when {full} then {rows(n, 'avg(flip)')} else 0e0 end as up_down_flip_rate_{n}",
            f"case when {rows(n - 1, 'count(r1)')} >= {max(2, need - 1)} "
            f"then coalesce({rows(n - 1, 'corr(r1, one_step)')}, 0e0) else 0e0 end as return_autocorr_{n}",
        ]
    return f"""
      select *, {", ".join(rolled)}
      from (select *, case when sign(one_step) = sign(r1) then 0e0 else 1e0 end as flip
            from (select *, lag(one_step) over ({W}) as r1
                  from (select *, coalesce(mid_price / m1 - 1e0, 0e0) as one_step, {", ".join(cols)}
                        from (select *, {past} from {source}))))"""


def z(x: str, n: int = 300, need: int = 60, eps: str = "1e-9") -> str:
    return (
        f"case when {rows(n, 'count(*)')} >= {need} then coalesce(({x} - {rows(n, f'avg({x})')}) / "
        f"({rows(n, f'stddev_samp({x})')} + {eps}), 0e0) else 0e0 end"
    )


def regime_inputs(source: str) -> str:
    return f"""
      select *, abs(depth_imbalance_10) as imbalance_score,
             (total_depth_10 - med) / (abs(med) + 1e-9) as depth_drop_top10,
             bid_depth_1 / (bid_depth_20 + 1e-9) < 5e-2 as top_level_depletion_flag,
             spread_z_1m > 1e0 as spread_widening_flag,
             spread_z_1m - depth_z_1m as liquidity_drought_score,
             up_down_flip_rate_100 as choppiness_score,
             abs(realized_vol_100) + abs(rel_spread) as latency_sensitivity_score
      from (select *, {z('realized_vol_100')} as vol_score, {z('rel_spread')} as spread_z_1m,
                   {z('total_depth_10')} as depth_z_1m, {z('abs(ofi_5)')} as ofi_proxy_score,
                   {z('mid_return_50')} as momentum_score, {z('abs(mid_return_50)')} as adverse_selection_score,
                   {rows(300, 'quantile_cont(total_depth_10, 0.5)')} as med
            from {source})"""


def labels(source: str, horizon: int = 50, fee: float = 1.0, buffer: float = 0.5) -> str:
    return f"""
      select *, case when future_ret_h > cost_threshold_t then 'UP' when future_ret_h < -cost_threshold_t then 'DOWN'
                     else 'FLAT' end as label, {horizon}::bigint as label_horizon_events, {fee}::double as label_fee_bps
      from (select *, (future_mid - mid_price) / (mid_price + 1e-9) as future_ret_h,
                   rel_spread * {1 + buffer}::double + {fee / 10000.0!r}::double as cost_threshold_t
            from (select *, lead(mid_price, {horizon}) over ({W}) as future_mid from {source})
            where future_mid is not null)"""


def scores(source: str) -> str:
    return f"""
      select *, depth_z_1m - spread_z_1m as liquidity_score, vol_score + spread_z_1m - depth_z_1m as stress_score,
             abs(momentum_score) + adverse_selection_score as directional_toxicity_score,
             abs(momentum_score) as momentum_abs, count(*) over (partition by {K}) as n_events
      from {source}"""


def thresholds(source: str, setting: str = "baseline", fraction: float = 0.6) -> str:
    q = SETTINGS[setting]
    cols = ", ".join(
        f"quantile_cont({score}, {q[lv] if isinstance(lv, str) else lv}) as {name}" for name, (score, lv) in THRESHOLDS.items()
    )
    return f"select {K}, {cols} from {source} where event_idx < greatest(1, floor(n_events * {fraction!r}::double)) group by {K}"


def cascade(alias: str = "t") -> str:
    def one(t) -> str:
        if isinstance(t, list):
            return "(" + " or ".join(one(x) for x in t) + ")"
        return f"round({t[0]}, 9) {t[1]} round({alias}.{t[2]}, 9)"

    whens = " ".join(f"when {' and '.join(one(t) for t in rule)} then '{name}'" for name, rule in RULES.items())
    return f"case {whens} else 'UNKNOWN' end"


def split(source: str, train: float = 0.6, valid: float = 0.2, purge: int = 50) -> str:
    return f"""
      select * exclude (te, ve, n_rows_), case when event_idx < greatest(te - {purge}, 0) then 'train'
               when event_idx >= te and event_idx < greatest(ve - {purge}, te) then 'valid'
               when event_idx >= ve then 'test' end as split
      from (select *, floor(n_rows_ * {train!r}::double) as te, floor(n_rows_ * {train + valid!r}::double) as ve
            from (select *, count(*) over (partition by {K}) as n_rows_ from {source}))
      where split is not null"""


def softmax(source: str) -> str:
    def logit(k: int) -> str:
        return " + ".join([f"{FIXED_INTERCEPTS[k]}::double"] + [f"{w[k]}::double * {f}" for f, w in FIXED_WEIGHTS.items()])

    return f"""
      select * exclude (l0, l1, l2, top), case when prob_down >= prob_flat and prob_down >= prob_up then 'DOWN'
               when prob_flat >= prob_up then 'FLAT' else 'UP' end as pred_label
      from (select *, exp(l0 - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top)) as prob_down,
                   exp(l1 - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top)) as prob_flat,
                   exp(l2 - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top)) as prob_up
            from (select *, greatest(l0, l1, l2) as top
                  from (select *, {logit(0)} as l0, {logit(1)} as l1, {logit(2)} as l2 from {source})))"""


def _cells(features, row: str = "", model: str = "") -> str:
    """A row's standardised features and 1, as a list."""
    return "[" + ", ".join([f"coalesce(({row}{f} - {model}mu[{j}]) / {model}sd[{j}], 0e0)" for j, f in enumerate(features, 1)] + ["1e0"]) + "]"


def _probabilities(weights: str, cells: str, size: int) -> str:
    """A list of three, from weights in class order."""
    logits = [f"list_dot_product({weights}[{c * size + 1}:{(c + 1) * size}], {cells})" for c in range(3)]
    top = f"greatest({', '.join(logits)})"
    parts = [f"exp({x} - {top})" for x in logits]
    return "[" + ", ".join(f"{p} / ({' + '.join(parts)})" for p in parts) + "]"


def trained(prefix: str, source: str, features, steps: int = 20, rate: float = 0.125, reg: float = 1e-4) -> dict[str, str]:
    """CTEs ending in ``<prefix>_model`` (K, mu, sd, w): one multinomial model per key, by the same steps."""
    size = len(features) + 1
    sd = ", ".join(f"case when coalesce(stddev_samp({f}), 0) = 0 then 1e0 else stddev_samp({f}) end" for f in features)
    out = {
        f"{prefix}_fit": f"select {K}, [{', '.join(f'avg({f})' for f in features)}] as mu, [{sd}] as sd from {source} where split = 'train' group by {K}",
        f"{prefix}_rows": f"""
          select {K}, {_cells(features)} as z, [(label = 'DOWN')::int, (label = 'FLAT')::int, (label = 'UP')::int] as y,
                 count(*) over (partition by {K}) / (3e0 * count(*) over (partition by {K}, label)) as cw
          from {source} join {prefix}_fit using ({K}) where split = 'train'""",
        f"{prefix}_w0": f"select {K}, list_transform(range({3 * size}), lambda x: 0e0) as w, list_transform(range({3 * size}), lambda x: 0e0) as b from {prefix}_fit",
    }
    for t in range(steps):
        out[f"{prefix}_v{t}"] = f"select {K}, w, list_transform(range(1, {3 * size + 1}), lambda i: w[i] + {t / (t + 3)!r}::double * (w[i] - b[i])) as v from {prefix}_w{t}"
        out[f"{prefix}_p{t}"] = f"select {K}, z, y, cw, {_probabilities('v', 'z', size)} as p from {prefix}_rows join {prefix}_v{t} using ({K})"
        out[f"{prefix}_g{t}"] = f"""
          select {K}, list(g order by i) as g from (
            select {K}, i, avg(cw * (p[(i - 1) // {size} + 1] - y[(i - 1) // {size} + 1]) * z[(i - 1) % {size} + 1]) as g
            from {prefix}_p{t}, (select unnest(range(1, {3 * size + 1})) as i) group by {K}, i) group by {K}"""
        out[f"{prefix}_w{t + 1}"] = f"""
          select {K}, list_transform(range(1, {3 * size + 1}), lambda i: v[i] - {rate!r}::double * (g[i] + {reg!r}::double * v[i])) as w, w as b
          from {prefix}_v{t} join {prefix}_g{t} using ({K})"""
    out[f"{prefix}_model"] = f"select {K}, mu, sd, list_transform(w, lambda x: round(x, 9)) as w from {prefix}_fit join {prefix}_w{steps} using ({K})"
    return out


def scored_by(source: str, model: str, features) -> str:
    """The rows of ``source`` with the probabilities of their key's model."""
    return f"""
      select * exclude (p, mu, sd, w), p[1] as prob_down, p[2] as prob_flat, p[3] as prob_up,
             case when p[1] >= p[2] and p[1] >= p[3] then 'DOWN' when p[2] >= p[3] then 'FLAT' else 'UP' end as pred_label
      from (select r.* exclude (prob_down, prob_flat, prob_up, pred_label), m.mu, m.sd, m.w,
                   {_probabilities('m.w', _cells(features, 'r.', 'm.'), len(features) + 1)} as p
            from {source} r join {model} m on m.exchange = r.exchange and m.symbol = r.symbol)"""


PENALTY = (
    "case regime when 'LIQUIDITY_DROUGHT' then 1e0 when 'VOLATILE_ILLIQUID' then 75e-2 when 'MOMENTUM_TOXIC' then 5e-1 "
    "when 'CHOPPY_MEAN_REVERTING' then 25e-2 else 0e0 end"
)
MEANS = f"""
      select {K}, coalesce(avg(future_ret_h) filter (where label = 'DOWN'), 0e0) as mean_down,
             coalesce(avg(future_ret_h) filter (where label = 'FLAT'), 0e0) as mean_flat,
             coalesce(avg(future_ret_h) filter (where label = 'UP'), 0e0) as mean_up
      from scored where split = 'train' group by {K}"""
DECIDED = f"""
      select s.*, prob_up * mean_up + prob_flat * mean_flat + prob_down * mean_down as estimated_edge,
             rel_spread + 1e0 / 1e4 as estimated_cost, abs(latency_sensitivity_score) as latency_risk,
             greatest(liquidity_drought_score, 0e0) as liquidity_risk, greatest(adverse_selection_score, 0e0) as adverse_risk,
             {PENALTY} as regime_risk
      from scored s join means using ({K})"""


def required(lat="25e-2", liq="25e-2", adv="25e-2", reg="15e-2") -> str:
    return (
        f"(estimated_cost + {lat} * latency_risk + {liq} * liquidity_risk + {adv} * adverse_risk + {reg} * regime_risk)"
    )


def beyond(edge: str, need: str) -> str:
    return f"case when round({edge}, 12) > round({need}, 12) then 1 when round({edge}, 12) < -round({need}, 12) then -1 else 0 end"


def naive(theta: str) -> str:
    up, down = f"round(prob_up, 12) > {theta}", f"round(prob_down, 12) > {theta}"
    return f"case when {up} and not ({down}) then 1 when {down} and not ({up}) then -1 else 0 end"


def grid(source: str) -> str:
    def margins(policy: str, base: str) -> str:
        qs = ", ".join(f"round(quantile_cont(m, {q}), 12)" for q in MARGIN_QUANTILES)
        return f"""
          select {K}, '{policy}' as policy, unnest(list_distinct(case when max(m) is null then [0e0] else [0e0, {qs}] end)) as theta
          from (select {K}, case when abs(estimated_edge) - {base} > 0 then abs(estimated_edge) - {base} end as m from {source})
          group by {K}"""

    thetas = ", ".join(f"{t}::double" for t in NAIVE_GRID)
    return f"""
      select {K}, 'naive_threshold' as policy, unnest([{thetas}]) as theta from (select distinct {K} from {source})
      union all {margins('cost_aware_threshold', 'estimated_cost')} union all {margins('risk_gate', required())}"""


def grid_signals(source: str, g: str) -> str:
    """(symbol, policy, theta, event_idx, action), action not 0."""
    cost, gate = beyond("estimated_edge", "(estimated_cost + theta)"), beyond("estimated_edge", f"({required()} + theta)")
    return f"""
      select {K}, policy, theta, event_idx, action from (
        select {K}, g.policy, g.theta, event_idx,
               case g.policy when 'naive_threshold' then {naive('g.theta')}
                             when 'cost_aware_threshold' then {cost} else {gate} end as action
        from {source} join {g} g using ({K})) where action <> 0"""


def fills(legs: str, replayed: str, notional: float = 1000.0, partial: bool = True) -> str:
    """Adds price, quantity, fill_ratio, slippage to legs(exchange, symbol, row_at, side, sm, dm), by unnesting levels."""
    full = "true" if partial else "filled / target >= 1"
    return f"""
      select leg_id, case when ok and filled > 0 and {full} then value / filled else 0e0 end as price,
             case when ok and filled > 0 and {full} then filled else 0e0 end as quantity,
             case when ok and filled > 0 and {full} then filled / target else 0e0 end as fill_ratio,
             case when ok and filled > 0 and {full} then abs(value / filled - best) else 0e0 end as slippage
      from (
        select leg_id, any_value(target) as target, any_value(ok) as ok, sum(take) as filled, sum(take * px) as value,
               min_by(px, lvl) as best
        from (
          select leg_id, lvl, px, target, ok,
                 greatest(0e0, least(sz, target - coalesce(sum(sz) over (partition by leg_id order by lvl
                    rows between unbounded preceding and 1 preceding), 0e0))) as take
          from (
            select leg_id, u.i as lvl, {notional}::double / greatest(mid_price, 1e-9) as target,
                   coalesce(mid_price > 0 and bids[1].price > 0 and asks[1].price > 0 and bids[1].size > 0
                            and asks[1].size > 0 and bids[1].price <= asks[1].price, false) as ok,
                   mid_price + (case when side > 0 then asks[u.i] else bids[u.i] end.price - mid_price) * sm as px,
                   case when side > 0 then asks[u.i] else bids[u.i] end.size * dm as sz
            from {legs} l join {replayed} r on l.exchange = r.exchange and l.symbol = r.symbol and l.row_at = r.event_idx,
                 (select unnest(range(1, 21)) as i) u)
          where px > 0 and sz > 0)
        group by leg_id)"""


def trips(prefix: str, signals: str, replayed: str, by: str, hold: int = 50, minimum: float = 0.5, notional: float = 1000.0,
          partial: bool = True, last_row: bool = False) -> dict[str, str]:
    """CTEs ending in ``<prefix>_trips``.  ``signals`` has latency, sm and dm columns."""
    cmp = "<=" if last_row else "<"
    return {
        f"{prefix}_sig": f"""
          select *, row_number() over () as sid from {signals}""",
        f"{prefix}_need": f"""
          select distinct exchange, symbol, row_at, side, sm, dm from (
            select exchange, symbol, event_idx + latency as row_at, action as side, sm, dm from {prefix}_sig union all
            select exchange, symbol, event_idx + latency + {hold}, -action, sm, dm from {prefix}_sig)""",
        f"{prefix}_legs": f"select *, row_number() over () as leg_id from {prefix}_need",
        f"{prefix}_fill": fills(f"{prefix}_legs", replayed, notional, partial),
        f"{prefix}_leg": f"select * from {prefix}_legs join {prefix}_fill using (leg_id)",
        f"{prefix}_trips": f"""
          select *, quantity * (case when action > 0 then exit_price - entry_price else entry_price - exit_price end) as gross_pnl
          from (
            select s.exchange, s.symbol, {by}, s.event_idx as signal_index, s.event_idx + s.latency as entry_index,
                   s.event_idx + s.latency + {hold} as exit_index, b.event_us, b.regime, s.action,
                   least(i.quantity, o.quantity) as quantity, i.price as entry_price, o.price as exit_price,
                   least(i.fill_ratio, o.fill_ratio) as fill_ratio, i.slippage as entry_slippage, o.slippage as exit_slippage
            from {prefix}_sig s
            join {prefix}_leg i on i.exchange = s.exchange and i.symbol = s.symbol and i.row_at = s.event_idx + s.latency
                 and i.side = s.action and i.sm = s.sm and i.dm = s.dm
            join {prefix}_leg o on o.exchange = s.exchange and o.symbol = s.symbol and o.row_at = s.event_idx + s.latency + {hold}
                 and o.side = -s.action and o.sm = s.sm and o.dm = s.dm
            join {replayed} b on b.exchange = s.exchange and b.symbol = s.symbol and b.event_idx = s.event_idx + s.latency
            join (select {K}, max(event_idx) as last_idx from {replayed} group by {K}) m
                 on m.exchange = s.exchange and m.symbol = s.symbol
            where s.event_idx + s.latency + {hold} {cmp} last_idx and i.fill_ratio >= {minimum} and o.fill_ratio >= {minimum})
          where quantity > 0""",
    }


def thinned(source: str, by: str, gap: int) -> str:
    """Sequential acceptance, as a fold over each group's sorted indexes."""
    return f"""
      select t.* from {source} t semi join (
        select {by}, unnest(kept) as signal_index from (
          select {by}, list_reduce(list_transform(list_sort(list(signal_index)), lambda x: [x]),
                   lambda a, x: case when x[1] - a[len(a)] >= {gap} then list_concat(a, x) else a end) as kept
          from {source} group by {by})) k using ({by}, signal_index)"""


def charged(source: str, fee: str = "1e0") -> str:
    return f"""
      select *, quantity * entry_price * {fee} / 1e4 + quantity * exit_price * {fee} / 1e4 as total_cost,
             gross_pnl - (quantity * entry_price * {fee} / 1e4 + quantity * exit_price * {fee} / 1e4) as net_pnl
      from {source}"""


def summary(source: str, by: str) -> str:
    return f"""
      select {by}, count(*) as n_trades, sum(gross_pnl) as gross_pnl, sum(net_pnl) as net_pnl, sum(total_cost) as total_cost,
             sum(abs(quantity)) as turnover, sum(abs(quantity) * entry_price) as turnover_notional,
             avg(net_pnl) as net_pnl_per_trade, min(eq - peak) as max_drawdown,
             count(distinct event_us // 86400000000) as n_trade_days,
             case when sum(gross_pnl) > 0 then sum(net_pnl) / sum(gross_pnl) end as cost_survival
      from (select *, max(eq) over (partition by {by} order by entry_index) as peak
            from (select *, sum(net_pnl) over (partition by {by} order by entry_index) as eq from {source}))
      group by {by}"""


_FILLED = """
      select g.exchange, g.symbol, g.policy, g.theta, coalesce(n_trades, 0) as n_trades, coalesce(gross_pnl, 0e0) as gross_pnl,
             coalesce(net_pnl, 0e0) as net_pnl, coalesce(n_trade_days, 0) as n_trade_days
      from valid_grid g left join valid_summary s using (exchange, symbol, policy, theta)"""


def _blocks() -> dict[str, str]:
    b: dict[str, str] = {
        "raw": book(False),
        "raw_t": timed("raw"),
        "bad": book(True),
        "bad_t": timed("bad"),
        "book": clean("raw_t"),
        "book_bad": clean("bad_t"),
        "rowf": row_features("book"),
        "seqf": returns("flow"),
        "flow": order_flow("rowf"),
        "inputs": regime_inputs("seqf"),
        "lab": labels("inputs"),
        "scr": scores("lab"),
        "thr": thresholds("scr"),
        "reg": f"select s.*, {cascade()} as regime from scr s join thr t using ({K})",
        "spl": split("reg"),
        "scored": softmax("spl"),
        "means": MEANS,
        "decided": DECIDED,
        "valid": "select * from decided where split = 'valid'",
        "test": "select * from decided where split = 'test'",
        "valid_grid": grid("valid"),
        "valid_signals": "select *, 1 as latency, 1e0 as sm, 1e0 as dm from (" + grid_signals("valid", "valid_grid") + ")",
        **trips("v", "valid_signals", "valid", "s.policy, s.theta"),
        "valid_thin": thinned("v_trips", "exchange, symbol, policy, theta", 3),
        "valid_trades": charged("valid_thin"),
        "valid_summary": summary("valid_trades", "exchange, symbol, policy, theta"),
        "tried": _FILLED,
        "tuned": f"""
          select *, row_number() over (partition by {K}, policy
                     order by eligible desc, round(net_pnl, 9) desc, theta) = 1 as selected
          from (select t.*, n_trades >= greatest(1000, floor(5e-4 * n)) and n_trade_days >= 5 as eligible
                from tried t join (select {K}, count(*) as n from valid group by {K}) using ({K}))""",
        "winners": f"select {K}, policy, theta from tuned where selected",
        "test_signals": "select *, 1 as latency, 1e0 as sm, 1e0 as dm from (" + grid_signals("test", "winners") + ")",
        **trips("t", "test_signals", "test", "s.policy"),
        "test_thin": thinned("t_trips", "exchange, symbol, policy", 3),
        "test_trades": charged("test_thin"),
    }
    return b


BLOCKS = _blocks()


def with_blocks(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` preceded by the blocks it uses, directly or through other blocks."""
    import re

    known = {**BLOCKS, **(extra or {})}
    order: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        for word in re.findall(r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)", text):
            if word in known and word not in order and word not in trail:
                visit(known[word], (*trail, word))
                order.append(word)

    visit(sql, ())
    if not order:
        return sql
    return "with " + ", ".join(f"{n} as materialized ({known[n]})" for n in order) + "\n" + sql
