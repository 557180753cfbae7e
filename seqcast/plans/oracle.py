"""The same queries in SQL, over the tables themselves."""

from __future__ import annotations

from seqcast.schema import FEATURES, HORIZON, TRAIN_RATIO, WINDOW_LENGTH

L = WINDOW_LENGTH
REACH = WINDOW_LENGTH + HORIZON

_PRICES = """
    arg_min(l_extendedprice, row(l_orderkey, l_extendedprice)) as open,
    arg_max(l_extendedprice, row(l_orderkey, l_extendedprice)) as close,
    min(l_extendedprice) as low, max(l_extendedprice) as high, sum(l_quantity) as volume"""

_BRAND = f"""select p_brand as symbol, cast(l_shipdate as date) as date, {_PRICES}
    from lineitem join part on l_partkey = p_partkey group by 1, 2"""

_SUPPLIER = f"""select concat('S', l_suppkey) as symbol, cast(l_shipdate as date) as date, {_PRICES}
    from lineitem group by 1, 2"""


def _cols(pattern: str, names=FEATURES) -> str:
    return ", ".join(pattern.format(f=f) for f in names)


_SCALE = "case when max_{f} > min_{f} then ({f} - min_{f}) / (max_{f} - min_{f}) else 0.5e0 end"

_CTES = {
    "bars": _BRAND,
    "ranges": f"select symbol, {_cols('min({f}) as min_{f}, max({f}) as max_{f}')} from bars group by symbol",
    "numbered": """select *, row_number() over (partition by symbol order by date) - 1 as i,
        count(*) over (partition by symbol) as n from bars""",
    "parts": f"""select *, case when i < split then 'train' else 'test' end as part,
        case when i < split then i else i - split end as j,
        case when i < split then split else n - split end as size
        from (select *, cast(floor(n * cast({TRAIN_RATIO} as double) + cast(0.5 as double)) as bigint) as split
              from numbered)""",
    "scaled": f"""select parts.*, {_cols('min_{f}, max_{f}')}, {_cols(_SCALE + ' as s_{f}')}
        from parts join ranges using (symbol)""",
    "train_starts": f"select symbol, j as i from parts where part = 'train' and j < size - {REACH}",
    "test_starts": f"select symbol, j as w from parts where part = 'test' and j < size - {REACH}",
    "ahead": f"""select symbol, part, j, date, {_cols('s_{f}')},
        {_cols('lead(s_{f}) over one as next_{f}')}
        from scaled window one as (partition by symbol, part order by j)""",
    "train_steps": f"""select w.symbol, w.i, a.j - w.i as t, {_cols('a.s_{f} as x_{f}')}, {_cols('a.next_{f} as y_{f}')}
        from train_starts w join ahead a
        on a.symbol = w.symbol and a.part = 'train' and a.j between w.i and w.i + {L - 1}""",
    "test_steps": f"""select w.symbol, w.w as "window", f.date as date, a.j - w.w as t, {_cols('a.s_{f} as x_{f}')},
        {_cols('f.{f} as y_{f}')}
        from test_starts w
        join ahead a on a.symbol = w.symbol and a.part = 'test' and a.j between w.w and w.w + {L - 1}
        join parts f on f.symbol = w.symbol and f.part = 'test' and f.j = w.w + {L}""",
    "persisted": f"""select symbol, "window", date,
        {_cols('x_{f} * (max_{f} - min_{f}) + min_{f} as prediction_{f}')}, {_cols('y_{f} as actual_{f}')}
        from test_steps join ranges using (symbol) where t = {L - 1}""",
    "forecast": """select symbol, "window", date, 'close' as category, prediction_close as prediction,
        actual_close as actual from persisted""",
    "vectors": f"""select symbol, i, flatten(list([{_cols('x_{f}')}] order by t)) as x,
        max(y_close) filter (where t = {L - 1}) as y from train_steps group by symbol, i""",
    "weights": f"""select symbol, k, 2 * 0.01e0 * avg(v * y) as v from (
            select symbol, y, unnest(x) as v, generate_subscripts(x, 1) - 1 as k from vectors
            union all select symbol, y, 1.0e0, {L * len(FEATURES)} from vectors)
        group by symbol, k""",
    "test_vectors": f"""select symbol, "window", any_value(date) as date, flatten(list([{_cols('x_{f}')}] order by t)) as x,
        {_cols('any_value(y_{f}) as y_{f}')} from test_steps group by symbol, "window\"""",
    "weight_lists": "select symbol, list(v order by k) as w from weights group by symbol",
    "one_round": f"""select symbol, "window", date, 'close' as category,
        round((list_inner_product(x, w[1:{L * len(FEATURES)}]) + w[-1]) * (max_close - min_close) + min_close, 2) as prediction,
        y_close as actual from test_vectors join weight_lists using (symbol) join ranges using (symbol)""",
    "vectors_all": f"""select symbol, i, flatten(list([{_cols('x_{f}')}] order by t)) as x,
        [{_cols('max(y_{f}) filter (where t = ' + str(L - 1) + ')')}] as y from train_steps group by symbol, i""",
    "weights_all": f"""select symbol, o, list(v order by k) as w from (
            select symbol, o, k, 2 * 0.01e0 / {len(FEATURES)} * avg(v * y) as v from (
                select symbol, i, o, y, unnest(x) as v, generate_subscripts(x, 1) - 1 as k from targets
                union all select symbol, i, o, y, 1.0e0, {L * len(FEATURES)} from targets)
            group by symbol, o, k) group by symbol, o""",
    "targets": "select symbol, i, x, unnest(y) as y, generate_subscripts(y, 1) as o from vectors_all",
    "second": f"""select symbol, k, first.v - 2 * 0.01e0 * second.v as v from weights first join (
            select symbol, k, avg(v * e) as v from (
                select symbol, e, unnest(x) as v, generate_subscripts(x, 1) - 1 as k from errors
                union all select symbol, e, 1.0e0, {L * len(FEATURES)} from errors) group by symbol, k) second using (symbol, k)""",
    "errors": f"""select symbol, x, list_inner_product(x, w[1:{L * len(FEATURES)}]) + w[-1] - y as e
        from vectors join weight_lists using (symbol)""",
}

_NEEDS = {
    "bars": [],
    "ranges": ["bars"],
    "numbered": ["bars"],
    "parts": ["numbered"],
    "scaled": ["parts", "ranges"],
    "train_starts": ["parts"],
    "test_starts": ["parts"],
    "ahead": ["scaled"],
    "train_steps": ["train_starts", "ahead"],
    "test_steps": ["test_starts", "ahead", "parts"],
    "persisted": ["test_steps", "ranges"],
    "forecast": ["persisted"],
    "vectors": ["train_steps"],
    "weights": ["vectors"],
    "test_vectors": ["test_steps"],
    "weight_lists": ["weights"],
    "one_round": ["test_vectors", "weight_lists", "ranges"],
    "vectors_all": ["train_steps"],
    "targets": ["vectors_all"],
    "weights_all": ["targets"],
    "errors": ["vectors", "weight_lists"],
    "second": ["weights", "errors"],
}


_P = L * len(FEATURES)


def _descent(name: str, rate: float, steps: int, chosen: str = "true") -> list[str]:
    """Names of tables ``symbol, w``: weights from zero on, after each of ``steps`` steps over the windows ``chosen`` says
    (``{k}``: the number of the step), and beside each the errors ``symbol, i, x, e`` of all windows."""
    names = []
    for k in range(steps + 1):
        w, e = f"{name}_w{k}", f"{name}_e{k}"
        if k == 0:
            _CTES[w] = f"select symbol, list_transform(range({_P + 1}), lambda k: 0.0e0) as w from vectors group by symbol"
            _NEEDS[w] = ["vectors"]
        else:
            before, errors = f"{name}_w{k - 1}", f"{name}_e{k - 1}"
            _CTES[w] = f"""select symbol, list(old - 2 * {rate}e0 * coalesce(slope, 0.0e0) order by k) as w from (
                    select symbol, unnest(w) as old, generate_subscripts(w, 1) as k from {before}) left join (
                    select symbol, k, avg(v * e) as slope from (
                        select symbol, e, unnest(x || [1.0e0]) as v, generate_subscripts(x || [1.0e0], 1) as k
                        from {errors} where {chosen.format(k=k - 1)}) group by symbol, k) using (symbol, k)
                group by symbol"""
            _NEEDS[w] = [before, errors]
        _CTES[e] = f"select symbol, i, x, list_inner_product(x, w[1:{_P}]) + w[{_P + 1}] - y as e from vectors join {w} using (symbol)"
        _NEEDS[e] = ["vectors", w]
        names.append(w)
    return names


# Four epochs of one round, and two epochs of two rounds of half a block.
_LONG = _descent("long", 0.04, 4)
_HALF = _descent("half", 0.01, 3, "(i % 512) // 256 = {k} % 2")
_CTES["long_losses"] = " union all ".join(
    f"""select symbol, {k} as epoch, train_loss, test_loss from (
        select symbol, avg(e * e) as train_loss from long_e{k} group by symbol) join (
        select symbol, avg((p - y) * (p - y)) as test_loss from (
            select symbol, list_inner_product(x, w[1:{_P}]) + w[{_P + 1}] as p,
                case when max_close > min_close then (y_close - min_close) / (max_close - min_close) else 0.5e0 end as y
            from test_vectors join long_w{k} using (symbol) join ranges using (symbol)) group by symbol) using (symbol)"""
    for k in range(1, 5)
)
_NEEDS["long_losses"] = ["test_vectors", "ranges", *[f"long_e{k}" for k in range(1, 5)]]
# An epoch is there if the loss fell in all epochs before it.
_CTES["long_history"] = """select * from long_losses a where not exists (
        select 1 from long_losses b join long_losses c using (symbol)
        where b.symbol = a.symbol and b.epoch < a.epoch and c.epoch < b.epoch and c.test_loss <= b.test_loss)"""
_NEEDS["long_history"] = ["long_losses"]
_CTES["long_best"] = "select symbol, arg_min(epoch, row(test_loss, epoch)) as epoch from long_history group by symbol"
_NEEDS["long_best"] = ["long_history"]
_CTES["long_weights"] = " union all ".join(f"select symbol, {k} as epoch, w from long_w{k}" for k in range(1, 5))
_NEEDS["long_weights"] = _LONG[1:]


def _running_squares(name: str, before: str | None) -> None:
    """Weights and running squares ``symbol, k, w, s`` after a step of every block, averaged over the blocks."""
    errors = "select symbol, i, x, -y as e from vectors"
    if before is not None:
        errors = f"""select symbol, i, x, list_inner_product(x, w[1:{_P}]) + w[{_P + 1}] - y as e from vectors
            join (select symbol, list(w order by k) as w from {before} group by symbol) using (symbol)"""
    old = f"left join {before} b using (symbol, k)" if before else ""
    w, s = ("b.w", "b.s") if before else ("0.0e0", "0.0e0")
    _CTES[name] = f"""select symbol, k, sum(n * w) / sum(n) as w, sum(n * s) / sum(n) as s from (
            select symbol, k, n, s, w - 0.01e0 * g / (sqrt(s) + 1e-8) as w from (
                select symbol, k, n, g, {w} as w, 0.95e0 * {s} + (1 - 0.95e0) * g * g as s from (
                    select symbol, i // 512 as block, k, count(*) as n, 2 * avg(v * e) as g from (
                        select symbol, i, e, unnest(x || [1.0e0]) as v, generate_subscripts(x || [1.0e0], 1) as k from ({errors}))
                    group by symbol, i // 512, k) {old}))
        group by symbol, k"""
    _NEEDS[name] = ["vectors"] + ([before] if before else [])


_running_squares("squares_1", None)
_running_squares("squares_2", "squares_1")


def _with(select: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS[name]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "with " + ",\n".join(f"{name} as ({_CTES[name]})" for name in ordered) + "\n" + select


_BARS = f"symbol, date, {_cols('{f}')}"
_TRAIN_X = f"symbol, i, cast(t as bigint) as t, {_cols('x_{f}')}"
_TEST_X = f"symbol, \"window\", date, cast(t as bigint) as t, {_cols('x_{f}')}"

ORACLE: dict[str, str] = {
    "bars": _BRAND,
    "supplier_bars": _SUPPLIER,
    "symbol_counts": _with("select symbol, count(date) as count from bars group by symbol", "bars"),
    "symbol_total": _with("select count(distinct symbol) as symbols from bars", "bars"),
    "series_length": _with("select symbol, count(*) as n from bars group by symbol", "bars"),
    "feature_ranges": _with("select * from ranges", "ranges"),
    "feature_ranges_global": _with(f"select {_cols('min({f}) as min_{f}, max({f}) as max_{f}')} from bars", "bars"),
    "minibatch_size": _with("select symbol, count(*) as n, count(*) // 4 as batch_size from bars group by symbol", "bars"),
    "window_counts": _with(
        f"""select symbol, max(n) as n, max(split) as split,
            greatest(max(split) - {REACH}, 0) as train_windows, greatest(max(n) - max(split) - {REACH}, 0) as test_windows
            from parts group by symbol""",
        "parts",
    ),
    "preview": _with(f"select {_BARS} from bars order by symbol, date limit 20", "bars"),
    "cast_project": _BRAND,
    "bars_from_csv": _BRAND,
    "listed_bars": _with("select * from bars where symbol in (select p_brand from part where p_size > 49)", "bars"),
    "written_predictions": _with("select * from forecast", "forecast"),
    "select_symbols": _with("select * from bars where symbol = 'Brand#13'", "bars"),
    **dict.fromkeys(
        ("symbol_semi_join", "bars_from_listed_files"),
        f"""select * from ({_SUPPLIER}) where symbol in (select concat('S', s_suppkey) from supplier where s_acctbal > 0)""",
    ),
    "missing_symbols": _with(
        """select symbol from (select concat('S', s_suppkey) as symbol from supplier union select p_brand from part)
            where symbol not in (select symbol from bars)""",
        "bars",
    ),
    "target_column": _with(f"select symbol, date, {_cols('{f} as target_{f}')}, {_cols('{f} as all_{f}')} from bars", "bars"),
    "drop_last_bars": _with(f"select {_BARS} from numbered where i < n - 1", "numbered"),
    "union_bars": f"select * from ({_BRAND}) union all select * from ({_SUPPLIER})",
    "index_bars": _with("select symbol, date, i, n from numbered", "numbered"),
    **dict.fromkeys(
        ("intraday_positions", "intraday_positions_sliced"),
        """select event_type as symbol, event_id, row_number() over (partition by event_type order by ts, value) - 1 as i,
            count(*) over (partition by event_type) as n from events""",
    ),
    "chronological_split": _with("select symbol, date, i, n, split, part, j from parts", "parts"),
    "minmax_symbol": _with(f"select symbol, date, {_cols(_SCALE + ' as {f}')} from bars join ranges using (symbol)", "ranges"),
    "minmax_train_only": _with(
        f"""select symbol, date, {_cols(_SCALE + ' as {f}')} from parts join (
            select symbol, {_cols('min({f}) as min_{f}, max({f}) as max_{f}')} from parts where part = 'train'
            group by symbol) using (symbol)""",
        "parts",
    ),
    "minmax_global": _with(
        f"""select symbol, date, {_cols('round(({f} - min({f}) over ()) / (max({f}) over () - min({f}) over ()), 9) as {f}')}
            from bars""",
        "bars",
    ),
    "inverse_scale": _with("select symbol, date, s_close * (max_close - min_close) + min_close as prediction from scaled", "scaled"),
    "inverse_scale_all": _with(
        f"select symbol, date, {_cols('s_{f} * (max_{f} - min_{f}) + min_{f} as back_{f}')} from scaled", "scaled"
    ),
    "train_windows": _with(f"select {_TRAIN_X}, y_close as y from train_steps", "train_steps"),
    "train_windows_blocked": _with(f"select {_TRAIN_X}, y_close as y from train_steps", "train_steps"),
    "train_windows_all": _with(f"select {_TRAIN_X}, {_cols('y_{f}')} from train_steps", "train_steps"),
    "test_windows": _with(f"select {_TEST_X}, y_close as y from test_steps", "test_steps"),
    "test_windows_blocked": _with(f"select {_TEST_X}, y_close as y from test_steps", "test_steps"),
    "test_windows_all": _with(f"select {_TEST_X}, {_cols('y_{f}')} from test_steps", "test_steps"),
    "assign_batches": _with("select symbol, i, i // 64 as batch from train_starts", "train_starts"),
    "persistence_forecast": _with("select * from forecast", "forecast"),
    "persistence_forecast_all": _with(
        f"""select symbol, "window", date, 'all' as category, {_cols('prediction_{f}')}, {_cols('actual_{f}')}
            from persisted""",
        "persisted",
    ),
    "mean_loss": _with(
        "select symbol, round(avg((prediction - actual) * (prediction - actual)), 2) as loss from forecast group by symbol",
        "forecast",
    ),
    "best_epoch": _with(
        """select symbol, arg_min(epoch, row(loss, epoch)) as epoch, min(loss) as loss from (
            select symbol, year(date) * 12 + month(date) as epoch,
                round(avg((prediction - actual) * (prediction - actual)), 2) as loss
            from forecast group by 1, 2) group by symbol""",
        "forecast",
    ),
    "value_bounds": _with(
        """select symbol, cast(trunc(min(least(prediction, actual)) * 0.98e0) as int) as min_value,
            cast(trunc(max(greatest(prediction, actual)) * 1.02e0) as int) as max_value from forecast group by symbol""",
        "forecast",
    ),
    "value_bounds_global": _with(
        """select cast(trunc(min(least(prediction, actual)) * 0.98e0) as int) as min_value,
            cast(trunc(max(greatest(prediction, actual)) * 1.02e0) as int) as max_value from forecast""",
        "forecast",
    ),
    "prediction_series": _with(
        """select symbol, "window", 'prediction' as series, prediction as value from forecast
            union all select symbol, "window", 'actual' as series, actual as value from forecast""",
        "forecast",
    ),
    "documents": _with('select symbol, "window" // 100 as page, "window", prediction, actual from forecast', "forecast"),
    "weighted_param_average": """select symbol, k, round(sum(v * n) / sum(n), 6) as v from (
            select p_brand as symbol, l_suppkey, count(*) as n,
                unnest([min(l_extendedprice), max(l_extendedprice), sum(l_quantity)]) as v, unnest([0, 1, 2]) as k
            from lineitem join part on l_partkey = p_partkey group by p_brand, l_suppkey)
        group by symbol, k""",
    "averaged_round": _with("select symbol, k, round(v, 9) as v from weights", "weights"),
    "averaged_round_sized": _with("select symbol, k, round(v, 9) as v from weights", "weights"),
    "averaged_round_joined": _with("select symbol, k, round(v, 9) as v from second", "second"),
    **dict.fromkeys(
        ("early_stopping", "early_stopping_by_maps"),
        _with("select symbol, epoch, round(train_loss, 9) as train_loss, round(test_loss, 9) as test_loss from long_history", "long_history"),
    ),
    "best_epoch_weights": _with(
        "select symbol, k - 1 as k, round(v, 9) as v from (select symbol, unnest(w) as v, generate_subscripts(w, 1) as k from long_weights join long_best using (symbol, epoch))",
        "long_weights", "long_best",
    ),
    **dict.fromkeys(
        ("round_history", "round_history_by_maps"),
        _with(
            " union all ".join(
                f"select symbol, {1 + k // 2} as epoch, {k % 2} as round, round(avg(e * e), 9) as loss from half_e{k} where (i % 512) // 256 = {k % 2} group by symbol"
                for k in range(4)
            ),
            *[f"half_e{k}" for k in range(4)],
        ),
    ),
    "continued_updater": _with(
        f"select symbol, k - 1 as k, round(w, 9) as v from squares_2 union all select symbol, {_P} + k as k, round(s, 9) as v from squares_2", "squares_2"
    ),
    "linear_per_symbol": _with(f"select symbol, unnest(range({_P + 1})) as k, 0.0e0 as slope from (select distinct symbol from train_starts)", "train_starts"),
    "continued_round": _with("select symbol, k, round(v, 9) as v from second", "second"),
    "training_history": _with(
        f"""select symbol, 1 as epoch, round(train_loss, 9) as train_loss, round(test_loss, 9) as test_loss
        from (select symbol, avg(e * e) as train_loss from errors group by symbol) left join (
            select symbol, avg((p - y) * (p - y)) as test_loss from (
                select symbol, list_inner_product(x, w[1:{L * len(FEATURES)}]) + w[-1] as p,
                    case when max_close > min_close then (y_close - min_close) / (max_close - min_close) else 0.5e0 end as y
                from test_vectors join weight_lists using (symbol) join ranges using (symbol))
            group by symbol) using (symbol)""",
        "errors", "test_vectors", "weight_lists", "ranges",
    ),
    "one_round_forecast": _with("select * from one_round", "one_round"),
    "reloaded_forecast": _with("select * from one_round", "one_round"),
    "one_round_forecast_all": _with(
        f"""select symbol, "window", date, 'all' as category, {", ".join(f'round((list_inner_product(x, w{k}[1:{L * len(FEATURES)}]) + w{k}[-1]) * (max_{f} - min_{f}) + min_{f}, 2) as prediction_{f}' for k, f in enumerate(FEATURES, 1))},
            {_cols('y_{f} as actual_{f}')}
            from test_vectors join ranges using (symbol) join (
                select symbol, {", ".join(f'any_value(w) filter (where o = {k}) as w{k}' for k in range(1, len(FEATURES) + 1))}
                from weights_all group by symbol) using (symbol)""",
        "test_vectors", "ranges", "weights_all",
    ),
    "linear_gradient": f"select unnest(range({L * len(FEATURES) + 1})) as k, 0.0e0 as slope",
    "documents_all": _with(
        f"""select symbol, "window" // 100 as page, "window", {_cols('prediction_{f}')}, {_cols('actual_{f}')} from persisted""",
        "persisted",
    ),
    "bars_from_symbol_files": _BRAND,
}
