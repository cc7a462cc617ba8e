"""The registered queries of the profiling engine, each with SQL that finds the same in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.inference import RANKS, inferred, is_null_token, type_name
from .functions.keys import supported_columns
from .operators import candidates as cand
from .operators.checks import check_equivalent, check_ocd, check_od, column_profile, constant_columns, od_violations, pair_verdicts
from .operators.ordering import ordered_by_all, ordered_indices, sorted_column, sorted_with_positions, with_positions
from .plans.discovery import discover, reduction
from .plans.verdicts import Checker
from .search_sql import counts_sql, kind_sql, lines_sql, results_sql, search_tables
from .sources.csv import from_texts, infer_types, lost_values, read_csv
from .sources.results import metrics, result_lines
from .storage import cut_lineage, new_path

#: Columns of texts over a table, each a mix of types, null tokens and values that do not fit, in SQL that both engines read.
MIXED = {
    "number": "CASE n_nationkey % 5 WHEN 0 THEN concat(n_regionkey, '') WHEN 1 THEN concat(n_nationkey, '.5') WHEN 2 THEN n_name WHEN 3 THEN NULL ELSE '?' END",
    "whole": "CASE n_nationkey % 5 WHEN 1 THEN n_name WHEN 2 THEN concat('-', n_nationkey) WHEN 3 THEN 'null' WHEN 4 THEN '' ELSE concat(n_nationkey, '') END",
    "word": "CASE n_nationkey % 4 WHEN 1 THEN '' WHEN 3 THEN 'NULL' ELSE concat(n_name, ' ', n_regionkey) END",
    "day": "CASE n_nationkey % 5 WHEN 0 THEN concat(n_nationkey, '') WHEN 2 THEN '01/28/1997' WHEN 3 THEN '2012-02-30' ELSE concat('2011-12-', n_nationkey % 20 + 10) END",
}
#: Texts of every type made from a row of a table.
LINE_TEXT = (
    "CASE l_orderkey % 12 WHEN 0 THEN concat(l_quantity + 0.25, '') WHEN 1 THEN concat(l_partkey, '') WHEN 2 THEN concat('00', l_suppkey) WHEN 3 THEN concat(CAST(l_shipdate AS date), '') WHEN 4 THEN concat(CAST(l_shipdate AS date), '+01:00') "
    "WHEN 5 THEN concat(CAST(l_shipdate AS date), 'T23:59:59') WHEN 6 THEN concat(CAST(l_shipdate AS date), 'T05:06:07+01:00') WHEN 7 THEN concat(CAST(l_shipdate AS date), ' 23:59:59') WHEN 8 THEN concat(l_returnflag, ' ', l_linenumber) "
    "WHEN 9 THEN CASE l_linenumber WHEN 1 THEN '?' WHEN 2 THEN '' WHEN 3 THEN 'NULL' ELSE 'null' END WHEN 10 THEN concat(l_partkey, '.') ELSE l_linestatus END"
)


#: Views over the driver's tables: select list and table, in SQL that both engines read.
VIEWS = {
    "fixture": ("year(o_orderdate) - 1990 AS A, floor((year(o_orderdate) * 12 + month(o_orderdate) - 1) / 2) AS B, floor((year(o_orderdate) * 12 + month(o_orderdate) - 1) / 3) AS C, quarter(o_orderdate) AS D, quarter(o_orderdate) * 10 AS E, 0 AS F", "orders"),
    "orders_cal": ("o_orderdate AS od, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, year(o_orderdate) * 100 + month(o_orderdate) AS ym, year(o_orderdate) * 10 + quarter(o_orderdate) AS yq, day(o_orderdate) AS d, 1 AS one", "orders"),
    "order_tier": ("o_totalprice AS price, floor(o_totalprice / 50000) AS tier, floor(o_totalprice / 1000) AS band, o_orderstatus AS status, o_orderdate AS od, year(o_orderdate) AS y", "orders"),
    "line_pricing": ("l_quantity AS qty, floor(l_quantity / 17) AS qty_band, l_discount AS disc, l_tax AS tax, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS big, l_shipdate AS ship, year(l_shipdate) AS ship_year", "lineitem"),
    "event_hour": ("ts, event_id, hour(ts) AS h, day(ts) AS d, event_type AS kind, user_id AS u", "events"),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's, or one of VIEWS over it."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    what, source = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(x.strip() for x in _top_level(what)))


def _top_level(what: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in what:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def view_sql(name: str) -> str:
    return f"SELECT {VIEWS[name][0]} FROM {VIEWS[name][1]}" if name in VIEWS else f"SELECT * FROM {name}"


_TIMES = {"od", "ship", "ts", "o_orderdate", "l_shipdate"}


def key_sql(c: str) -> str:
    return f"date_trunc('second', {c})" if c in _TIMES else c


def order_sql(columns) -> str:
    return ", ".join(f"{key_sql(c)} NULLS FIRST" for c in columns)


def ranks_sql(view_name: str, x, y) -> str:
    """Distinct dense ranks of both lists beside those of the neighbour before."""
    return (
        f"SELECT rx, ry, lag(rx) OVER (ORDER BY rx, ry) AS px, lag(ry) OVER (ORDER BY rx, ry) AS py FROM (SELECT DISTINCT dense_rank() OVER (ORDER BY {order_sql(x)}) AS rx, "
        f"dense_rank() OVER (ORDER BY {order_sql(y)}) AS ry FROM ({view_sql(view_name)}) AS t) AS r"
    )


def violations_sql(view_name: str, x, y) -> str:
    return (
        "SELECT CAST(coalesce(sum(CASE WHEN px = rx AND py <> ry THEN 1 ELSE 0 END), 0) AS BIGINT) AS splits, "
        f"CAST(coalesce(sum(CASE WHEN py > ry THEN 1 ELSE 0 END), 0) AS BIGINT) AS swaps FROM ({ranks_sql(view_name, x, y)}) AS l"
    )


def verdict_sql(view_name: str, x, y) -> str:
    """One row: x and y as text, ocd, od_xy, od_yx, each direction from its own order."""
    a, b, both = violations_sql(view_name, x, y), violations_sql(view_name, y, x), violations_sql(view_name, [*x, *y], [*y, *x])
    return (
        f"SELECT '{','.join(x)}' AS x, '{','.join(y)}' AS y, (SELECT splits + swaps = 0 FROM ({both}) AS v) AS ocd, "
        f"(SELECT splits + swaps = 0 FROM ({a}) AS v) AS od_xy, (SELECT splits + swaps = 0 FROM ({b}) AS v) AS od_yx"
    )


def tables_sql(name: str) -> str:
    return search_tables(view_sql(name), [key_sql(c) for c in COLUMNS[name].split()], COLUMNS[name].split())


def profile_sql(name: str, columns, constant: bool) -> str:
    parts = [f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) + coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0) AS n_distinct FROM ({view_sql(name)}) AS t" for c in columns]
    every = f"({' UNION ALL '.join(parts)}) AS p"
    return f'SELECT "column" FROM {every} WHERE n_distinct = 1' if constant else f'SELECT "column", n_rows, CAST(n_distinct AS BIGINT) AS n_distinct, n_distinct = 1 AS is_constant FROM {every}'


# The columns of the driver's tables that have an order.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    "fixture": "A B C D E F", "orders_cal": "od y q m ym yq d one", "order_tier": "price tier band status od y", "line_pricing": "qty qty_band disc tax big ship ship_year", "event_hour": "ts event_id h d kind u",
}


def as_text(results: DataFrame) -> DataFrame:
    return results.select("kind", F.array_join("lhs", ",").alias("lhs"), F.array_join("rhs", ",").alias("rhs"))


def _registered() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    queries, sql = {}, {}

    def add(name: str, query, text: str | None) -> None:
        queries[name] = query
        if text is not None:
            sql[name] = text

    for t in (*TABLES, *VIEWS):
        cols = COLUMNS[t].split()
        add(f"const_columns_{t}", lambda s, d, t=t: constant_columns(view(s, d, t)), profile_sql(t, cols, True))
        add(f"distinct_profile_{t}", lambda s, d, t=t: column_profile(view(s, d, t)), profile_sql(t, cols, False))
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "fixture", "order_tier"):
        cols = COLUMNS[t].split()
        pairs = " UNION ALL ".join(verdict_sql(t, [a], [b]) for i, a in enumerate(cols) for b in cols[i + 1 :])
        add(f"pair_verdicts_{t}", lambda s, d, t=t: pair_verdicts(view(s, d, t), supported_columns(view(s, d, t))), f"SELECT x AS a, y AS b, ocd, od_xy AS od_ab, od_yx AS od_ba, od_xy AND od_yx AS equivalent FROM ({pairs}) AS v")
    for t in ("region", "customer", "supplier", "events", "fixture"):
        cols = COLUMNS[t].split()
        pairs = " UNION ALL ".join(verdict_sql(t, [a], [b]) for i, a in enumerate(cols) for b in cols[i + 1 :])
        constants = profile_sql(t, cols, True)
        same = f"v AS ({pairs}), gone AS ({constants}), e AS (SELECT x, y FROM v WHERE od_xy AND od_yx AND x NOT IN (SELECT \"column\" FROM gone) AND y NOT IN (SELECT \"column\" FROM gone))"
        names = ", ".join(f"('{c}', {i})" for i, c in enumerate(cols))
        add(f"equiv_classes_{t}", lambda s, d, t=t: _classes(s, view(s, d, t)), f"WITH {same} SELECT x AS representative, y AS member FROM e WHERE x NOT IN (SELECT y FROM e)")
        add(f"reduced_columns_{t}", lambda s, d, t=t: s.createDataFrame([(c,) for c in reduction(view(s, d, t))[1]], "name string"), f"WITH {same}, n(c, i) AS (VALUES {names}) SELECT c AS name FROM n WHERE c NOT IN (SELECT \"column\" FROM gone) AND c NOT IN (SELECT y FROM e)")
    checks = {
        "date_year": ("orders_cal", ["od"], ["y"]), "yearmonth_year": ("orders_cal", ["ym"], ["y"]), "month_quarter": ("orders_cal", ["m"], ["q"]), "quarter_month": ("orders_cal", ["q"], ["m"]),
        "price_tier": ("order_tier", ["price"], ["tier"]), "tier_price": ("order_tier", ["tier"], ["price"]), "quantity_price": ("lineitem", ["l_quantity"], ["l_extendedprice"]), "ts_event": ("events", ["ts"], ["event_id"]),
        "status_price": ("orders", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]), "list_year_month": ("orders_cal", ["y", "m"], ["ym"]), "list_to_list": ("orders_cal", ["ym"], ["y", "q", "m"]), "list_wrong_order": ("orders_cal", ["m", "y"], ["ym"]), "fixture_lists": ("fixture", ["A", "C"], ["B", "D"]),
    }
    for name, (t, x, y) in checks.items():
        text = violations_sql(t, x, y)
        add(f"od_check_{name}", lambda s, d, t=t, x=x, y=y: od_violations(view(s, d, t), x, y), text)
        both = violations_sql(t, [*x, *y], [*y, *x])
        add(f"holds_{name}", lambda s, d, t=t, x=x, y=y: s.createDataFrame([(check_od(v := view(s, d, t), x, y), check_ocd(v, x, y))], "od boolean, ocd boolean"), f"SELECT (SELECT splits + swaps = 0 FROM ({text}) AS v) AS od, (SELECT splits + swaps = 0 FROM ({both}) AS v) AS ocd")
    # the candidates that a search of a table's view asks about, by name
    for t, end in (("orders_cal", "_orders_cal"), ("line_pricing", "")):
        told = lambda side, names=COLUMNS[t].split(): f"array_to_string(list_transform({side}, lambda k: [{', '.join(map(repr, names))}][k]), ',')"
        add(f"level1_candidates{end}", lambda s, d, t=t: _asked(view(s, d, t), 1), f"{tables_sql(t)} SELECT {told('x')} AS x, {told('y')} AS y FROM v1")
        add(f"level2_candidates{end}", lambda s, d, t=t: _asked(view(s, d, t), 2), f"{tables_sql(t)} SELECT {told('x')} AS x, {told('y')} AS y FROM c2")
        add(f"mirrored_candidates{end}", lambda s, d, t=t: _asked(view(s, d, t), 2, mirror=True), f"{tables_sql(t)} SELECT {told('y')} AS x, {told('x')} AS y FROM c2")
    add("discover_fixture", lambda s, d: as_text(discover(view(s, d, "fixture")).results), f"{tables_sql('fixture')} {results_sql(COLUMNS['fixture'].split())}")
    add("discover_fixture_all_ocds", lambda s, d: as_text(discover(view(s, d, "fixture"), comparability=False).results), f"{tables_sql('fixture')} {results_sql(COLUMNS['fixture'].split(), False)}")
    # whole tables, all columns, all levels: `discover_whole_` reports OCDs where no side orders the other, `discover_` all of them
    for t in ("order_tier", "line_pricing", "event_hour", "orders_cal", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        names = COLUMNS[t].split()
        add(f"discover_whole_{t}", lambda s, d, t=t: as_text(discover(view(s, d, t)).results), f"{tables_sql(t)} {results_sql(names)}")
        if t in VIEWS:
            add(f"discover_{t}", lambda s, d, t=t: as_text(discover(view(s, d, t), comparability=False).results), f"{tables_sql(t)} {results_sql(names, False)}")
    # the way of tables of any size: ranks made on the cluster, a job a level
    for t in ("lineitem", "orders_cal", "line_pricing"):
        add(f"discover_by_codes_{t}", lambda s, d, t=t: as_text(discover(view(s, d, t), most_ranks=0).results), f"{tables_sql(t)} {results_sql(COLUMNS[t].split())}")
    for t, by, key in (("nation", ["n_regionkey"], "n_nationkey"), ("supplier", ["s_nationkey", "s_acctbal"], "s_suppkey"), ("customer", ["c_mktsegment", "c_nationkey"], "c_custkey"), ("orders", ["o_orderdate", "o_orderstatus"], "o_orderkey")):
        add(f"ordered_indices_{t}", lambda s, d, t=t, by=by, key=key: ordered_indices(view(s, d, t), by, key), f'SELECT row_number() OVER (ORDER BY {order_sql(by)}, {key}) - 1 AS position, {key} AS "index" FROM {t}')
    for t, column, key in (("nation", "n_regionkey", "n_nationkey"), ("supplier", "s_acctbal", "s_suppkey"), ("orders", "o_orderdate", "o_orderkey")):
        order = f"row_number() OVER (ORDER BY {order_sql([column])}, {key}) - 1 AS position"
        add(f"sorted_with_indices_{t}", lambda s, d, t=t, column=column, key=key: sorted_with_positions(view(s, d, t), column, key), f'SELECT {order}, {column} AS value, {key} AS "index" FROM {t}')
        add(f"sorted_indices_{t}", lambda s, d, t=t, column=column, key=key: ordered_indices(view(s, d, t), [column], key), f'SELECT {order}, {key} AS "index" FROM {t}')
        add(f"sorted_column_{t}", lambda s, d, t=t, column=column: sorted_column(view(s, d, t), column), f"SELECT {column} FROM {t} ORDER BY {order_sql([column])}")
    for t, key in (("nation", "n_nationkey"), ("supplier", "s_suppkey")):
        rest = [c for c in COLUMNS[t].split() if c != key]
        add(f"ordered_by_all_{t}", lambda s, d, t=t, key=key, rest=rest: ordered_by_all(view(s, d, t).select(*rest, key), key), f'SELECT row_number() OVER (ORDER BY {order_sql(rest)}, {key}) - 1 AS position, {key} AS "index" FROM {t}')
    for t, a, b in (("events", "event_id", "ts"), ("customer", "c_custkey", "c_name"), ("customer", "c_custkey", "c_acctbal"), ("fixture", "D", "E"), ("fixture", "A", "B")):
        add(f"check_equivalent_{t}_{a}_{b}", lambda s, d, t=t, a=a, b=b: s.createDataFrame([(check_equivalent(view(s, d, t), a, b),)], "equivalent boolean"), f"SELECT od_xy AND od_yx AS equivalent FROM ({verdict_sql(t, [a], [b])}) AS v")
    lines = lambda s, d: view(s, d, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", f"{LINE_TEXT} AS value")
    line_texts = f"(SELECT l_orderkey AS k, l_linenumber AS n, {LINE_TEXT} AS value FROM lineitem) AS t"
    add("infer_types", lambda s, d: lines(s, d).select("k", "n", "value", type_name(inferred(F.col("value"))["rank"]).alias("kind")), f"SELECT k, n, value, {kind_sql('value')} AS kind FROM {line_texts}")
    add("null_tokens", lambda s, d: lines(s, d).select("k", "n", is_null_token(F.col("value")).alias("is_null")), f"SELECT k, n, (value = '' OR lower(value) = 'null' OR value = '?') AS is_null FROM {line_texts}")
    # columns of texts: their types, the values that do not fit, and what is read
    names = list(MIXED)
    source = f"(SELECT {', '.join(f'{made} AS {n}' for n, made in MIXED.items())} FROM nation) AS t"
    mixed_rows = lambda s, d: view(s, d, "nation").selectExpr("CAST(n_nationkey AS long) AS _idx", *(f"{made} AS {n}" for n, made in MIXED.items()))
    kinds = " UNION ALL ".join(f"SELECT '{n}' AS \"column\", arg_max(k, list_position({list(RANKS)}, k)) AS kind FROM (SELECT {kind_sql(n)} AS k FROM {source}) AS u" for n in names)
    add("column_types_mixed", lambda s, d: s.createDataFrame([(n, kind) for n, (kind, _) in infer_types(mixed_rows(s, d), names).items()], "column string, kind string"), kinds)
    day = "CASE WHEN regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(day AS DATE) END"
    unread = {"number": "try_cast(number AS DOUBLE) IS NULL", "whole": "try_cast(whole AS BIGINT) IS NULL", "word": "false", "day": f"({day}) IS NULL"}
    lost = " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) FILTER ({kind_sql(n)} <> 'null' AND {test}) AS lost FROM {source}" for n, test in unread.items())
    add("lost_values_mixed", lambda s, d: lost_values(mixed_rows(s, d), infer_types(mixed_rows(s, d), names)), lost)
    add("from_texts_mixed", lambda s, d: from_texts(s, _listed(mixed_rows(s, d))), f"SELECT try_cast(number AS DOUBLE) AS number, try_cast(whole AS BIGINT) AS whole, CASE WHEN {kind_sql('word')} <> 'null' THEN word END AS word, {day} AS day FROM {source}")
    # tables by way of CSV files: with and without a header, several delimiters, quotes
    for t, options, read in (("nation", {"header": True}, {"header": True}), ("supplier", {"sep": ";", "header": True, "quoteAll": True}, {"header": True}), ("part", {"sep": "|", "header": True}, {"header": True}), ("customer", {"sep": "\t"}, {})):
        columns = COLUMNS[t].split()
        got = columns if read else [chr(ord("A") + i) for i in range(len(columns))]
        typed = ", ".join(f"{c} AS {g}" for c, g in zip(columns, got, strict=True))
        add(f"csv_{t}", lambda s, d, t=t, columns=columns, options=options, read=read: _through_csv(s, view(s, d, t).select(*columns), options, read), f"SELECT {typed} FROM {t}")
    # dates, timestamps, null tokens, values of other formats and line feeds by way of CSV files: how the text is made, how the table is read back, and the same as SQL
    us, iso = "date_format(o_orderdate, 'MM/dd/yyyy')", "date_format(o_orderdate, 'yyyy-MM-dd')"
    price = "CASE o_orderkey % 7 WHEN 1 THEN '?' WHEN 2 THEN 'NULL' WHEN 3 THEN '' ELSE CAST(o_totalprice AS string) END"
    through = {
        "orders": (
            "orders", ["o_orderkey AS k", f"CASE WHEN o_orderkey % 5 = 3 THEN {iso} ELSE {us} END AS day", f"{price} AS price", "o_orderpriority AS p"], {"header": True}, ["k", "day", "price", "p"],
            "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 3 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 7 NOT IN (1, 2, 3) THEN o_totalprice END AS price, o_orderpriority AS p FROM orders",
        ),
        "lineitem": (
            "lineitem", ["l_orderkey AS k", "l_linenumber AS n", "concat(date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00') AS shipped", "CASE WHEN l_tax > 0.04 THEN 'none' ELSE CAST(l_tax AS string) END AS tax"], {"sep": ";"}, ["A AS k", "B AS n", "unix_seconds(C) AS shipped", "D AS tax"],
            "SELECT l_orderkey AS k, l_linenumber AS n, CAST(epoch(l_shipdate) AS BIGINT) - 7200 AS shipped, CASE WHEN l_tax <= 0.04 THEN l_tax END AS tax FROM lineitem",
        ),
        "events": (
            "events", ["event_id AS id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS ts", "date_format(ts, 'yyyy-MM-dd') AS day", "event_type AS kind"], {"header": True, "sep": "\t"}, ["id", "ts", "day", "kind"],
            "SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, event_type AS kind FROM events",
        ),
        "order_notes": (
            "orders", ["o_orderkey AS k", "concat(o_orderpriority, chr(10), '\"', o_orderstatus, '\", 5\" pipe', chr(10), chr(10), 'end') AS note", "o_custkey AS c"], {"header": True, "escape": '"'}, ["k", "note", "c"],
            "SELECT o_orderkey AS k, concat(o_orderpriority, chr(10), '\"', o_orderstatus, '\", 5\" pipe', chr(10), chr(10), 'end') AS note, o_custkey AS c FROM orders",
        ),
    }
    for name, (t, made, options, back, sql_text) in through.items():
        add(f"csv_{name}", lambda s, d, t=t, made=made, options=options, back=back: _through_csv(s, view(s, d, t).selectExpr(*made), options, {"header": "header" in options}).selectExpr(*back), sql_text)
    # texts of every type made from a table's values
    forms = ["CAST(o_totalprice AS {string})", "CAST(o_custkey AS {string})", "CAST(CAST(o_orderdate AS date) AS {string})", "concat(CAST(CAST(o_orderdate AS date) AS {string}), 'T08:09:10')", "concat(CAST(CAST(o_orderdate AS date) AS {string}), 'T08:09Z')", "o_orderpriority", "'?'", "concat('00', CAST(o_custkey AS {string}))", "concat(CAST(CAST(o_orderdate AS date) AS {string}), '+01:00')", "concat(CAST(o_custkey AS {string}), ' ', o_orderstatus)", "''"]
    text = f"CASE o_orderkey % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"
    add("value_types_orders", lambda s, d: view(s, d, "orders").selectExpr("o_orderkey AS k", f"{text.replace('{string}', 'string')} AS value").select("k", "value", type_name(inferred(F.col("value"))["rank"]).alias("kind"), is_null_token(F.col("value")).alias("is_null")), f"SELECT k, value, {kind_sql('value')} AS kind, {kind_sql('value')} = 'null' AS is_null FROM (SELECT o_orderkey AS k, {text.replace('{string}', 'VARCHAR')} AS value FROM orders) AS t")
    # rows by their place in the files, where there is no key
    for t in ("lineitem", "events"):
        columns = COLUMNS[t].split()
        shown = ", ".join(columns[:3])
        add(f"row_positions_{t}", lambda s, d, t=t, columns=columns: with_positions(view(s, d, t)).select("position", *columns[:3]), f"SELECT row_number() OVER () - 1 AS position, {shown} FROM {t}")
    add("sorted_indices_lineitem", lambda s, d: ordered_indices(with_positions(view(s, d, "lineitem")), ["l_shipdate", "l_returnflag"], "position"), f'SELECT row_number() OVER (ORDER BY {order_sql(["l_shipdate", "l_returnflag"])}, place) - 1 AS position, place AS "index" FROM (SELECT *, row_number() OVER () - 1 AS place FROM lineitem) AS t')
    for t in ("orders_cal", "order_tier"):
        add(f"result_lines_{t}", lambda s, d, t=t: result_lines(s, discover(view(s, d, t))), f"{tables_sql(t)} {lines_sql(COLUMNS[t].split())}")
        add(f"metrics_counts_{t}", lambda s, d, t=t: metrics(s, discover(view(s, d, t))).where("metric IN ('CCs', 'OECs', 'ODs', 'OCDs')").where("value > 0 OR metric IN ('CCs', 'OECs')").select("metric", "value"), f"{tables_sql(t)} {counts_sql(COLUMNS[t].split())}")
    add("result_lines", lambda s, d: result_lines(s, discover(view(s, d, "fixture"))), f"{tables_sql('fixture')} {lines_sql(COLUMNS['fixture'].split())}")
    add("metrics_counts", lambda s, d: metrics(s, discover(view(s, d, "fixture"))).where("metric IN ('CCs', 'OECs', 'ODs', 'OCDs')").select("metric", "value"), f"{tables_sql('fixture')} {counts_sql(COLUMNS['fixture'].split())}")
    return queries, sql


def _through_csv(spark: SparkSession, df: DataFrame, written: dict, read: dict) -> DataFrame:
    path = new_path(spark, "csv")
    df.write.options(**written).csv(path)
    return read_csv(spark, path, **read)


def _listed(texts: DataFrame) -> dict[str, list[str | None]]:
    """Columns as lists on the driver, the form that `from_texts` takes: of a table of nations alone, which does not grow."""
    rows = texts.orderBy("_idx").collect()
    return {n: [r[n] for r in rows] for n in texts.columns if n != "_idx"}


def _asked(df: DataFrame, level: int, mirror: bool = False) -> DataFrame:
    """x, y as texts: the candidates of the first or second level of the search over the reduced columns."""
    columns = list(reduction(df)[1])
    ids, checker = range(len(columns)), Checker(df, columns)
    asked = cand.first_candidates(df.sparkSession, ids)
    if level > 1:
        valid = cut_lineage(checker.verdicts(asked))
        asked = cand.expanded(valid.where("ocd AND NOT od_xy"), ids, True).unionByName(cand.expanded(valid.where("ocd AND NOT od_yx"), ids, False)).dropDuplicates()
    sides = cand.named(cand.mirrored(asked) if mirror else asked, columns)
    return sides.select(F.array_join("lhs", ",").alias("x"), F.array_join("rhs", ",").alias("y"))


def _classes(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(r, m) for r, members in reduction(df)[1].items() for m in members[1:]]
    return spark.createDataFrame(rows, "representative string, member string")


QUERIES, ORACLES = _registered()
__all__ = ["ORACLES", "QUERIES", "RANKS", "view"]
