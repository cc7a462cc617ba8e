"""The whole search as SQL, over lists of dense ranks and one table a level: another way to what `discover` finds."""

from __future__ import annotations

from collections.abc import Sequence


def search_tables(select: str, keys: Sequence[str], names: Sequence[str]) -> str:
    """WITH ...: cols, varied, same (equivalent pairs), kept (reduced columns), found (valid candidates of all levels).

    `select` gives the table, `keys` what each column is ordered by. Lists hold column numbers from 1.
    """
    ranks = ", ".join(f"dense_rank() OVER (ORDER BY {k} NULLS FIRST)" for k in keys)
    columns = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names, 1))
    verdicts = (
        "SELECT x, y, bool_and(coalesce(before <= ky, true)) AS ocd, bool_and(coalesce(before <= ky, true)) AND count(DISTINCT kx) = count(*) AS od_xy, "
        "bool_and(coalesce(before <= ky, true)) AND count(DISTINCT ky) = count(*) AS od_yx FROM (SELECT x, y, kx, ky, lag(ky) OVER (PARTITION BY x, y ORDER BY kx, ky) AS before "
        "FROM (SELECT DISTINCT c.x, c.y, list_transform(c.x, lambda k: t.r[k]) AS kx, list_transform(c.y, lambda k: t.r[k]) AS ky FROM {of} AS c, ranked AS t) AS a) AS b GROUP BY x, y"
    )
    parts = [
        f"ranked AS MATERIALIZED (SELECT DISTINCT [{ranks}] AS r FROM ({select}) AS source)",
        f"cols(i, name) AS (VALUES {columns})",
        "varied AS MATERIALIZED (SELECT i, name FROM cols, ranked GROUP BY i, name HAVING count(DISTINCT r[i]) > 1)",
        "c0 AS (SELECT [a.i] AS x, [b.i] AS y FROM varied AS a, varied AS b WHERE a.i < b.i)",
        f"v0 AS MATERIALIZED ({verdicts.format(of='c0')})",
        "same AS (SELECT x[1] AS first, y[1] AS later FROM v0 WHERE od_xy AND od_yx)",
        "kept AS MATERIALIZED (SELECT i, name FROM varied WHERE i NOT IN (SELECT later FROM same))",
        "v1 AS MATERIALIZED (SELECT * FROM v0 WHERE x[1] IN (SELECT i FROM kept) AND y[1] IN (SELECT i FROM kept))",
    ]
    levels = max(1, len(names) - 1)
    for k in range(1, levels):
        unused = f"FROM v{k} AS v, kept AS c WHERE v.ocd AND NOT list_contains(v.x, c.i) AND NOT list_contains(v.y, c.i)"
        parts.append(f"c{k + 1} AS (SELECT list_append(v.x, c.i) AS x, v.y {unused} AND NOT v.od_xy UNION SELECT v.x, list_append(v.y, c.i) {unused} AND NOT v.od_yx)")
        parts.append(f"v{k + 1} AS MATERIALIZED ({verdicts.format(of=f'c{k + 1}')})")
    parts.append("found AS (" + " UNION ALL ".join(f"SELECT * FROM v{k} WHERE ocd" for k in range(1, levels + 1)) + ")")
    return "WITH " + ", ".join(parts)


def results_sql(names: Sequence[str], comparability: bool = True) -> str:
    """kind, lhs, rhs over the tables of search_tables."""
    known = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    text = lambda c: f"array_to_string(list_transform({c}, lambda k: {known}[k]), ',')"
    return (
        f"SELECT 'OD' AS kind, {text('x')} AS lhs, {text('y')} AS rhs FROM found WHERE od_xy UNION ALL SELECT 'OD', {text('y')}, {text('x')} FROM found WHERE od_yx "
        f"UNION ALL SELECT 'OCD', {text('x')}, {text('y')} FROM found WHERE {'NOT od_xy AND NOT od_yx' if comparability else 'true'}"
    )


def lines_sql(names: Sequence[str]) -> str:
    """value: what result_lines prints."""
    return (
        "SELECT 'Constant columns: ' || coalesce((SELECT string_agg(name, ', ' ORDER BY i) FROM cols WHERE i NOT IN (SELECT i FROM varied)), '') AS value UNION ALL SELECT 'Order equivalent: ' "
        "UNION ALL SELECT a.name || ' ↔ ' || string_agg(b.name, ', ' ORDER BY b.i) FROM same, kept AS a, cols AS b WHERE same.first = a.i AND same.later = b.i GROUP BY a.name "
        f"UNION ALL SELECT kind || ': ' || replace(lhs, ',', ', ') || CASE kind WHEN 'OD' THEN ' ↦ ' ELSE ' ~ ' END || replace(rhs, ',', ', ') FROM ({results_sql(names)}) AS r"
    )


def counts_sql(names: Sequence[str]) -> str:
    """metric, value: the counts of results."""
    return (
        "SELECT 'CCs' AS metric, (SELECT count(*) FROM cols WHERE i NOT IN (SELECT i FROM varied)) AS value UNION ALL SELECT 'OECs', (SELECT count(*) FROM kept) "
        f"UNION ALL SELECT kind || 's', count(*) FROM ({results_sql(names)}) AS r GROUP BY kind"
    )


_TIME = r"\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
_MONTHS = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def kind_sql(v: str) -> str:
    """The type of a text: the highest one that it can be read as."""
    day = rf"regexp_extract({v}, '(\d{{1,2}} {_MONTHS} \d{{4}}) ', 1)"
    iso = f"try_cast(left({v}, 10) AS DATE) IS NOT NULL"
    clock = rf"try_cast(regexp_extract({v}, 'T(\d{{2}}:\d{{2}})', 1) || ':00' AS TIME) IS NOT NULL"
    return (
        f"CASE WHEN {v} IS NULL OR {v} = '' OR lower({v}) = 'null' OR {v} = '?' THEN 'null' "
        rf"WHEN regexp_full_match({v}, '\d{{4}}-\d{{2}}-\d{{2}}T{_TIME}(Z|[+-]\d{{2}}:\d{{2}}(:\d{{2}})?)(\[[A-Za-z0-9/_+-]+\])?') AND {iso} AND {clock} THEN 'zoned' "
        rf"WHEN regexp_full_match({v}, '((Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?\d{{1,2}} {_MONTHS} \d{{4}} \d{{2}}:\d{{2}}(:\d{{2}})? (GMT|[+-]\d{{4}})') AND try_strptime({day}, '%-d %b %Y') IS NOT NULL "
        f"AND (NOT contains({v}, ',') OR strftime(try_strptime({day}, '%-d %b %Y'), '%a') = left({v}, 3)) THEN 'zoned' "
        rf"WHEN regexp_full_match({v}, '\d{{4}}-\d{{2}}-\d{{2}}T{_TIME}') AND {iso} AND {clock} THEN 'datetime' "
        rf"WHEN regexp_full_match({v}, '\d{{2}}/\d{{2}}/\d{{4}}') AND try_strptime({v}, '%m/%d/%Y') IS NOT NULL THEN 'date' "
        rf"WHEN regexp_full_match({v}, '\d{{4}}-\d{{2}}-\d{{2}}(Z|[+-]\d{{2}}:\d{{2}})?') AND {iso} THEN 'date' "
        rf"WHEN regexp_full_match({v}, '[+-]?\d+') AND try_cast({v} AS BIGINT) IS NOT NULL THEN 'long' "
        rf"WHEN regexp_full_match({v}, '\S+') AND try_cast({v} AS DOUBLE) IS NOT NULL THEN 'double' ELSE 'string' END"
    )
