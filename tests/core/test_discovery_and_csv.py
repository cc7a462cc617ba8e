import csv
import os
import random
import shutil
import subprocess
import sys
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest
from monotrace import cli, discover, metrics, read_csv, result_lines, search
from monotrace.functions.inference import inferred, parsed, type_name
from monotrace.plans import discovery
from monotrace.plans.verdicts import Checker
from monotrace.queries import ORACLES, QUERIES, view
from monotrace.sources.csv import find_delimiter, find_quote, from_texts, infer_types, lost_values, synthetic_names
from monotrace.sources.records import after_line, lines_of, open_splits
from pyspark.sql import functions as F

# The nine rows of the end-to-end fixture, and what texts of every type look like.
FIXTURE = [
    (1, 2, 1, 2, 1, 0), (1, 2, 2, 3, 2, 0), (1, 2, 3, 4, 3, 0), (2, 3, 4, 5, 4, 0), (2, 3, 6, 5, 4, 0),
    (3, 4, 5, 5, 4, 0), (3, 4, 6, 5, 4, 0), (4, 8, 7, 8, 5, 0), (5, 8, 7, 9, 6, 0),
]
TYPED_TEXTS = {
    "3.25": "double", "7.": "double", ".5": "double", "4096": "long", "9223372036854775807": "long", "000457": "long", "2021-03-04T05:06:07+01:00": "zoned",
    "Sat, 13 Mar 2021 09:45:10 GMT": "zoned", "4 Jul 2022 18:00:00 GMT": "zoned", "2020-02-29T23:59:59": "datetime", "2020-02-29": "date", "2020-02-29+01:00": "date",
    "11/05/2004": "date", "grey heron": "string", "Friday, 2004/11/05": "string", "null": "null", "": "null", "?": "null", "NULL": "null", "2020-02-29 23:59:59": "string",
}

# What the nine-row fixture holds.
ODS = "A>B BD>A AC>D DB>A DA>B CA>D BCD>A AC>BD AC>DB ABC>D BAC>D BCA>D CBA>D".split()
OCDS = "A~D B~D C~D A~BC AB~D BA~D BC~D CB~D AD~BC BC~DA".split()


@pytest.fixture
def fixture_file(tmp_path):
    path = tmp_path / "table.csv"
    path.write_text("\n".join(";".join(map(str, r)) for r in FIXTURE))
    return str(path)


def test_end_to_end(spark, fixture_file, tmp_path):
    df = read_csv(spark, fixture_file)
    assert df.columns == list("ABCDEF") and {f.dataType.simpleString() for f in df.schema} == {"bigint"}
    found = discover(df)
    assert found.constants == ["F"] and found.reduced == ["A", "B", "C", "D"]
    assert {r: m for r, m in found.classes.items() if len(m) > 1} == {"D": ["D", "E"]}
    rows = {(r["kind"], "".join(r["lhs"]), "".join(r["rhs"])) for r in found.results.collect()}
    assert rows == {("OD", *x.split(">")) for x in ODS} | {("OCD", *x.split("~")) for x in OCDS}
    assert found.levels == [(1, 6, 4), (2, 14, 10), (3, 13, 9)] or [n for _, n, _ in found.levels] == [6, 14, 13]
    lines = {r["value"] for r in result_lines(spark, found).collect()}
    assert {"Constant columns: F", "D ↔ E", "OD: A, C ↦ B, D", "OCD: B, C ~ D, A"} <= lines and len(lines) == 26
    counts = {r["metric"]: r["value"] for r in metrics(spark, found).collect()}
    assert (counts["CCs"], counts["OECs"], counts["OECs of two or more"], counts["ODs"], counts["OCDs"], counts["candidates"]) == (1, 4, 1, 13, 10, 33)
    every = search(df, found.reduced, comparability=False)
    assert every.where("kind = 'OCD'").count() == 23 and every.where("kind = 'OD'").count() == 13


def test_command_line(spark, fixture_file, tmp_path, capsys):
    session = type(spark).stop
    try:
        type(spark).stop = lambda self: None
        cli.main(["--input", fixture_file, "--output", str(tmp_path / "out"), "--max-level", "1", "--output-to-console"])
    finally:
        type(spark).stop = session
    printed = capsys.readouterr().out.splitlines()
    assert "MetricType,Metric,Description,Value" in printed and {"OD: A ↦ B", "Constant columns: F"} <= set(printed)
    assert sum(line.startswith("Result,") for line in printed) == 6 and sum(line.startswith("Timing,") for line in printed) == 5
    assert "OD: A ↦ B" in {r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()}


def test_few_columns_and_rows(spark):
    one = spark.createDataFrame([(1,), (2,)], "a long")
    assert discover(one).results.count() == 0 and discover(one).reduced == ["a"]
    none = spark.createDataFrame([], "a long, b long")
    assert discover(none).classes == {"a": ["a", "b"]}
    odd = spark.createDataFrame([(1, [1])], "a long, b array<int>")
    assert discover(odd).constants == ["a"]


def test_a_search_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(FIXTURE, "A long, B long, C long, D long, E long, F long")
    whole, state = discover(df), str(tmp_path / "search")
    discover(df, max_level=2, state=state)
    asked = []
    seen = Checker.verdicts
    monkeypatch.setattr(Checker, "verdicts", lambda self, candidates: asked.append(1) or seen(self, candidates))
    monkeypatch.setattr(discovery, "_reduced", lambda *a: pytest.fail("classes are looked for again"))
    found = discover(df, state=state)
    assert len(asked) == 1 and found.levels == whole.levels and found.counts == whole.counts == {"OD": 13, "OCD": 10}
    text = lambda d: sorted(map(str, d.results.collect()))
    assert text(found) == text(whole)
    # a level whose writing did not end is written anew
    (tmp_path / "search" / "level-3.json").unlink()
    assert text(discover(df, state=state)) == text(whole) and len(asked) == 2
    with pytest.raises(ValueError):
        discover(df, ["A", "B", "C"], state=state)


@pytest.mark.parametrize("name", ["lineitem", "orders_cal"])
def test_ranks_on_the_cluster_find_the_same(spark, name):
    df = view(spark, "/root/testdata/sf0.001", name)
    if name == "orders_cal":
        df = df.select("od", "y", "q", "ym", "d", "one")
    by_codes, in_memory = discover(df, most_ranks=0), discover(df)
    assert (by_codes.constants, by_codes.classes, by_codes.levels, by_codes.counts) == (in_memory.constants, in_memory.classes, in_memory.levels, in_memory.counts)
    assert sorted(map(str, by_codes.results.collect())) == sorted(map(str, in_memory.results.collect()))


def test_types_of_values(spark):
    df = spark.createDataFrame([(v, k) for v, k in TYPED_TEXTS.items()], "v string, k string")
    wrong = df.select("v", "k", type_name(inferred(F.col("v"))["rank"]).alias("got")).where("got <> k").collect()
    assert not wrong


def test_times_without_seconds(spark):
    got = spark.createDataFrame([("2021-03-04T05:06Z",), ("2021-03-04T05:06+01:00[Europe/Berlin]",), ("2021-03-04T05:06",)], "v string").select(type_name(inferred(F.col("v"))["rank"]).alias("kind"), parsed(F.col("v"), "zoned", "iso_zoned").alias("t"))
    assert [tuple(r) for r in got.collect()] == [("zoned", datetime(2021, 3, 4, 5, 6)), ("zoned", datetime(2021, 3, 4, 4, 6)), ("datetime", None)]


def quoted_rows():
    seeded = random.Random(6)
    field = lambda: "".join(seeded.choice(["a", "bc", " ", ",", "\n", '"', "\n\n", "é", "q5"]) for _ in range(seeded.randint(0, 6))).strip()
    return [(k, field() or None, f"w{k}\nz") for k in range(3000)]


@pytest.mark.parametrize("size", [700, 5_000, 1 << 20])
def test_quoted_line_feeds_in_many_splits(spark, tmp_path, size):
    """Rows cross splits; the rows are those of a reader that sees the files whole."""
    rows = quoted_rows()
    for n in range(2):
        with open(tmp_path / f"{n}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(["k", "v", "w"])
            out.writerows([(k, "" if v is None else v, w) for k, v, w in rows[n::2]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        df = read_csv(spark, str(tmp_path), header=True)
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > (50 if size == 700 else 1)
    assert [r[0] for r in got] == [r[0] for r in rows] and [r[2] for r in got] == [r[2] for r in rows]
    assert all((g[1] or None) == (v if v is None or v.lower() not in ("null", "?") else None) for g, (_, v, _) in zip(got, rows, strict=True))


@pytest.mark.parametrize(("line", "inside", "after"), [
    ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('a, "b', False, True), ('5" pipe,b', False, False), ('a"b,"c', False, True), ('"a""b', False, True), ('"a""",b', False, False),
    ('b",c', True, False), ('b",  "c', True, True), ('""', False, False), ('"', True, False), ('"a"b","c', False, True), ('x","y', True, True), ('', True, True), ('"a,""b"', False, False),
])
def test_state_after_a_line(line, inside, after):
    assert after_line(line, inside, ",", '"') is after


def test_a_stray_quote_opens_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('size,n\n5" pipe,1\n6 pipe,2\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), header=True).collect()] == [('5" pipe', 1), ("6 pipe", 2)]
    found, inside = open_splits(lines_of(spark, str(tmp_path / "a.csv")), ",", '"')
    assert not found and inside.count() == 0


def test_columns_take_the_highest_type(spark):
    df = from_texts(spark, {"n": ["1", "x", None], "d": ["5", "2011-12-03", "01/28/1997"], "s": ["a", "?", "b"], "z": ["Tue, 3 Jun 2008 11:05:30 GMT", "Mon, 3 Jun 2008 11:05:30 GMT", None], "e": ["", "null", "?"]})
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "date", "string", "timestamp", "string"]
    assert [tuple(r)[:3] for r in df.collect()] == [(1, None, "a"), (None, date(2011, 12, 3), None), (None, None, "b")]
    assert [r["z"] for r in df.collect()] == [datetime(2008, 6, 3, 11, 5, 30), None, None]
    texts = spark.createDataFrame([(0, "1", "a"), (1, "x", "b")], "_idx long, n string, s string")
    types = infer_types(texts, ["n", "s"])
    assert {r["column"]: r["lost"] for r in lost_values(texts, types).collect()} == {"n": 1, "s": 0}


def test_csv_forms(spark, tmp_path):
    (tmp_path / "h.csv").write_text("name,when\nx,2011-12-03T10:15:30\n\"y, z\",\nlast\n")
    df = read_csv(spark, str(tmp_path / "h.csv"), header=True)
    assert df.columns == ["name", "when"] and [tuple(r) for r in df.collect()] == [("x", datetime(2011, 12, 3, 10, 15, 30)), ("y, z", None), ("last", None)]
    (tmp_path / "q.csv").write_text("a;'b;\n c';1\n'x';'y';2\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "q.csv")).collect()] == [("a", "b;\n c", 1), ("x", "y", 2)]
    assert find_quote(["'a',b,'c d'"], ",") == "'" and find_quote(["a,b"], ",") == '"'
    late = tmp_path / "l.csv"
    late.write_text("\n".join(["1"] * 5 + ["x"]))
    assert [r[0] for r in read_csv(spark, str(late), infer_rows=3).collect()] == [1] * 5 + [None]
    with pytest.raises(ValueError):
        read_csv(spark, str(late), infer_rows=0)
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "e.csv"))
    assert synthetic_names(28)[-3:] == ["Z", "AA", "AB"]
    assert [find_delimiter([f"a{d}b{d}c", f"1{d}2{d}3"]) for d in ",;\t|"] == [",", ";", "\t", "|"] and find_delimiter(["abc"]) == ","


@pytest.mark.parametrize("name", ["od_check_date_year", "holds_list_to_list", "discover_order_tier", "discover_whole_customer", "csv_supplier", "csv_order_notes", "csv_events", "value_types_orders", "row_positions_lineitem", "lost_values_mixed", "sorted_with_indices_nation", "metrics_counts", "pair_verdicts_orders", "ordered_indices_orders", "distinct_profile_events", "equiv_classes_customer"])
def test_queries_against_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, sql = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=str)


def test_every_query_has_sql_and_every_view_reads(spark):
    assert set(QUERIES) == set(ORACLES)
    for name in ("orders_cal", "line_pricing", "event_hour"):
        assert view(spark, "/root/testdata/sf0.001", name).limit(1).count() == 1


def test_the_library_does_without_the_training_data_part(tmp_path):
    """A copy of the repository without that subpackage imports, and registers all other queries."""
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "monotrace", tmp_path / "monotrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert told[-3:] == [str(len(QUERIES)), str(len(ORACLES)), "False"]


def test_whole_search_of_a_view_against_brute_force(spark, tmp_path):
    """All levels over all columns; constants and later members of a class are put aside."""
    import __spark_entry__

    duckdb.sql("SELECT * FROM '/root/testdata/sf0.001/orders.parquet' ORDER BY o_orderkey LIMIT 60").write_parquet(str(tmp_path / "orders.parquet"))
    df = view(spark, str(tmp_path), "orders_cal")
    columns, table = df.columns, [tuple(r) for r in df.collect()]

    def orders(x, y):
        pick = lambda r, cols: tuple(r[columns.index(c)] for c in cols)
        pairs = sorted((pick(r, x), pick(r, y)) for r in table)
        return all(b[1] == a[1] or (a[0] < b[0] and a[1] < b[1]) for a, b in zip(pairs, pairs[1:], strict=False))

    left = [c for c in columns if len({r[columns.index(c)] for r in table}) > 1]
    left = [c for i, c in enumerate(left) if not any(orders([c], [k]) and orders([k], [c]) for k in left[:i])]
    assert 3 < len(left) < len(columns)
    todo = {((a,), (b,)) for i, a in enumerate(left) for b in left[i + 1 :]}
    expected = set()
    while todo:
        longer = set()
        for x, y in todo:
            if not orders([*x, *y], [*y, *x]):
                continue
            xy, yx = orders(x, y), orders(y, x)
            expected |= {("OD", x, y)} if xy else set()
            expected |= {("OD", y, x)} if yx else set()
            expected |= {("OCD", x, y)} if not xy and not yx else set()
            rest = [c for c in left if c not in x + y]
            longer |= set() if xy else {((*x, c), y) for c in rest}
            longer |= set() if yx else {(x, (*y, c)) for c in rest}
        todo = longer
    assert max(len(x) + len(y) for _, x, y in expected) > 3
    assert {(r["kind"], tuple(r["lhs"].split(",")), tuple(r["rhs"].split(","))) for r in QUERIES["discover_whole_orders_cal"](spark, str(tmp_path)).collect()} == expected
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["level1_candidates_orders_cal", "level2_candidates_orders_cal", "mirrored_candidates_orders_cal", "pair_verdicts_fixture", "metrics_counts_orders_cal", "discover_orders_cal", "discover_whole_orders_cal", "result_lines_orders_cal", "reduced_columns_fixture", "equiv_classes_fixture", "discover_fixture", "discover_fixture_all_ocds"])
def test_orders_that_repeat_do_not_reach_the_driver(spark, tmp_path, monkeypatch, name):
    """Thirty orders a thousand times over: the driver collects thirty rows at most, and finds what one of each shows."""
    from monotrace.plans import verdicts

    for copies in (1, 1_000):
        (tmp_path / str(copies)).mkdir()
        one = "SELECT * FROM '/root/testdata/sf0.001/orders.parquet' ORDER BY o_orderkey LIMIT 30"
        duckdb.sql(f"SELECT o.* REPLACE (o_orderkey + 1500 * i AS o_orderkey) FROM ({one}) AS o, range({copies}) AS c(i)").write_parquet(str(tmp_path / str(copies) / "orders.parquet"))
    expected = sorted(map(tuple, QUERIES[name](spark, str(tmp_path / "1")).collect()))
    collected, encode = [], verdicts.encode
    monkeypatch.setattr(verdicts, "encode", lambda rows, columns: collected.append(rows.count()) or encode(rows, columns))
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path / "1000")).collect())) == expected
    assert collected and max(collected) <= 30
