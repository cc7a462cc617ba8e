import math
import random
from datetime import date, datetime
from decimal import Decimal
from itertools import combinations, permutations

import pytest
from monotrace import check_constant, check_equivalent, check_ocd, check_od, column_profile, constant_columns, od_violations, ordered_indices, ordered_indices_by, sorted_column, sorted_with_indices
from monotrace.operators.checks import _holds, pair_verdicts
from monotrace.operators.ordering import sorted_with_positions, with_positions
from monotrace.plans.verdicts import Checker
from monotrace.operators.candidates import expanded, first_candidates, mirrored, named


def key(v):
    """Nulls first, NaN last, texts by bytes, timestamps by second."""
    if v is None:
        return (0,)
    if isinstance(v, float) and math.isnan(v):
        return (2,)
    if isinstance(v, datetime):
        return (1, v.replace(microsecond=0))
    return (1, v.encode() if isinstance(v, str) else v)


def orders(rows, x, y) -> bool:
    """The definition: no two rows with s[X] <= t[X] and s[Y] > t[Y]."""
    side = lambda r, cols: [key(r[c]) for c in cols]
    return all(side(s, y) <= side(t, y) for s in rows for t in rows if side(s, x) <= side(t, x))


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_constants(spark):
    df = table(spark, "a long, b long, c double, d string, e string, f long, g timestamp, h timestamp", [(i, 1, 1e-9 * i, "a", None, None if i else 1, datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 0, 0, i)) for i in range(5)])
    assert {r["column"] for r in constant_columns(df).collect()} == {"b", "d", "e", "g"}
    assert {r["column"] for r in column_profile(df).where("is_constant").collect()} == {"b", "d", "e", "g"}
    assert not check_constant(df.limit(0), "b") and check_constant(df, "b")


def test_equivalence(spark):
    schema = "c1 string, c2 long, c3 double, c4 string"
    df = table(spark, schema, [("D", 11, 4.11, "x"), ("A", 5, 1.5, "a"), ("B", 8, 2.8, "c"), ("Z", 24, 5.24, "d"), ("C", 10, 3.1, "a")])
    assert check_equivalent(df, "c1", "c2") and check_equivalent(df, "c1", "c3") and not check_equivalent(df, "c1", "c4")
    ties = table(spark, schema, [("C", 10, 4.11, "x"), ("A", 5, 1.5, "a"), ("B", 8, 2.8, "c"), ("Z", 24, 5.24, "d"), ("C", 11, 3.1, "a")])
    assert not any(check_equivalent(ties, a, b) for a, b in combinations(ties.columns, 2))


@pytest.mark.parametrize(
    ("schema", "rows", "yes", "no"),
    [
        ("a string, b double, c long", [("C", 1.1, 80), ("A", 0.2, 20), ("C", 3.01, 105), ("Z", 23.1, 294), ("C", 2.24, 102)], ["b a", "b c", "c b"], ["a b", "a c"]),
        ("a string, b double, c long", [("B", 1.1, 80), ("A", 0.2, 20), ("C", 23.1, 294), ("C", 23.1, 294), ("C", 3.02, 102)], ["a,b c", "c a", "c,b a", "b a", "b c"], ["a c"]),
        ("a double, b string, c long", [(1.1, "C", 801), (0.2, "A", 120), (1.3, "E", 105), (23.1, "Z", 294), (1.2, "E", 102)], ["a b", "a b,c"], ["a c"]),
        ("a string, b long, c long", [("A", 0, 0), ("A", 1, 4), ("A", 4, 1)], [], ["b a,c"]),
        ("a string, b long", [("A", 0), ("A", 1), ("A", 4)], [], ["a b", "a a,b"]),
    ],
)
def test_dependencies(spark, schema, rows, yes, no):
    df = table(spark, schema, rows).repartition(3)
    for holds, cases in ((True, yes), (False, no)):
        for case in cases:
            x, y = (side.split(",") for side in case.split(" "))
            assert check_od(df, x, y) is holds
            counts = od_violations(df, x, y).first()
            assert (counts["splits"] + counts["swaps"] == 0) is holds


def random_rows(seed):
    seeded = random.Random(seed)
    n = seeded.randint(2, 9)
    value = lambda k: seeded.choice([None, *range(k)])
    return [(value(3), seeded.choice([None, "a", "é", "z", "𝒳"]), seeded.choice([None, math.nan, -0.0, 0.0, 1.5]), datetime(2021, 5, 1, 0, 0, seeded.randint(0, 2), seeded.randint(0, 1))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_every_way_of_checking_meets_the_definition(spark, seed):
    rows = random_rows(seed)
    df = table(spark, "a long, b string, c double, d timestamp", rows).repartition(2)
    names, ids = list(df.columns), {c: i for i, c in enumerate(df.columns)}
    lists = [(list(p[:k]), list(p[k:])) for n in (2, 3) for p in permutations(names, n) for k in range(1, n)]
    expected = {(tuple(x), tuple(y)): (orders(as_dicts(rows, names), [*x, *y], [*y, *x]), orders(as_dicts(rows, names), x, y), orders(as_dicts(rows, names), y, x)) for x, y in lists}
    cands = spark.createDataFrame([([ids[c] for c in x], [ids[c] for c in y]) for x, y in lists], "x array<int>, y array<int>")
    got = {(tuple(names[i] for i in r["x"]), tuple(names[i] for i in r["y"])): (r["ocd"], r["od_xy"], r["od_yx"]) for r in Checker(df, names).verdicts(cands).collect()}
    # where the order compatibility fails, no dependency is looked for
    assert got == {k: v if v[0] else (False, False, False) for k, v in expected.items()}
    for x, y in random.Random(seed).sample(lists, 4):
        assert (check_ocd(df, x, y), check_od(df, x, y)) == expected[tuple(x), tuple(y)][:2]
    pairs = {(r["a"], r["b"]): (r["ocd"], r["od_ab"], r["od_ba"]) for r in pair_verdicts(df, names).collect()}
    assert pairs == {k: got[(k[0],), (k[1],)] for k in pairs} and len(pairs) == 6


def as_dicts(rows, names):
    return [dict(zip(names, r, strict=True)) for r in rows]


def test_tables_beyond_the_broadcast(spark):
    """Ranks made on the cluster give the verdicts of ranks in memory, on lists of every length."""
    df = spark.range(400).selectExpr("id AS a", "id div 10 AS b", "CASE WHEN id % 7 > 0 THEN concat('k', 1000 + id div 40) END AS c", "CAST(id div 5 AS double) / 3 AS d", "date_add(DATE'2020-01-01', CAST(id AS int)) AS e", "-id AS f").repartition(3)
    names = df.columns
    lists = [(list(p[:k]), list(p[k:])) for n in (2, 3, 4) for p in permutations(range(6), n) for k in range(1, n)]
    cands = spark.createDataFrame(random.Random(3).sample(lists, 150), "x array<int>, y array<int>")
    checker = Checker(df, names, most_ranks=0)
    assert not checker.whole
    every = lambda c: sorted(str((r["x"], r["y"], r["ocd"], r["od_xy"], r["od_yx"])) for r in c.verdicts(cands).collect())
    assert every(checker) == every(Checker(df, names))
    asked, sorts = checker.codes.sorts[-1]
    assert 0 < sorts < asked
    assert checker.equivalence_classes() == Checker(df, names).equivalence_classes() == {0: [0, 4], 1: [1], 2: [2], 3: [3], 5: [5]}


def test_ranks_on_the_cluster(spark, monkeypatch):
    from monotrace.operators import codes

    rows = [(None, "b", 1.5), (3, "a", math.nan), (3, None, -0.0), (-7, "é", 0.0), (10**15, "a", None)]
    df = table(spark, "a long, b string, c double", rows).repartition(4)
    for given in (codes.GIVEN_VALUES, 0):  # dictionaries given to every task, and joined by shuffle
        monkeypatch.setattr(codes, "GIVEN_VALUES", given)
        got = codes.Codes(df, df.columns)
        assert got.counts == [4, 4, 4]
        assert sorted(map(tuple, got.table.collect())) == sorted([(0, 2, 2), (2, 1, 3), (2, 0, 1), (1, 3, 1), (3, 1, 0)])
    # lists with more values than one number holds
    monkeypatch.setattr(codes, "WIDEST", 5)
    told = {(tuple(r["x"]), tuple(r["y"])): (r["ocd"], r["od_xy"], r["od_yx"]) for r in got.verdicts([((0, 1), (2,)), ((0,), (1, 2)), ((2, 0), (1,)), ((0,), (1,))]).collect()}
    small = Checker(df, df.columns)
    expected = {(tuple(r["x"]), tuple(r["y"])): (r["ocd"], r["od_xy"], r["od_yx"]) for r in small.verdicts(spark.createDataFrame([(list(x), list(y)) for x, y in told], "x array<int>, y array<int>")).collect()}
    assert told == expected
    empty = codes.Codes(df.limit(0), df.columns)
    assert [tuple(r)[2:] for r in empty.verdicts([((0,), (1,))]).collect()] == [(True, True, True)]
    assert empty.equivalent([[0, 1, 2]]) == [[0, 1, 2]]


def test_equal_digests_are_verified(spark, monkeypatch):
    """Columns whose digests collide are told apart all the same."""
    from monotrace.operators.codes import Codes
    from pyspark.sql import functions as F

    df = spark.range(50).selectExpr("id AS a", "2 * id AS b", "-id AS c", "-3 * id AS d").repartition(3)
    codes = Codes(df, df.columns)
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(1).cast("long"))
    first = sorted(codes.equivalent([[0, 1, 2, 3]]))
    assert first == [[0, 1], [2, 3]]


def test_edges(spark):
    df = table(spark, "a long, b array<long>", [(1, [1])])
    for bad in ([], ["b"], ["nope"]):
        with pytest.raises(ValueError):
            check_od(df, bad, ["a"])
    two = table(spark, "a long, b long", [(1, 2)])
    assert check_od(two, ["a"], ["b"]) and check_od(two.limit(0), ["a"], ["b"]) and check_equivalent(two.limit(0), "a", "b")


def test_orders(spark):
    rows = [("C", 8, "e"), ("A", 20, "d"), ("C", 5, "b"), ("Z", 24, "c"), ("C", 5, "a")]
    df = table(spark, "a string, b long, c string, i long", [(*r, i) for i, r in enumerate(rows)]).repartition(3)
    at = lambda found: [r["index"] for r in sorted(found.collect(), key=lambda r: r["position"])]
    assert at(ordered_indices(df, ["a", "b", "c"], "i")) == [1, 4, 2, 0, 3]
    assert at(ordered_indices(df, ["a"], "i")) == [1, 0, 2, 4, 3]
    assert at(ordered_indices_by(df, [1, 2], "i")) == [4, 2, 0, 1, 3]
    assert ordered_indices(df, [], "i").count() == 0
    with pytest.raises(ValueError):
        ordered_indices_by(df, [0, 7], "i")
    assert [tuple(r) for r in sorted_with_indices(df, "b", "i").collect()] == [(5, 2), (5, 4), (8, 0), (20, 1), (24, 3)]
    assert [r["b"] for r in sorted_column(df, "b").collect()] == [5, 5, 8, 20, 24]


def test_rows_with_null_and_repeated_indices(spark):
    df = table(spark, "v string, i long", [("b", 1), ("a", 1), ("c", None), (None, 2), ("a", 1)]).repartition(3)
    got = sorted(tuple(r) for r in sorted_with_positions(df, "v", "i").collect())
    assert got == [(0, None, 2), (1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "c", None)]


def test_positions_of_rows_in_files(spark, tmp_path):
    """Files of many splits, rows without a key."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    sizes, at = [1000, 0, 1, 2500], 0
    for n, size in enumerate(sizes):
        pq.write_table(pa.table({"v": pa.array([(k * 7919) % 50 for k in range(at, at + size)], pa.int64()), "k": pa.array(range(at, at + size), pa.int64())}), tmp_path / f"part-{n}.parquet", row_group_size=100)
        at += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = with_positions(spark.read.parquet(str(tmp_path)))
        assert spark.read.parquet(str(tmp_path)).rdd.getNumPartitions() > 4
        assert rows.where("position = k").count() == rows.count() == sum(sizes)
        order = [r["index"] for r in sorted(ordered_indices(rows, ["v"], "position").collect(), key=lambda r: r["position"])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert order == sorted(range(sum(sizes)), key=lambda k: ((k * 7919) % 50, k))


def test_candidates(spark):
    first = first_candidates(spark, [0, 1, 2])
    flat = lambda df: sorted((tuple(r["x"]), tuple(r["y"])) for r in df.collect())
    assert flat(first) == [((0,), (1,)), ((0,), (2,)), ((1,), (2,))]
    assert flat(expanded(first, [0, 1, 2], left=True)) == [((0, 1), (2,)), ((0, 2), (1,)), ((1, 0), (2,))]
    assert flat(mirrored(first)) == [((1,), (0,)), ((2,), (0,)), ((2,), (1,))]
    assert named(first.limit(1), ["A", "B", "C"]).first().asDict() == {"lhs": ["A"], "rhs": ["B"]}


def test_checks_end_at_the_first_violation(spark):
    """A violation that a sample misses: later ranges are not begun."""
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = {}
        # the first rows, which are the sample, order well; the violation is in the first range, or nowhere, or only where two ranges meet
        rows = spark.range(0, 200_000, numPartitions=8).selectExpr("id + 1000 AS a", "(id + 1000) * 2 AS b")
        for name, more, holds in (("none", [], True), ("early", [(5, 9), (6, 8)], False), ("split", [(5, 9), (5, 10)], False)):
            df = rows.unionByName(spark.createDataFrame(more, "a long, b long")) if more else rows
            sc.setJobGroup(name, name)
            assert check_od(df, ["a"], ["b"]) == holds
            jobs = [j for g in tracker.getJobIdsForGroup(name) if (j := tracker.getJobInfo(g))]
            # the last stage of each job is its own, earlier ones make what it reads
            tasks[name] = sum(s.numCompletedTasks for j in jobs if (s := tracker.getStageInfo(max(j.stageIds))))
        assert tasks["early"] < tasks["none"] - 30 and tasks["split"] < tasks["none"] - 30
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("longest", [4096, 0])
def test_ranges_that_meet(spark, longest):
    """Every kind of value, by many small ranges, borders compared by the driver and on the cluster, against the definition."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rng = random.Random(3)
        schema = "a double, b string, c timestamp, d boolean, e decimal(9,2), f date, g long"
        for turn in range(3):
            rows = []
            for i in range(12):
                v = rng.choice([None, i, i, i]) if turn % 2 else i
                rows.append({
                    "a": float("nan") if i > 9 and v is not None else v if v is None else float(v), "b": None if v is None else chr(200 + 9 * v) * rng.choice([1, 1, 2]), "c": None if v is None else datetime(2020, 1, 1, 0, 0, v // 2, i),
                    "d": None if v is None else v > rng.choice([4, 5, 6]), "e": None if v is None else Decimal(v // 3), "f": None if v is None else date(1969, 12, 20 + v), "g": rng.choice([i, i, 3]),
                })
            df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
            plain = [{k: v if not isinstance(v, date) or isinstance(v, datetime) else v.toordinal() for k, v in r.items()} for r in rows]
            for x, y in rng.sample([*permutations([[c] for c in "abcdefg"], 2), (["a", "b"], ["f", "c"]), (["f"], ["d", "e"])], 4):
                assert _holds(df, x, y, True, longest) == orders(plain, x, y), (x, y, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_profile_reads_once_a_kind(spark):
    """Every kind of value side by side: values are counted within their own column, at full precision, and the table is scanned once a kind."""
    rows = [(1, 1.0, "1", True, Decimal("1.00"), Decimal("1.000"), date(1970, 1, 2), datetime(2020, 1, 1, 0, 0, 0, 1), None), (1, -0.0, "", False, Decimal("1.00"), None, date(1970, 1, 2), datetime(2020, 1, 1, 0, 0, 0, 2), None),
            (None, 0.0, None, None, Decimal("2.00"), None, None, datetime(2020, 1, 1, 0, 0, 0, 2), None), (None, float("nan"), "1", None, None, None, None, None, None)]
    df = table(spark, "a int, b double, c string, d boolean, e decimal(9,2), f decimal(9,3), g date, h timestamp, i void", rows).selectExpr("*", "a AS `a.b`")
    expected = {"a": 2, "b": 3, "c": 3, "d": 3, "e": 3, "f": 2, "g": 2, "h": 3, "i": 1, "a.b": 2}
    got = column_profile(df)
    assert {r["column"]: r["n_distinct"] for r in got.collect()} == expected and {r["n_rows"] for r in got.collect()} == {4}
    assert {r["column"] for r in got.where("is_constant").collect()} == {"i"}
    assert {(r["n_rows"], r["n_distinct"], r["is_constant"]) for r in column_profile(df.limit(0).drop("i")).collect()} == {(0, 0, False)}
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    # eleven columns: whole numbers, broken ones, texts, times without a zone
    assert column_profile(lines)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 4


def test_close_rows_refute(spark, monkeypatch):
    """Neighbours that stand the wrong way round everywhere, which a sample of distant rows does not show, are found among rows close in order, before any check over all rows."""
    from monotrace.operators import ranks
    from monotrace.plans import verdicts

    monkeypatch.setattr(ranks, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(verdicts, "SAMPLE_ROWS", 40)
    df = spark.range(20_000).selectExpr("id AS a", "id + 2 * (id % 2) AS b", "cast(id AS double) AS c", "id div 5000 AS d", "cast(null AS int) AS e")
    checker = Checker(df, df.columns, most_ranks=0)
    got = {(*r["x"], *r["y"]): (r["ocd"], r["od_xy"], r["od_yx"]) for r in checker.verdicts(first_candidates(spark, range(5))).collect()}
    assert got[0, 1] == got[1, 2] == (False, False, False) and got[0, 2] == (True, True, True) and got[0, 3] == (True, True, False)
    # a and b, b and c: left by the sample, refuted by close rows
    asked, by_sample, by_close = checker.left[0]
    assert asked == 10 and by_close <= by_sample - 2 and checker.codes.sorts[0][0] == by_close
    assert Checker(df.limit(0), df.columns, most_ranks=0).verdicts(first_candidates(spark, range(5))).where("ocd").count() == 10


def test_rows_that_repeat_are_checked_once(spark):
    """A table of any length with few distinct rows is checked as these, in memory; times within a second are one row."""
    few = "id % 40 AS a, CASE WHEN id % 40 > 3 THEN (id % 40) div 4 END AS b, concat('k', 100 + id % 40) AS `c.d`, timestamp_micros(1000000 * (id % 40) + id % 7) AS e, -((id % 40) div 3) AS f"
    df, short = spark.range(30_000).selectExpr(f"inline(array(struct({few})))"), spark.range(40).selectExpr(f"inline(array(struct({few})))")
    checker, plain = Checker(df, df.columns, most_ranks=1_000), Checker(short, short.columns)
    assert checker.whole and checker.rows == 40
    every = lambda c: sorted(str((r["x"], r["y"], r["ocd"], r["od_xy"], r["od_yx"])) for r in c.verdicts(first_candidates(spark, range(5))).collect())
    assert every(checker) == every(plain) and checker.equivalence_classes() == plain.equivalence_classes() == {0: [0, 2, 3], 1: [1], 4: [4]}


@pytest.mark.parametrize(("distinct", "most_ranks"), [(40, 16_000_000), (40, 0), (21_000, 16_000_000)])
def test_driver_gets_distinct_rows_alone(spark, monkeypatch, distinct, most_ranks):
    """What the driver collects of a table whose rows repeat are its distinct rows, however often they repeat: all of them, or a sample."""
    from monotrace.plans import verdicts

    collected, encode = [], verdicts.encode
    monkeypatch.setattr(verdicts, "encode", lambda rows, columns: collected.append((rows.count(), rows.distinct().count())) or encode(rows, columns))
    times = max(3, 30_000 // distinct)
    df = spark.range(times * distinct).selectExpr(f"id div {times} AS a", f"id div {4 * times} AS b")
    checker = Checker(df, df.columns, most_ranks=most_ranks)
    assert checker.rows == distinct and collected == [(min(distinct, verdicts.SAMPLE_ROWS),) * 2]
    assert [tuple(r)[2:] for r in checker.verdicts(first_candidates(spark, range(2))).collect()] == [(True, True, False)]


def test_whole_numbers_of_many_values_are_their_own_ranks(spark, monkeypatch):
    """They are not shuffled into dictionaries, and verdicts and classes are those of dense ranks in memory; times without a zone keep their order where clocks go back."""
    from monotrace.operators import codes

    df = spark.range(600).selectExpr(
        "id * 5 - 700 AS a", "CASE WHEN id > 4 THEN date_add(DATE'1965-01-01', CAST(id AS int)) END AS b", "timestamp_seconds(1729990000 + 60 * id) AS c", "CAST(timestamp_seconds(1729990000 + 60 * id) AS timestamp_ntz) AS d", "CAST(id AS double) AS e", "id div 50 AS f", "600 - id AS g"
    ).repartition(3)
    lists = [(list(p[:k]), list(p[k:])) for n in (2, 3) for p in permutations(range(7), n) for k in range(1, n)]
    cands = spark.createDataFrame(random.Random(5).sample(lists, 120), "x array<int>, y array<int>")
    every = lambda c: sorted(str((r["x"], r["y"], r["ocd"], r["od_xy"], r["od_yx"])) for r in c.verdicts(cands).collect())
    plain, made, stored = Checker(df, df.columns), [], codes.stored
    monkeypatch.setattr(codes, "DENSE_VALUES", 100)
    monkeypatch.setattr(codes, "stored", lambda rows, name: made.append((name, rows.count())) or stored(rows, name))
    checker = Checker(df, df.columns, most_ranks=0)
    assert every(checker) == every(plain) and checker.codes.spread == {0, 1, 2, 3, 6}
    assert sum(n for name, n in made if name == "ranges") < 700
    assert sorted(checker.codes.equivalent([[0, 1, 2, 3, 4, 5, 6]])) == [[0, 2, 3, 4]] and plain.equivalence_classes()[0] == [0, 2, 3, 4]
