import math
from collections import Counter

import duckdb
import pytest
from monotrace.llm import backoff


def plain(rows, order):
    texts = [(i, backoff.words_of(t or "")) for i, t in rows]
    counts = Counter()
    own = []
    for _, ws in texts:
        c = Counter(tuple(ws[k : k + n]) for n in range(1, order + 1) for k in range(len(ws) - n + 1))
        c[()] = len(ws)
        own.append(c)
        counts += c
    for (i, ws), c in zip(texts, own, strict=True):
        other = lambda g: counts[g] - c[g]  # noqa: B023, E731
        every, total = max(other(()), 1), 0.0
        for k in range(len(ws)):
            longest = min(order, k + 1)
            for n in range(longest, 0, -1):
                gram = tuple(ws[k - n + 1 : k + 1])
                if other(gram) or n == 1:
                    score = other(gram) / other(gram[:-1]) if n > 1 else (other(gram) or 0.4) / every
                    total += math.log(score * 0.4 ** (longest - n))
                    break
        yield i, len(ws), total


def check(got, rows, order=3, digits=None):
    expected = sorted(plain(rows, order), key=str)
    got = sorted(((r["doc_id"], r["n_tokens"], r["log_score"]) for r in got), key=str)
    assert len(got) == len(expected)
    for g, e in zip(sorted(got), sorted(expected), strict=True):
        assert g[:2] == e[:2] and g[2] == pytest.approx(e[2], rel=1e-9, abs=1e-4 if digits else 1e-9)


def test_query_against_plain_counts_and_sql(spark, small):
    from monotrace.llm.queries import ORACLES, op8_stupid_backoff

    got = op8_stupid_backoff(spark, "/root/testdata/sf0.01").collect()
    check(got, small, digits=4)
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    sql = con.sql(ORACLES["op8_stupid_backoff"])
    assert sorted(sql.columns) == sorted(got[0].asDict())
    assert sorted(sql.fetchall()) == sorted(tuple(r[c] for c in sql.columns) for r in got)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_many_bundles_and_parts(odd, odd_rows, order):
    check(backoff.backoff_scores(odd, order=order, bundle_bytes=20_000, part_ngrams=300).collect(), odd_rows, order)


def test_more_parts_than_ngrams_make_no_more_rows_than_these(spark):
    rows = [(k, f"a b c {k}") for k in range(5)]
    check(backoff.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), bundle_bytes=8, part_ngrams=1).collect(), rows)


def test_few_rows(spark, empty):
    assert backoff.backoff_scores(empty).count() == 0
    lone = spark.createDataFrame([(None, "one two three four")], "doc_id long, text string")
    assert backoff.backoff_scores(lone).first()["log_score"] == pytest.approx(backoff.floor_of_log(4))
