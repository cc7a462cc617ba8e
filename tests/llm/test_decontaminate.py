import math
import random

import pytest
from monotrace.llm import decontaminate as dc

ITEMS = "item_id long, text string, doc_id long, score double"


def plain_matches(docs, items, threshold=0.6, least_overlap=0.5):
    """Every passage against every item, without an index."""
    items = [(i, t) for i, t in items if dc.words_of(t or "")]
    split = {i: dc.question_and_answer(t) for i, t in items}
    words = {i: q + a for i, (q, a) in split.items()}
    if not words:
        return {}
    df = {w: sum(w in ws for ws in words.values()) for ws in words.values() for w in ws}
    mean = sum(map(len, words.values())) / len(words)

    def weights(ws):
        out = {}
        for w in ws:
            f = ws.count(w)
            out[w] = math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        return out

    known = {i: weights(ws) for i, ws in words.items()}
    best = {}
    for doc, text in docs:
        own = dc.words_of(text or "")
        for i, w in known.items():
            step = 16
            while step < len(words[i]):
                step *= 2
            for start in range(0, max(1, len(own)), step):
                passage = own[start : start + 2 * step]
                held = set(passage)
                score = sum(x for k, x in w.items() if k in held) / sum(w.values())
                q, a = (dc.overlap(part, passage) for part in split[i])
                if score >= threshold - 1e-9 and q >= least_overlap and a >= least_overlap:
                    best[doc, i] = max(best.get((doc, i), (0,)), (score, q, a))
    return best


def as_dict(found):
    rows = found.collect()
    assert len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)
    return {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in rows}


def same(got, expected):
    assert set(got) == set(expected)
    for k, v in got.items():
        assert v == pytest.approx(expected[k], abs=1e-9)


def test_query_finds_every_planted_item(spark, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    from monotrace.llm.queries import op3_decontaminate

    got = as_dict(op3_decontaminate(spark, "/root/testdata/sf0.01"))
    joined = {i: " " + " ".join(dc.words_of(t)) + " " for i, t in items}
    for doc, text in small:
        flat = " " + " ".join(dc.words_of(text)) + " "
        for i, t in joined.items():
            assert (t in flat) == ((doc, i) in got)


def texts_and_items():
    seeded = random.Random(11)
    vocabulary = ["the", "of", "a"] * 6 + [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(seeded.choice(vocabulary) for _ in range(n))
    items = [(k, f"{say(seeded.randint(3, 20))}. {say(seeded.randint(1, 6))}.") for k in range(70)] + [(100, None), (101, ""), (102, "lone"), (103, "the of the"), (104, "the of the"), (105, " ?! ")]
    docs = [(0, None), (1, ""), (2, "lone"), (3, say(400)), (4, say(3000))]
    for k in range(60):
        item = items[k][1].split()
        cut = seeded.randint(max(1, len(item) - 4), len(item))
        docs.append((10 + k, f"{say(seeded.randint(0, 60))} {' '.join(item[:cut]).upper()}\n{say(seeded.randint(0, 60))}"))
    return docs, items


@pytest.mark.parametrize("bytes_of_index", [4 << 20, 300])
def test_index_against_every_pair(spark, monkeypatch, bytes_of_index):
    monkeypatch.setattr(dc, "INDEX_BYTES", bytes_of_index)
    docs, items = texts_and_items()
    table = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, score double").repartition(3)
    tests = spark.createDataFrame([(*x, 1, 1.0) for x in items], ITEMS)
    expected = plain_matches(docs, items)
    got = as_dict(dc.matches(table, tests))
    assert len(got) > 20
    same(got, expected)
    clean = dc.clean_documents(table, tests)
    assert clean.columns == table.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_odd_and_empty_tables(spark, odd, odd_rows, empty):
    items = [(1, odd_rows[11][1]), (2, "secret ABCDEFGHIJKLMNOP0123"), (3, None)]
    tests = spark.createDataFrame([(*x, 1, 1.0) for x in items], ITEMS)
    same(as_dict(dc.matches(odd, tests)), plain_matches(odd_rows, items))
    assert dc.matches(empty, tests).count() == 0
    assert dc.matches(odd, tests.limit(0)).count() == 0
    assert dc.clean_documents(odd, tests.limit(0)).count() == odd.count()


def test_rows_without_doc_id_go_by_their_text(spark):
    items = spark.createDataFrame([(1, "which river is the longest of all these. it is the amber one.")], "item_id long, text string")
    held = "a start Which river is the longest of all these? It is the amber one, they say"
    docs = spark.createDataFrame([(None, held, 1), (None, "clean words only here", 2), (0, "clean as well", 3), (4, held, 4), (None, None, 5)], "doc_id long, text string, n int")
    assert sorted(r["n"] for r in dc.clean_documents(docs, items).collect()) == [2, 3, 5]
    assert sorted((r["doc_id"] or -1) for r in dc.matches(docs, items).collect()) == [-1, 4]


def test_a_long_item_changes_nothing_for_others(spark):
    """A question and, far from it, its answer are no match, whatever other items there are."""
    seeded = random.Random(4)
    say = lambda n, letter: " ".join(f"{letter}{seeded.randint(0, 400)}" for _ in range(n))
    question, answer = "which old river crosses the amber valley before the seven stone bridges", "it is the quiet silver river of the north"
    apart = f"{question} {say(150, 'w')} {answer} {say(60, 'w')}"
    docs = spark.createDataFrame([(1, apart), (2, f"{say(30, 'w')} {question}? {answer} {say(30, 'w')}")], "doc_id long, text string")
    short, long = (1, f"{question}? {answer}."), (2, f"{say(400, 'v')}. {say(12, 'v')}.")
    pairs = lambda items: {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert pairs([short]) == pairs([short, long]) == {(2, 1)}
