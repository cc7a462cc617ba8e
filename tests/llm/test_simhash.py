import random

import numpy as np
import pytest
import xxhash
from monotrace.llm import simhash
from monotrace.llm.components import components, thinned
from monotrace.llm.queries import op10_simhash


def plain_fingerprint(text: str, shingle: int) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_wide(text: str, shingle: int) -> int:
    """The three further words of a wide fingerprint, bit by bit."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))] if words else []
    out = 0
    for k, factor in enumerate(simhash.FACTORS):
        other = [h * factor % 2**64 for h in hashes]
        other = [(h ^ h >> 32) * factor % 2**64 for h in other]
        other = [h ^ h >> 29 for h in other]
        out |= sum(1 << 64 * k + b for b in range(64) if 2 * sum(h >> b & 1 for h in other) > len(other))
    return out


def plain_groups(fps: dict[int, int], most: int) -> dict[int, int]:
    """Components of all pairs within `most` bits, whatever the length of the fingerprints."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_query_against_every_pair(spark, small):
    fps = {i: plain_fingerprint(t, 4) for i, t in small}
    expected = {i: (f"{fps[i]:016x}", c) for i, c in plain_groups(fps, 4).items()}
    got = op10_simhash(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(small)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == expected
    assert len(set(c for _, c in expected.values())) < len(small)


def test_odd_texts(odd, odd_rows, empty):
    fps = {i: plain_fingerprint(t or "", 5) for i, t in odd_rows}
    wides = {i: plain_wide(t or "", 5) for i, t in odd_rows}
    groups = plain_groups({i: fps[i] | wides[i] << 64 for i in fps}, simhash.NEAR_WIDE_BITS)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_groups(odd).collect()}
    assert got == {i: (fps[i], c) for i, c in groups.items()}
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))


@pytest.mark.parametrize(("most", "aim", "block"), [(4, 4, 8), (3, 16, 2048), (9, 8, 16), (0, 2, 3)])
def test_links_of_dense_clusters(spark, monkeypatch, most, aim, block):
    """Fingerprints around a few centres and at every distance, over many blocks."""
    monkeypatch.setattr(simhash, "AIM", aim)
    monkeypatch.setattr(simhash, "BLOCK", block)
    seeded = random.Random(most)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        centre = seeded.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in seeded.sample(range(64), seeded.randint(0, 8))))
    rows = {k * 10: fp for k, fp in enumerate(sorted(fps))}
    table = spark.createDataFrame([(int(np.uint64(fp).view(np.int64)), i) for i, fp in rows.items()], "fp long, id long").repartition(5)
    links = [(r["a"], r["b"]) for r in simhash.near_links(table, most).collect()]
    assert all((rows[a] ^ rows[b]).bit_count() <= most for a, b in links)
    root = {i: i for i in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert {i: top(i) for i in rows} == plain_groups(rows, most)


def test_components(spark):
    seeded = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(seeded.randint(200, 260), seeded.randint(200, 260)) for _ in range(50)] + [(7, 7), (None, 3), (150, 149), (149, 150)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    reach = {x: {x} for p in links for x in p if x is not None}
    for a, b in links * 2:
        if a is not None and reach[a] is not reach[b]:
            both = reach[a] | reach[b]
            for x in both:
                reach[x] = both
    assert got == {x: min(r) for x, r in reach.items() if min(r) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("share", [7, 100_000])
def test_thinned_links_connect_the_same(spark, share):
    seeded = random.Random(share)
    links = [(a, b) for _ in range(900) for a, b in [(seeded.randint(0, 60), seeded.randint(0, 60))]] + [(seeded.randint(100, 400), seeded.randint(100, 400)) for _ in range(150)]
    table = spark.createDataFrame(links, "a long, b long").repartition(6)
    fewer = [tuple(r) for r in thinned(table, share).collect()]
    assert set(fewer) <= set(links) and (share == 7 or len(fewer) < len({x for p in links for x in p}))
    roots = lambda t: {r["vertex"]: r["root"] for r in components(t).collect()}
    assert roots(spark.createDataFrame(fewer, "a long, b long")) == roots(table)
    assert thinned(table.limit(0)).count() == 0


def test_rows_without_id_do_not_connect(spark):
    rows = [(None, "alone here in a text"), (None, "shared words of this one text"), (4, "shared words of this one text"), (4, "shared words of this one text")]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_wide_fingerprints_link_as_every_pair_does(spark, monkeypatch):
    """Pairs of at most 46 of 256 bits, however the bits are dealt over the four words."""
    monkeypatch.setattr(simhash, "AIM_WIDE", 8, raising=False)
    seeded = random.Random(5)
    rows = []
    for _ in range(40):
        centre = seeded.getrandbits(256)
        rows.append(centre)
        for first in (0, 11, 12, 20, 46):
            total = seeded.choice((44, 46, 47))
            flips = seeded.sample(range(64), min(first, total)) + seeded.sample(range(64, 256), total - min(first, total))
            rows.append(centre ^ sum(1 << b for b in flips))
    table = [(int(np.uint64(x % 2**64).view(np.int64)), (x >> 64).to_bytes(24, "little"), i) for i, x in enumerate(rows)]
    links = simhash.near_links(spark.createDataFrame(table, "fp long, wide binary, id long").repartition(5), simhash.NEAR_BITS, simhash.NEAR_WIDE_BITS)
    got = {(r["a"], r["b"]) for r in links.collect()}
    assert all((rows[a] ^ rows[b]).bit_count() <= 46 for a, b in got)
    expected = plain_groups(dict(enumerate(rows)), 46)
    assert any(((rows[i] ^ rows[j]) % 2**64).bit_count() > 11 for i, j in expected.items())
    roots = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(sorted(got), "a long, b long")).collect()}
    assert {i: roots.get(i, i) for i in range(len(rows))} == expected


def test_links_within_one_dense_block(spark, monkeypatch):
    """Many texts around one centre, compared a few at a time: a few links connect them all."""
    monkeypatch.setattr(simhash, "ROOM", 50)
    seeded = random.Random(8)
    fps = sorted({seeded.getrandbits(64) & 0xFF0F0000000F00FF for _ in range(700)})
    table = spark.createDataFrame([(int(np.uint64(fp).view(np.int64)), i) for i, fp in enumerate(fps)], "fp long, id long").repartition(3)
    links = [(r["a"], r["b"]) for r in simhash.near_links(table, 6).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 6 for a, b in links) and len(links) < 5 * len(fps)
    roots = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {i: roots.get(i, i) for i in range(len(fps))} == plain_groups(dict(enumerate(fps)), 6)


def test_equal_first_words_alone_do_not_link(spark):
    table = [(5, bytes(24), 1), (5, b"\xff" * 24, 2)]
    assert simhash.near_links(spark.createDataFrame(table, "fp long, wide binary, id long"), simhash.NEAR_BITS, simhash.NEAR_WIDE_BITS).count() == 0


def test_rows_that_share_a_doc_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{k * k % 97}" for k in range(80)) for x in "ab")
    rows = [(1, b, 1), (5, a, 2), (5, b, 3), (5, a, 4), (None, b, 5), (None, b, 6), (7, b + " more", 7), (8, None, 8), (8, "", 9), (9, " ", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own long").repartition(3)
    got = sorted(r["own"] for r in simhash.first_of_each(docs).collect())
    # (5, b) and 7 are near copies of 1; of (5, a), and of the empty texts, one row stays
    assert len(got) == 5 and got[0] == 1 and got[1] in (2, 4) and got[2:4] == [5, 6] and got[4] in (8, 9)
    assert simhash.first_of_each(docs).columns == docs.columns
