import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from monotrace.llm import alignment, best_fit, prefix_trie
from monotrace.llm.queries import ORACLES, QUERIES, tokenizer_path
from monotrace.llm.tokens import byte_letters

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
EMPTY = hashlib.sha256(b"").hexdigest()


# cross-tokenizer alignment


def plain_tokens(text):
    """Ids and byte strings of both files' tokens, by the libraries alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "files"):
        a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        a.encode_special_tokens = True
        plain_tokens.files = a, b, {c: k for k, c in byte_letters().items()}
    a, b, letters = plain_tokens.files
    got = a.encode(f" {text}", add_special_tokens=False)
    side_a = [(i, bytes(letters[c] for c in t)) for i, t in zip(got.ids, got.tokens, strict=True)]
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    return side_a, [(i, piece(b.id_to_piece(i))) for i in b.encode(text)]


def plain_alignment(text):
    """Groups, and links as pairs of ids, by comparing every token's range with the others'."""
    if not text:
        return None
    sides = plain_tokens(text)
    if any(b"".join(t for _, t in side) != f" {text}".encode() for side in sides):
        return None
    ranges = []
    for side in sides:
        at, own = 0, []
        for i, t in side:
            own.append((at, at + len(t), i))
            at += len(t)
        ranges.append(own)
    cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
    groups = [tuple([i for s, e, i in own if before <= s and e <= cut] for own in ranges) for before, cut in zip([0, *cuts], cuts, strict=False)]
    links, k = [], 0
    for s, e, i in ranges[0]:
        while k and ranges[1][k - 1][1] > s:
            k -= 1
        while k < len(ranges[1]) and ranges[1][k][0] < e:
            if ranges[1][k][1] > s:
                links.append((i, ranges[1][k][2]))
            k += 1
    return ranges, groups, links


def plain_rows(rows):
    """The whole report."""
    told = [(i, plain_alignment(t)) for i, t in rows]
    counts = Counter(pair for _, got in told if got for pair in set(got[2]))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = []
    for i, got in told:
        if not got:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        (side_a, side_b), groups, links = got
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, len(side_a), len(side_b), len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def short(rows):
    """Without the longest texts, on which comparing ranges takes long."""
    return [(i, t if t is None else t[:3000]) for i, t in rows]


def test_alignment_of_odd_texts(spark, odd_rows, empty):
    rows = short(odd_rows) + [(10_000 + k, t) for k, t in enumerate(["\n", "a\n\nb", " lead", "trail ", "two  spaces", "a \n b", "▁ mark", "<s> </s> <0x0A> <unk>", "\x00\r\n\t", "\U0001F600\U0001F600 กำ", "ﬁ ½ É", "é" * 9, "x" * 40 + " y", "<|endoftext|>"])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row long, pairs string").repartition(3)
    expected = sorted(plain_rows(rows), key=str)
    assert told(alignment.alignments(docs, A, B)) == expected
    # rarer pairs by shuffle: all of them, or those under the 40 most frequent
    assert told(alignment.alignments(docs, A, B, most=40)) == expected
    assert told(alignment.alignments(docs, A, B, most=0)) == expected
    assert told(alignment.alignments(empty, A, B)) == []


def test_alignment_of_documents(small_docs, small):
    some = small[::7]
    ids = {i for i, _ in some}
    got = [r for r in told(alignment.alignments(small_docs.where(small_docs.doc_id.isin(ids)), A, B))]
    assert got == sorted(plain_rows(some), key=str)


def test_long_texts_without_spaces_are_aligned():
    text = "ab" * 300_000
    got = alignment.aligned([text, "a"], A, B)
    assert got["n_a"][0] > 1000 and got["n_groups"][1] == 1
    assert got["n_links"][0] == got["n_a"][0] + got["n_b"][0] - got["n_groups"][0]


@pytest.mark.parametrize("n", [1, 62, 63, 64, 200])
def test_ranks_of_bits(n):
    rng = np.random.default_rng(n)
    places = np.unique(np.concatenate((rng.integers(1, n + 1, n), [n])))
    bits = alignment.Bits.of(places, n)
    assert bits.places().tolist() == places.tolist()
    assert bits.rank(np.arange(1, n + 2)).tolist() == [int((places < k).sum()) for k in range(1, n + 2)]


# best-fit packing


def words_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(words_ids, "file"):
        words_ids.file = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [*words_ids.file.encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(pieces, rows, width):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    expected = defaultdict(list)
    for i, text in rows:
        ids = words_ids(text)
        expected[i] += [(k, at, len(ids[at : at + width]), zlib.crc32(np.array(ids[at : at + width], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), width))]
    assert {i: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) for i, own in by_doc.items()} == {i: sorted(own) for i, own in expected.items()}
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= width
    return len(by_sequence)


def test_packing_of_odd_texts(odd, odd_rows, empty):
    path = tokenizer_path("word_bpe_49k.json")
    for options in ({}, {"width": 64, "group": 10, "fan_in": 2}, {"width": 64, "group": 7, "fan_in": 3, "slack": 0, "keep": 2}):
        check_packed(best_fit.pack_best_fit(odd, path, **options).collect(), odd_rows, options.get("width", 4096))
    assert best_fit.pack_best_fit(empty, path).count() == 0


def test_null_and_repeated_ids_are_packed_apart(spark):
    rows = [(None, "a b c"), (None, None), (4, "x " * 200), (4, "x " * 200), (4, "y")]
    check_packed(best_fit.pack_best_fit(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"), width=128).collect(), rows, 128)


def test_sequences_are_nearly_full(small_docs, small):
    path = tokenizer_path("word_bpe_49k.json")
    whole = best_fit.pack_best_fit(small_docs, path)
    check_packed(whole.collect(), small, 4096)
    for packed in (whole, best_fit.pack_best_fit(small_docs, path, group=40, fan_in=4)):
        got = best_fit.fill(packed).first()
        assert got["sequences"] <= 1.01 * got["least"] + 1


@pytest.mark.parametrize("seed", range(5))
def test_no_two_bins_fit_into_one_another(seed):
    lengths = np.random.default_rng(seed).integers(1, 101, 400)
    bins, offsets, used = best_fit.best_fit(lengths, 100)
    assert np.bincount(bins, lengths).tolist() == used.tolist() and used.max() <= 100
    two = np.sort(used)[:2]
    assert two.sum() > 100 and len(used) <= 11 / 9 * np.ceil(lengths.sum() / 100) + 1 + (lengths > 50).sum()
    for b in range(len(used)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == np.concatenate(([0], np.cumsum(lengths[own])[:-1])).tolist()


# conversation tries


def plain_trie(rows, swap=4, block=20):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], text))
    own = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % swap
        base = c - (c % block if c >= 0 else -(-c % block))
        whole = own.get(base, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole) == d))
    children, leaves, saved, out = defaultdict(list), {}, {}, []
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    for prefix in sorted(members, key=len, reverse=True):
        held, kids = members[prefix], children[prefix]
        leaves[prefix] = sum(leaves[k] for k in kids) or 1
        saved[prefix] = (len(held) - 1) * (len(WORDS.findall(prefix[-1][1])) if prefix else 0) + sum(saved[k] for k in kids)
        parent = min(c for c, _ in members[prefix[:-1]]) if prefix else None
        ends = ",".join(map(str, sorted(c for c, last in held if last)))
        out.append((min(c for c, _ in held), len(prefix), parent, len(held), len(kids), leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONVERSATIONS = "conv_id long, turn long, role string, text string, node string, first long, depth int"


def trie_rows(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=str)


def odd_conversations():
    seeded = random.Random(5)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, None, None), (7, 1, "", ""), (-7, 0, "user", "a b"), (0, 0, "user", "a b"), (0, 0, "user", "a b"), (20, 3, "user", "x" * 100_000), (33, 0, None, "\t\x0b w \n")]
    for c in range(40, 160):  # shared beginnings of many lengths, copies
        depth = seeded.randint(1, 9)
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"turn {seeded.randint(0, 1) if k > 2 else 0} {'w ' * k}") for k in range(depth)]
    rows += [(c, k, "user", f"same {k}") for c in range(200, 260) for k in range(6)]
    return rows


@pytest.mark.parametrize("most", [200_000, 6, 1])
def test_trie_of_odd_conversations(spark, most):
    rows = odd_conversations()
    given = [(*r, "n", 1, 2) for r in rows]
    random.Random(2).shuffle(given)
    got = prefix_trie.prefix_trie(spark.createDataFrame(given, CONVERSATIONS).repartition(3), most=most)
    assert trie_rows(got) == plain_trie(rows)


def test_trie_without_rows_and_of_one_conversation(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    # its own turns are all among those that give way, and there is nothing to take their place
    rows = [(c, 0, "user", "a") for c in (9,)]
    assert zlib.crc32(b"9") % 4 > 0
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame([(*r, "n", 1, 2) for r in rows], CONVERSATIONS))) == [(9, 0, None, 1, 0, 1, 0, hashlib.sha256(b"9").hexdigest())]


def test_trie_of_conversations(spark):
    rows = duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    assert trie_rows(QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.01")) == plain_trie(rows)


def test_trie_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    sql = con.sql(ORACLES["op13_prefix_trie"])
    at = [sql.columns.index(c) for c in TRIE]
    assert sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=str) == trie_rows(QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.001"))


def test_ends_come_in_blocks(spark):
    """A node with more ends than a block holds."""
    ends = spark.range(0, 250_000).selectExpr("CAST('n' AS binary) AS node", "id AS conv_id")
    assert [r["ends_sha256"] for r in prefix_trie.end_digests(ends).collect()] == [hashlib.sha256(",".join(map(str, range(250_000))).encode()).hexdigest()]
