import functools
import zlib

import numpy as np
import pytest
from monotrace.llm import packing, pfor
from monotrace.llm.queries import tokenizer_path


@functools.cache
def whole_tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def whole_ids(name: str, text: str, end: int) -> np.ndarray:
    return np.array([*whole_tokenizer(name).encode(text, add_special_tokens=False).ids, end], "<u4")


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def check_pieces(pieces, rows, width=1024):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids, at = whole_ids("byte_bpe_50k.json", text or "", 0), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    last = None
    for _, parts in sorted(by_sequence.items()):
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            assert last is None or (r["doc_id"], r["start"]) > last  # the order of documents is kept
            last, at = (r["doc_id"], r["start"]), at + r["length"]
        assert at <= width


def test_pieces_of_odd_texts(odd, odd_rows, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    check_pieces(packing.pack_documents(odd, path).collect(), odd_rows)
    check_pieces(packing.pack_documents(odd, path, segment=2000).collect(), odd_rows)
    assert packing.pack_documents(empty, path).count() == 0


def test_pieces_of_documents(small_docs, small):
    pieces = packing.pack_documents(small_docs, tokenizer_path("byte_bpe_50k.json"))
    check_pieces(pieces.collect(), small)
    total = packing.padding(pieces).first()
    assert total["padding"] < 0.02 * total["ids"]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_have_the_least_cost(seed):
    rng = np.random.default_rng(seed)
    places = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 40))))
    penalties = rng.choice([0.0, 1.0, 3.0], len(places))
    penalties[0] = 0
    width, exact = 20, (8,)
    cost = [0.0] + [np.inf] * (len(places) - 1)
    price = lambda n, j: (0 if n in exact else width - n) + penalties[j]
    for j in range(1, len(places)):
        cost[j] = min(cost[i] + price(places[j] - places[i], j) for i in range(j) if places[j] - places[i] <= width)
    cuts = packing.plan_cuts(places, penalties, width, exact)
    at = {p: k for k, p in enumerate(places.tolist())}
    assert sum(price(b - a, at[b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)) == pytest.approx(cost[-1])


def test_lengths_without_padding():
    """Every power of two is known: documents of such lengths need no more than a sequence each."""
    ends = np.cumsum([256, 1024, 64, 512, 1])
    places = np.unique(np.concatenate(([0], ends, np.arange(0, ends[-1], 32))))
    penalties = np.where(np.isin(places, ends), 0.0, 3.0)
    exact = tuple(1 << k for k in range(10))
    assert packing.plan_cuts(places, penalties, 1024, exact) == [0, *ends.tolist()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_texts(name):
    from monotrace.llm.tokens import word_ids

    for text in ("one <|endoftext|> two", "<|startoftext|>x", "a<|ENDOFTEXT|>b <|endoftext|", "two  spaces <|endoftext|>\n\n<|endoftext|>end"):
        ids = whole_tokenizer(name).encode(text, add_special_tokens=False).ids
        assert word_ids(tokenizer_path(name)).encode(text) == np.array(ids, "<u4").tobytes()
    assert 50256 in whole_tokenizer("byte_bpe_50k.json").encode("one <|endoftext|> two", add_special_tokens=False).ids


def test_files_round_trip(spark, odd, odd_rows, empty, tmp_path):
    pfor.write_ids(odd, tokenizer_path("word_bpe_49k.json"), str(tmp_path / "ids"), segment=3000)
    got = pfor.digest(pfor.read_ids(spark, str(tmp_path / "ids"))).collect()
    at = 0
    for r, (i, text) in zip(sorted(got, key=lambda r: r["start"]), odd_rows, strict=True):
        ids = whole_ids("word_bpe_49k.json", text or "", 1)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), crc(ids))
        at += len(ids)
    pfor.write_ids(empty, tokenizer_path("word_bpe_49k.json"), str(tmp_path / "none"))
    assert pfor.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_token_files_of_documents(spark, small):
    from monotrace.llm.queries import op2_token_files

    at = 0
    for r, (i, text) in zip(sorted(op2_token_files(spark, "/root/testdata/sf0.01").collect(), key=lambda r: r["doc_id"]), small, strict=True):
        ids = whole_ids("word_bpe_49k.json", text, 1)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), crc(ids))
        at += len(ids)


def test_segments():
    rng = np.random.default_rng(5)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = rng.integers(0, 50, n).astype(np.uint32)
        ids[rng.random(n) < 0.05] += np.uint32(2**31)
        lengths = np.array([n // 2, n - n // 2], np.uint32)
        data = pfor.encode_segment([5, None], lengths, ids)
        docs, got_lengths, got = pfor.decode_segment(data)
        assert docs == [5, None] and got_lengths.tolist() == lengths.tolist() and got.tolist() == ids.tolist()
        if n == 5000:
            assert len(data) < 2 * n
            with pytest.raises(ValueError):
                pfor.decode_segment(data[:-9] + b"X" + data[-8:])


@pytest.mark.parametrize("width", range(1, 33))
def test_packed_bits_are_the_low_bits_in_order(width):
    values = np.random.default_rng(width).integers(0, 2**32, (3, 128), dtype=np.uint64).astype(np.uint32)
    low = values & np.uint32((1 << width) - 1)
    plain = [sum(int(v) << (k * width) for k, v in enumerate(row)).to_bytes(16 * width, "little") for row in low]
    packed = pfor.pack_bits(values, width)
    assert [row.tobytes() for row in packed] == plain
    assert (pfor.unpack_bits(packed, width) == low).all()
