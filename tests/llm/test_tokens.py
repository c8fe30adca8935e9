from __future__ import annotations

import base64
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from floatq.llm.bpe_codec import ByteBpe, bpe_round_trip
from floatq.llm.packing import GAP, best_fit, configurations, cover, filled, knapsack, pack, rounded, token_pieces
from floatq.llm.token_counts import WordBpe, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, length string, ids string"


def texts():
    rng = random.Random(1)
    alphabet = "aAbBthe \n\t    'sS,.!12é\u0301Σσ漢字\x1c\x85İ ẞ🙂\r\u2003\u00a0|<>"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(800)]
    return out + ["", " ", "  ", " a ", "a  b", "x\n \nb", "a\n b", "it's 'S", "a" * 4000, "ab" * 3000, "<|endoftext|>x<|startoftext|>", "<|endoftext|", "ΑΣ ΑΣΑ", "word " * 20_000]


def test_word_bpe_equals_the_library():
    tokenizer = Tokenizer.from_file(WORDS)
    want = [e.ids for e in tokenizer.encode_batch(texts(), add_special_tokens=False)]
    bpe = WordBpe(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts())] == want
    assert bpe.counts(texts()).tolist() == [len(x) for x in want]


def test_byte_bpe_equals_the_library_and_decodes():
    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = ByteBpe(BYTES, public_tokenizers.PATTERN)
    for text, ids in zip(texts(), codec.encode(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_token_queries_on_odd_rows(spark):
    rows = [(1, "a b", "", ""), (1, "a b", "", ""), (None, None, None, None), (2, "", "", ""), (3, "long " * 3000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in token_counts(df, WORDS, 2048).collect()]
    assert sorted(got, key=str) == sorted([(1, 3, 2, False), (1, 3, 2, False), (None, 0, 0, False), (2, 0, 0, False), (3, 15000, 3000, True)], key=str)
    coded = {(r.doc_id, bytes(r.decoded)) for r in bpe_round_trip(df, BYTES, public_tokenizers.PATTERN).collect()}
    assert coded == {(1, b"a b"), (None, b""), (2, b""), (3, b"long " * 3000)}
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts(empty, WORDS, 1).collect() == [] == bpe_round_trip(empty, BYTES, public_tokenizers.PATTERN).collect()


def test_packing_places_every_piece_without_gaps(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["tree", "of", "house"], k=rng.choice([3, 40, 700, 1500, 5000]))), "x", "y") for i in range(60)] + [(70, None, None, None), (71, "", "", ""), (1, "tree", "", ""), (1, "tree", "", ""), (None, "of", "", "")]
    pieces = token_pieces(spark.createDataFrame(rows, SCHEMA), WORDS, 2048)
    got = pack(pieces, 2048).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids)))) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert upto <= 2048
    hist = np.bincount([r.length for r in got], minlength=2049)
    assert len(sequences) <= sum(n for _, n in best_fit(hist, 2048, []))
    assert pack(pieces.where("doc_id < 0"), 2048).collect() == []
    with pytest.raises(ValueError, match="length"):
        pack(pieces, 100)


def test_configurations_hold_the_histogram():
    rng = np.random.default_rng(3)
    for n, m in ((5, 1), (300, 1), (2000, 50)):
        hist = np.bincount(rng.integers(1, 65, n), minlength=65) * m
        chosen = configurations(hist, 64)
        used = np.zeros(65, np.int64)
        for lengths, count in chosen:
            assert count > 0 and sum(k * v for k, v in lengths.items()) <= 64
            for k, v in lengths.items():
                used[k] += v * count
        assert (used == hist).all()
        assert sum(c for _, c in chosen) <= sum(c for _, c in best_fit(hist, 64, []))


def test_program_covers_to_a_stated_gap_and_places_most_tokens():
    """The fractional solution covers every length, its value is near the dual bound, and best fit only gets what rounding leaves."""
    rng = np.random.default_rng(4)
    sizes = np.arange(65)
    hist = np.bincount(rng.integers(5, 40, 30_000), minlength=65)
    found = cover(hist, 64)
    covered = np.zeros(65)
    for key, amount in found.amounts.items():
        assert sum(k * m for k, m in key) <= 64
        for k, m in key:
            covered[k] += m * amount
    assert (covered >= hist * (1 - 1e-9)).all() and abs(sum(found.amounts.values()) - found.value) < 1e-6 * found.value
    assert -(-int(hist @ sizes) // 64) <= found.bound + 1 and found.bound <= found.value <= (1 + GAP) * found.bound
    whole = rounded(found.amounts, hist)
    placed = sum(n * sum(k * m for k, m in lengths.items()) for lengths, n in whole)
    assert placed >= 0.9 * (hist @ sizes)
    assert found.bound - 1 <= sum(n for _, n in configurations(hist, 64)) <= (1 + GAP) * found.bound + 1


def test_configurations_without_exact_fills():
    """No multiset of these lengths sums to 2048; the program's optimum is 9000 sequences, best fit makes 11000."""
    hist = np.zeros(2049, np.int64)
    hist[[1030, 523, 517, 500]] = [6000, 6000, 6000, 12000]
    chosen = configurations(hist, 2048)
    used = np.zeros(2049, np.int64)
    for lengths, count in chosen:
        assert sum(k * v for k, v in lengths.items()) <= 2048
        for k, v in lengths.items():
            used[k] += v * count
    assert (used == hist).all()
    assert sum(c for _, c in chosen) == 9000
    found = cover(hist, 2048)
    assert 8800 <= found.bound <= 9000 + 1e-6 and found.value <= (1 + GAP) * found.bound


def test_knapsack_is_best():
    price = np.zeros(21)
    price[[3, 7, 11]] = [3.1, 8, 11.5]
    best = max(a * 3.1 + b * 8 + c * 11.5 for a in range(7) for b in range(3) for c in range(2) if 3 * a + 7 * b + 11 * c <= 20)
    found, took = knapsack(price, 20)
    assert abs(found[20] - best) < 1e-9 and abs(sum(price[k] * m for k, m in filled(took, 17, 3).items()) - 3.1 - found[17]) < 1e-9


def test_packing_of_odd_rows(spark):
    """Equal lengths in number, repeated rows, null ids, and columns named like its own."""
    rows = [(i % 7 if i % 11 else None, i % 3, 5 + i % 2, f"b{i}", i, "n", "r") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, bucket string, rank long, nth string, key string")
    got = pack(df.union(df.limit(30)), 64).collect()
    assert len(got) == 1530 and all(r.bucket == f"b{r.rank}" and (r.nth, r.key) == ("n", "r") for r in got)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and p[-1][0] + p[-1][1] <= 64


def test_unbroken_pre_tokens_of_any_length():
    """By rounds, by a heap, and by the library; very long ones in time."""
    tokenizer, words, rng = Tokenizer.from_file(WORDS), WordBpe(WORDS), random.Random(7)
    texts = ["".join(rng.choices(letters, k=n)) for n in (3, 200, 3000, 9000) for letters in ("a", "ab", "etaoin", "acgt", "äßé")]
    for t, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    for t in texts:
        rounds, size = words.merge_rounds([t.encode()])
        assert rounds.tolist() == words.merge_long(t.encode()).tolist() and size.tolist() == [len(rounds)]
    began = time.perf_counter()
    assert words.counts(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)) + " b", None, "c"])[1:].tolist() == [0, 1]
    assert time.perf_counter() - began < 20
