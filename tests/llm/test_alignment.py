"""Cross-tokenizer alignment against both tokenizers over whole texts, its perfect hash, and both ways of looking up."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import token_align
from ledgerline.llm.tokens import tokenizer_path

from . import brute

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def expected(rows):
    told = brute.alignments(tokenizer_path(A), tokenizer_path(B), [r[1] for r in rows])
    count = Counter(pair for t in told for pair in t[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = Counter()
    for row, (x, y, groups, links) in zip(rows, told):
        best = sum(count[p] == most[p[1]] for p in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if x else ""
        out[row[0], len(x), len(y), len(links), len(links), best, sum(count[p] for p in links), groups, digest] += 1
    return out, count


@pytest.fixture(scope="module")
def wanted(rows):
    return expected(rows)


@pytest.mark.parametrize("lookup", [token_align.LOOKUP_BYTES, 0])
def test_alignments_match_whole_texts(spark, clashing, wanted, monkeypatch, lookup):
    monkeypatch.setattr(token_align, "BUCKET", 64)
    monkeypatch.setattr(token_align, "SHARE", 20)
    got = token_align.align_documents(spark, clashing, lookup_bytes=lookup)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")
    assert got.columns == list(names)
    assert Counter(tuple(r) for r in got.collect()) == wanted[0]


def test_pair_counts_match(spark, docs, wanted):
    scratch = token_align.Scratch(spark, "test")
    encoded = scratch.save(token_align.encode_documents(docs, A, B), "encoded")
    index = token_align.build_index(encoded, scratch, A, B)
    assert {(r.a, r.b): r.n for r in token_align.pair_counts(index).collect()} == dict(wanted[1])


@pytest.mark.parametrize("lookup", [token_align.LOOKUP_BYTES, 0])
def test_no_rows(spark, empty, lookup):
    assert token_align.align_documents(spark, empty, lookup_bytes=lookup).count() == 0
    void = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    got = token_align.align_documents(spark, void, lookup_bytes=lookup, with_groups=False).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(0, 0, 0, 0, 0, 0, "")] * 2


def ids(tokens, parts):
    return np.frombuffer(b"".join(parts), tokens.kind).tolist()


@pytest.mark.parametrize("ranks", [True, False])
def test_cuts_never_change_ids(monkeypatch, ranks):
    monkeypatch.setattr(token_align, "WINDOW", 7)
    tokens = token_align.Tokens(A, B)
    assert tokens.cuts and tokens.plain is not None
    if not ranks:
        tokens.plain = None
    rng = random.Random(5)
    some = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "the", "Ünï", "中文", "▁", "\u00a0", "\u00ad", "\u3000", "\u2028", "\x85", "'s", "'ll",
            "123", "!!", "<s>", "<0x0A>", "<|endoftext|>", "\U0001f600", "\x00", "é", ".", ",", "Hello", "\ufeff", "\u200b", "ﬁ", "½"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    told = brute.alignments(tokenizer_path(A), tokenizer_path(B), texts)
    for text, (of_a, of_b), (x, y, groups, links) in zip(texts, tokens.encode(texts), told):
        assert (ids(tokens, of_a), ids(tokens, of_b)) == (x, y), repr(text)
        alignment = tokens.align(of_a, of_b)
        assert ";".join(alignment.spelt()) == groups
        assert [(p >> 32, p & 0xFFFFFFFF) for p in alignment.pairs.tolist()] == links


def test_long_texts_in_parts(spark, monkeypatch):
    text = " ".join(f"word{k % 61}, Wört{k % 7}." for k in range(3000))
    tokens = token_align.Tokens(A, B)
    monkeypatch.setattr(token_align, "WINDOW", 500)
    (of_a, of_b), = tokens.encode([text])
    assert len(of_a) == len(of_b) > 50
    batch = pa.RecordBatch.from_arrays([pa.array([3]), pa.array([of_a]), pa.array([of_b]), pa.array([0])], names=["doc_id", "a", "b", "row"])
    (x, y, groups, links), = brute.alignments(tokenizer_path(A), tokenizer_path(B), [text])
    for size in (100, 1 << 19):
        monkeypatch.setattr(token_align, "TOKENS", size)
        row, = [r for out in token_align._align_documents(iter([batch]), A, B, None, True, True) for r in out.to_pylist()]
        assert (row["n_a"], row["n_b"], row["n_links"], row["groups"]) == (len(x), len(y), len(links), groups)
        assert row["groups_sha256"] == hashlib.sha256(groups.encode()).hexdigest() and sum(row["times"]) == len(links)


def test_cache_keeps_its_bound(monkeypatch):
    monkeypatch.setattr(token_align, "CACHE", 3)
    tokens = token_align.Tokens(A, B)
    for text in ("one two three four five six", "six five four seven", "one two eight"):
        (of_a, of_b), = tokens.encode([text])
        assert ids(tokens, of_b) == brute.alignments(tokenizer_path(A), tokenizer_path(B), [text])[0][1]
        assert len(tokens.known) <= 3


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_hash_is_minimal_and_perfect(n):
    pairs = np.unique(np.random.default_rng(n).integers(0, 1 << 47, n))
    levels, bits, placed = token_align.perfect_hash(pairs)
    assert sum(levels) == len(bits) and np.array_equal(np.sort(placed), pairs)
    index = token_align.Index([(levels, np.packbits(bits).tobytes(), placed.tobytes(), np.arange(len(placed)).tobytes())], {})
    counts, _ = index.counts(placed)
    assert np.array_equal(counts, np.arange(len(placed)))
    strange = np.setdiff1d(np.random.default_rng(7).integers(0, 1 << 47, 500), pairs)
    assert not index.counts(strange)[0].any()
