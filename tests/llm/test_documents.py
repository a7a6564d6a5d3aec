"""The document operators against brute force, on the small table and odd rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import langid, license_scan, mixing, ngram_join, packing, sharding, suffix_dedup, token_files
from ledgerline.llm.common import Scratch
from ledgerline.llm.huffman import STRIDE, Codebook, code_lengths
from ledgerline.llm.tokens import tokenizer_path

from . import brute

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def key(v):
    return (v is not None, v if v is not None else 0)


# Token files


def written(spark, df):
    target = Scratch(spark, "test-op1").root
    token_files.write_token_files(spark, df, target, path=WORDS, end=2)
    return token_files.read_token_files(spark, target)


@pytest.mark.parametrize("block", [1 << 16, 700])
def test_token_files_round_trip(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", block)
    monkeypatch.setattr(token_files, "SHARD_BYTES", 100_000)
    got = token_files.token_digests(written(spark, docs)).collect()
    want = sorted(((key(r[0]), brute.crc(i), len(i)) for r, i in zip(rows, brute.tokens(WORDS, [r[1] for r in rows], 2))))
    assert len(got) == len(rows)
    at = 0
    order = sorted(got, key=lambda r: r.start)
    assert [key(r.doc_id) for r in order] == [w[0] for w in want]
    for r in order:
        assert r.start == at
        at += r.n_tokens
    assert sorted((key(r.doc_id), r.ids_crc32, r.n_tokens) for r in got) == want


def test_token_files_empty_and_extra_columns(spark, docs, clashing, empty):
    assert token_files.token_digests(written(spark, empty)).count() == 0
    a = {tuple(r) for r in token_files.token_digests(written(spark, clashing)).collect()}
    assert a == {tuple(r) for r in token_files.token_digests(written(spark, docs)).collect()}


def test_crc_join():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc" * 70, b"defg" * 1000)):
        assert token_files.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("counts", [[1], [0, 5, 0], [1, 1, 1], [2**k for k in range(30)], list(range(1, 3000)), [0, 10**12, 1, 1, 7]])
def test_huffman_is_prefix_free_limited_and_round_trips(counts):
    counts = np.array(counts, np.int64)
    lengths = code_lengths(counts)
    used = lengths[lengths > 0].astype(int)
    assert used.max() <= 18 and len(used) == (counts > 0).sum()
    assert sum(2.0 ** -used) <= 1
    book = Codebook(lengths)
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 3 * STRIDE + 5)
    payload, bits, marks = book.encode(ids)
    assert bits == lengths[ids].astype(int).sum()
    assert (book.decode(payload, len(ids), marks) == ids).all()
    assert len(book.decode(b"", 0, np.empty(0, np.int64))) == 0


def test_huffman_lengths_are_optimal_without_pressure():
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 200)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert (code_lengths(counts).astype(int) * counts).sum() == cost


# N-gram join


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_ngram_join_matches_all_pairs(spark, docs, rows, width, percent):
    sizes, root = brute.jaccard_groups([r[1] for r in rows], width, percent)
    groups = brute.grouped((root[k], rows[k][0]) for k in range(len(rows)))
    smallest = {g: min((v for v in ids if v is not None), default=None) for g, ids in groups.items()}
    want = Counter((rows[k][0], sizes[k], smallest[root[k]] if sizes[k] else rows[k][0]) for k in range(len(rows)))
    got = ngram_join.link_documents(spark, docs, width=width, percent=percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


@pytest.mark.parametrize("boundary", [1, 2, 3])
def test_ngram_join_on_small_sets_and_every_boundary(spark, boundary, monkeypatch):
    rng = np.random.default_rng(boundary)
    texts = []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 50, rng.integers(1, 60))]
        texts.append(" ".join(base))
        for _ in range(3):
            edit = list(base)
            for _ in range(rng.integers(0, 3)):
                edit[rng.integers(0, len(edit))] = f"v{rng.integers(0, 9)}"
            texts.append(" ".join(edit + ["tail"] * int(rng.integers(0, 2))))
    monkeypatch.setattr(ngram_join, "BOUNDARIES", (boundary,))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, percent in ((1, 80), (3, 90), (2, 85)):
        sizes, root = brute.jaccard_groups(texts, width, percent)
        smallest = {g: min(v) for g, v in brute.grouped((root[k], k) for k in range(len(texts))).items()}
        got = ngram_join.link_documents(spark, df, width=width, percent=percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(k, sizes[k], smallest[root[k]]) for k in range(len(texts))]


@pytest.mark.parametrize("wide", [ngram_join.SKETCH, ngram_join.WIDE])
def test_sketches_never_differ_more_than_the_sets(wide):
    rng = np.random.default_rng(wide)
    for size in (1, 20, 700, 9000):
        one = rng.integers(0, 2**63, size).astype(np.uint64)
        for share in (0.0, 0.1, 0.6, 1.0):
            cut = int(size * share)
            other = np.concatenate((one[cut:], rng.integers(0, 2**63, cut // 2).astype(np.uint64)))
            a, b = ngram_join._sketch(np.sort(one), wide), ngram_join._sketch(np.sort(other), wide)
            assert len(a) == wide // 64
            flipped = int(np.unpackbits((a ^ b).view(np.uint8)).sum())
            assert flipped <= len(np.setxor1d(one, other))


def test_sketches_fold_to_fewer_cells(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for size in (10, 900, 5000, 21_000):
        one = np.sort(rng.integers(0, 2**63, size).astype(np.uint64))
        for cut in (0, size // 20, size // 5):
            other = one[cut:]
            for wide, x_wide in ((2048, 2048), (4096, 2048), (2048, 8192), (ngram_join.sketch_cells(size, 64), ngram_join.sketch_cells(len(other), 64))):
                rows.append([ngram_join._sketch(v, w).tolist() for v, w in ((one, wide), (other, x_wide))])
                same = [ngram_join._sketch(v, min(wide, x_wide)) for v in (one, other)]
                want.append(int(np.unpackbits((same[0] ^ same[1]).view(np.uint8)).sum()))
                assert want[-1] <= cut
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<long>, b array<long>")
    got = table.selectExpr("k", f"{ngram_join.differing('a', 'b')} as d").orderBy("k").collect()
    assert [r.d for r in got] == want


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 130, 4096, 4097, 100_000])
def test_sketches_have_cells_for_half_their_set(n):
    made = ngram_join.sketch_cells(n, 64)
    assert made >= 64 and made & (made - 1) == 0 and 2 * made >= n and (made == 64 or made < n)


@pytest.mark.parametrize("from_size,width,percent", [(40, 5, 80), (200, 3, 90)])
def test_ngram_join_of_long_sets_apart(spark, from_size, width, percent, monkeypatch):
    """Near copies at every side of the border between short and long sets, a shared passage in unlinked texts."""
    monkeypatch.setattr(ngram_join, "LONG", from_size)
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, texts = word(150), []
    for k in range(40):
        base = word(int(rng.integers(20, 300))) + passage * int(k % 3 == 0)
        texts.append(" ".join(base))
        for _ in range(4):
            edit = list(base)
            for _ in range(int(rng.integers(0, 1 + len(edit) // 30))):
                edit[int(rng.integers(0, len(edit)))] = f"v{rng.integers(0, 10**6)}"
            texts.append(" ".join(edit))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sizes, root = brute.jaccard_groups(texts, width, percent)
    smallest = {g: min(v) for g, v in brute.grouped((root[k], k) for k in range(len(texts))).items()}
    got = ngram_join.link_documents(spark, df, width=width, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(k, sizes[k], smallest[root[k]]) for k in range(len(texts))]


@pytest.mark.parametrize("many,width,percent", [(32, 5, 80), (2, 3, 90)])
def test_ngram_join_meets_few_pairs_of_unlinked_near_copies(spark, many, width, percent, monkeypatch):
    """A large group of texts that share lists but not links, with links of their own; the pairs of long lists are counted."""
    monkeypatch.setattr(ngram_join, "MANY", many, raising=False)
    rng = np.random.default_rng(11)
    edited = lambda words, n: [f"v{rng.integers(0, 10**6)}" if k in some else w for some in [set(rng.choice(len(words), n, False))] for k, w in enumerate(words)]
    base, texts = [f"w{x}" for x in rng.integers(0, 10**6, 300)], []
    for k in range(220):
        copy = edited(base, 16)
        texts.append(" ".join(copy))
        if k % 10 == 0:
            texts += [" ".join(edited(copy, 2)), " ".join(edited(copy, 6))]
    met = []
    save = Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name == "open":
            listed = Counter(), Counter()
            for r in out.collect():
                listed[0][r.sig] += 1
                listed[1][r.sig] += r.root != r.main
            met.append(sum(n * listed[1][sig] for sig, n in listed[0].items() if n >= many))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sizes, root = brute.jaccard_groups(texts, width, percent)
    smallest = {g: min(v) for g, v in brute.grouped((root[k], k) for k in range(len(texts))).items()}
    got = ngram_join.link_documents(spark, df, width=width, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(k, sizes[k], smallest[root[k]]) for k in range(len(texts))]
    assert 1 < len(smallest) < len(texts)
    assert len(met) == 1 and met[0] < len(texts) * 40


def test_keep_first_keeps_one_of_each_group(spark, clashing, rows, empty):
    kept = ngram_join.keep_first(spark, clashing)
    assert kept.columns == clashing.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    sizes, root = brute.jaccard_groups([r[1] for r in rows], 5, 80)
    for g, members in brute.grouped((root[k], k) for k in range(len(rows))).items():
        alive = {(rows[k][0], rows[k][1]) for k in members}
        count = sum(got[a] for a in alive)
        assert count == (1 if sizes[members[0]] else len(members))
        if sizes[members[0]]:
            first = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
            assert any(got[a] for a in alive if a[0] == first)
    assert ngram_join.keep_first(spark, empty).count() == 0


def test_keep_first_keeps_unrelated_groups_of_null_and_shared_ids(spark):
    rng = np.random.default_rng(11)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))
    rows = [(None, text()) for _ in range(12)] + [(7, text()) for _ in range(3)]
    rows += [(None, rows[0][1] + " end"), (None, rows[0][1]), (None, rows[12][1] + " end"), (9, rows[13][1] + " end"), (5, rows[14][1] + " end")]
    rows += [(None, ""), (None, " "), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_first(spark, df).collect())
    sizes, root = brute.jaccard_groups([r[1] for r in rows], 5, 80)
    for g, members in brute.grouped((root[k], k) for k in range(len(rows))).items():
        alive = {rows[k] for k in members}
        if sizes[members[0]]:
            first = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
            assert sum(got[a] for a in alive) == 1 and sum(got[a] for a in alive if a[0] == first) == 1
    assert got.total() == 12 + 3 + 3


# Sharding


def check_shards(got, rows, n):
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(by[s]) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_sharding_law_and_links(spark, docs, rows):
    got = sharding.shard_documents(spark, docs, n_shards=7).collect()
    check_shards(got, rows, 7)
    groups = brute.grouped((r.text_crc32, r.shard) for r in got if r["size"] > 16)
    cut = [len(set(v)) for v in groups.values() if len(v) > 1]
    assert cut and np.mean(cut) < 1.2  # a group of copies shares a shard


def test_sharding_a_group_larger_than_a_shard(spark, rows, empty, clashing):
    hot = [(k, "the same text", "en", "s", 1) for k in range(5000, 5600)] + rows
    df = spark.createDataFrame(hot, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shard_documents(spark, df, n_shards=20).collect()
    check_shards(got, hot, 20)
    homes = Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"the same text"))
    assert len(homes) <= 17
    assert sharding.shard_documents(spark, empty).count() == 0
    check_shards(sharding.shard_documents(spark, clashing, n_shards=3).collect(), rows, 3)
    alike = spark.createDataFrame([(k, "x") for k in range(50)], "doc_id long, text string")
    assert Counter(r.shard for r in sharding.shard_documents(spark, alike, n_shards=4).collect()) == Counter({0: 13, 1: 13, 2: 12, 3: 12})


# Packing


@pytest.mark.parametrize("size", [1024, 64])
def test_packing_is_whole_and_fits(spark, docs, rows, size):
    pieces = packing.pack_documents(spark, docs, path=BYTES, end=0, size=size).collect()
    want = brute.tokens(BYTES, [r[1] for r in rows], 0)
    tokens, room = sum(map(len, want)), 0
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert 0 < p.length == len(p.ids) // 2
    single = {r[0] for r, n in zip(rows, [0] * len(rows)) if sum(x[0] == r[0] for x in rows) == 1}
    for r, ids in zip(rows, want):
        if r[0] in single:
            ps = sorted(by_doc[r[0]], key=lambda p: p.start)
            assert b"".join(p.ids for p in ps) == np.array(ids, "<u2").tobytes()
            assert [p.start for p in ps] == list(np.cumsum([0] + [p.length for p in ps])[:-1])
            assert {p.doc_tokens for p in ps} == {len(ids)}
    assert sum(p.length for p in pieces) == tokens
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        ends = np.cumsum([0] + [p.length for p in ps])
        assert [p.offset for p in ps] == list(ends[:-1]) and ends[-1] <= size
        room += ends[-1] if ends[-1] & (ends[-1] - 1) == 0 else size
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert room <= tokens * 1.02
    assert all(p.ids_crc32 == brute.crc(np.frombuffer(p.ids, "<u2")) for p in pieces)


def test_packing_empty_and_extra_columns(spark, clashing, empty):
    assert packing.pack_documents(spark, empty, path=BYTES, end=0).count() == 0
    assert packing.pack_documents(spark, clashing, path=BYTES, end=0).count() > 0


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {1: 3}, {600: 100}, {600: 100, 424: 100}, {k: 1023 // k + 3 for k in range(1, 1024)}])
def test_cutting_stock_places_every_item_once(histogram):
    plan = packing.solve(histogram, 1024)
    used = defaultdict(list)
    for n, count in histogram.items():
        for rank in range(count):
            placed = plan.place(n, rank)
            assert sum(p[2] for p in placed) == n
            for s, o, m in placed:
                used[s].append((o, o + m))
    assert sorted(used) == list(range(plan.sequences))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 1024


def test_column_generation_beats_greedy_filling():
    # Greedy puts the longest first and wastes; pairs that fill a sequence exactly exist.
    histogram = {700: 300, 500: 300, 524: 300, 324: 300, 348: 300, 676: 300}
    plan = packing.solve(histogram, 1024)
    assert plan.sequences * 1024 <= sum(n * c for n, c in histogram.items()) + 2 * 1024
    assert 0 <= plan.gap <= packing.GAP


def test_a_plan_that_ends_early_tells_its_gap(monkeypatch):
    histogram = {400: 1000, 350: 700, 290: 900, 610: 333}
    full = packing.solve(histogram, 1024)
    monkeypatch.setattr(packing, "ROUNDS", 1)
    early = packing.solve(histogram, 1024)
    assert early.gap > packing.GAP and early.gap > full.gap >= 0


# Suffix-array dedup


def test_repeats_match_brute_force(spark, docs, rows, monkeypatch):
    want = defaultdict(list)
    plain = [r for r in rows if r[0] not in (None, 900_016)]
    ordered = sorted(plain, key=lambda r: r[0])
    df = spark.createDataFrame(plain, docs.schema).repartition(6)
    expected = {r[0]: e for r, e in zip(ordered, brute.repeats([r[1] for r in ordered]))}
    got = suffix_dedup.repeat_digests(suffix_dedup.remove_repeats(spark, df)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected
    assert any(e[1] for e in expected.values()) and len(got) == len(plain)
    del want


def test_repeats_with_hot_anchors_and_long_texts(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    plain = [r for r in rows if r[0] not in (None, 900_016)]
    ordered = sorted(plain, key=lambda r: r[0])
    expected = {r[0]: e for r, e in zip(ordered, brute.repeats([r[1] for r in ordered]))}
    df = spark.createDataFrame(plain, docs.schema).repartition(3)
    got = suffix_dedup.repeat_digests(suffix_dedup.remove_repeats(spark, df)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected


def test_repeats_of_tied_and_repeated_rows(spark, clashing, rows, empty):
    trimmed = suffix_dedup.remove_repeats(spark, clashing)
    got = trimmed.collect()
    assert len(got) == len(rows)
    same = [r for r in got if r.doc_id == 900_016 and r.n_bytes == len(rows[-8][1].encode())]
    assert sum(r.n_removed < r.n_bytes for r in same) <= 1
    total = brute.repeats([r[1] for r in sorted(rows, key=lambda r: key(r[0]))])
    assert sum(r.n_bytes for r in got) == sum(t[0] for t in total)
    assert sum(r.n_bytes - r.n_removed for r in got) == pytest.approx(sum(t[0] - t[1] for t in total), rel=0.02)
    assert suffix_dedup.remove_repeats(spark, empty).count() == 0
    left = suffix_dedup.without_repeats(spark, clashing)
    assert left.columns == clashing.columns and left.count() <= len(rows)


def test_texts_without_repeats_match_brute_force(spark, rows):
    plain = sorted((r for r in rows if r[0] not in (None, 900_016)), key=lambda r: r[0])
    df = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    want = {}
    for r, rest, n in zip(plain, brute.kept_bytes([r[1] for r in plain]), (len((r[1] or "").encode()) for r in plain)):
        if rest or not n:
            want[r[0]] = rest.decode("utf-8", "ignore")
    got = {r.doc_id: r.text or "" for r in suffix_dedup.without_repeats(spark, df).collect()}
    assert got == want and len(got) < len(plain)


def test_smaller_neighbours():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 400):
        p = rng.permutation(n)
        before, after = suffix_dedup.smaller_neighbours(p)
        for k in range(n):
            assert before[k] == max((j for j in range(k) if p[j] < p[k]), default=-1)
            assert after[k] == min((j for j in range(k + 1, n) if p[j] < p[k]), default=-1)


# Language ID


def test_language_id_learns_and_rejects(spark, docs, rows, clashing, empty):
    got = langid.predict_languages(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    texts = {r[0]: r[1] for r in rows}
    langs = {r[2] for r in rows if r[2]}
    for r in got:
        letters = any(map(str.isalpha, texts[r.doc_id] or "")) if r.doc_id is not None else True
        assert r.lang_pred in langs if letters else r.lang_pred == "und"
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    scored = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id < 900_000]
    assert np.mean(scored) > 0.9
    assert {r.lang_pred for r in langid.predict_languages(empty).collect()} == set()
    assert langid.predict_languages(clashing).count() == len(rows)
    none = langid.classify(docs.select("text"), {})
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_language_id_of_many_languages(spark, monkeypatch):
    """More languages than a worker holds coders for; a plain coder for each text gives the same answers."""
    import zstandard

    rng = np.random.default_rng(3)
    rows = []
    for lang in range(300):
        own = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(30)]
        rows += [(lang * 3 + k, " ".join(rng.choice(own, 40)), f"l{lang:03}") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(df)
    assert len(model) == 300
    some = spark.createDataFrame(rows[::40], df.schema)
    got = {r.doc_id: r for r in langid.classify(some, model).collect()}
    assert len(got) == len(rows[::40])
    for doc_id, text, lang in rows[::40]:
        sizes = []
        for name in sorted(model):
            content = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = text.encode()
            sizes.append((sum(len(coder.compress(raw[k : k + langid.CHUNK])) for k in range(0, len(raw), langid.CHUNK)), name))
        sizes.sort()
        assert got[doc_id].lang_pred == sizes[0][1] == lang
        assert got[doc_id].margin == sizes[1][0] / sizes[0][0] - 1
    monkeypatch.setattr(langid, "MODEL_BYTES", 300 * 50)
    small = langid.train(df)
    assert len(small) == 300 and {len(v) for v in small.values()} == {50}
    assert all(model[k].endswith(v) for k, v in small.items())


def test_language_id_tells_short_texts_and_keeps_clean_ones(spark, sf01):
    import corpus_pipeline

    docs = spark.read.schema("doc_id long, text string, lang string").parquet(f"{sf01}/documents.parquet").filter("text not like '%!!%'").cache()
    truth = {r.doc_id: (r.lang, len((r.text or "").split())) for r in docs.collect()}
    got = [(r, *truth[r.doc_id]) for r in langid.predict_languages(docs).collect() if r.held_out]
    short = [r.lang_pred == lang for r, lang, n in got if 21 <= n <= 100]
    longer = [r.lang_pred == lang for r, lang, n in got if n > 100]
    assert len(short) > 20 and np.mean(short) >= 0.95
    assert len(longer) > 150 and np.mean(longer) >= 0.98
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").select("doc_id").collect()}
    clean = [d for d, (_, n) in truth.items() if n > 20]
    assert sum(d not in kept for d in clean) <= len(clean) * 0.002


# Mixing


def test_mixing_targets_and_quotas(spark, docs, rows, clashing, empty):
    got = mixing.mix_sources(spark, docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(brute.WORD.findall(r[1] or ""))
    want = brute.targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(brute.WORD.findall(r[1] or ""))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK
    again = mixing.mix_sources(spark, docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix_sources(spark, empty).count() == 0
    assert mixing.mix_sources(spark, clashing).count() == len(rows)


def test_mixed_documents_hold_the_words_taken(spark, clashing, docs):
    want = sum(r.taken for r in mixing.mix_sources(spark, docs).collect())
    mixed = mixing.mixed_documents(spark, clashing)
    assert mixed.columns == clashing.columns
    assert sum(len(brute.WORD.findall(r.text or "")) for r in mixed.collect()) == want


def test_mixed_documents_keep_white_space(spark):
    rows = [(k, "\n".join(f" a{k}\tb{j}  c" for j in range(k % 9 + 3)) + "\n", f"s{k % 4}") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.doc_id: r for r in mixing.mix_sources(spark, df).collect()}
    got = brute.grouped((r.doc_id, r.text) for r in mixing.mixed_documents(spark, df).collect())
    cut = 0
    for doc_id, text, _ in rows:
        whole, part = divmod(plan[doc_id].taken, plan[doc_id]["size"])
        ends = [m.end() for m in brute.WORD.finditer(text)]
        assert sorted(got[doc_id]) == sorted([text] * whole + ([text[: ends[part - 1]]] if part else []))
        cut += part > 0
    assert cut


def test_rows_equal_but_for_other_columns_are_all_mixed(spark):
    rows = [(7, "a b c d", "s0", x) for x in "xyz"] + [(None, "q r", "s0", x) for x in "uv"] + [(k, f"w{k} v u", "s1", "o") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string").repartition(3)
    taken = brute.grouped(((r.doc_id, r.source), (r["size"], r.taken)) for r in mixing.mix_sources(spark, df).collect())
    got = brute.grouped(((r.doc_id, r.source), r) for r in mixing.mixed_documents(spark, df).collect())
    for k, decisions in taken.items():
        assert sorted(len(r.text.split()) for r in got[k]) == sorted(n for size, t in decisions for n in [size] * (t // size) + [t % size] * (t % size > 0))
    for k, extras in (((7, "s0"), "xyz"), ((None, "s0"), "uv")):
        assert len({r.extra for r in got[k]}) == sum(t > 0 for _, t in taken[k]) and {r.extra for r in got[k]} <= set(extras)
    assert len(taken[(7, "s0")]) == 3 and got[(7, "s0")]


def test_words_taken_follow_from_quotas(spark, docs):
    got = mixing.mix_sources(spark, docs).collect()
    whole = {s: min(int(t // n), 3) if n else 0 for s, t, n in {(r.source, r.target, r.source_size) for r in got}}
    parts = brute.grouped((r.source, (r.taken - whole[r.source] * r["size"], r["size"])) for r in got)
    blocks = {s: sum(p for p, _ in v) for s, v in parts.items()}
    for s, v in parts.items():
        n = sum(size for _, size in v)
        # A source of one shard has one border: all before it are taken whole, all after it not.
        if n <= mixing.SHARD_WORDS and whole[s] < 3:
            assert sum(0 < p < size for p, size in v) <= 1
            assert blocks[s] == n or blocks[s] % mixing.BLOCK == 0
        assert all(0 <= p <= size for p, size in v)


@pytest.mark.parametrize("seats", [[0, 3, 10], [1, 57, 400]])
def test_sainte_lague_within_gives_highest_quotients(spark, seats):
    votes = {f"g{g}": {f"s{k:02d}": v for k, v in enumerate(vs)} for g, vs in enumerate(([5, 5, 5, 0], [53, 24, 23, 1, 999], [7, 300]))}
    df = spark.createDataFrame([(g, k, float(v), seats[int(g[1])]) for g, ps in votes.items() for k, v in ps.items()], "grp string, key string, votes double, seats long")
    got = {(r.grp, r.key): r.quota for r in mixing.sainte_lague_within(df, "grp", "votes", "seats").collect()}
    for g, ps in votes.items():
        n = seats[int(g[1])]
        want = Counter(k for _, k in sorted((-v / (2 * i + 1), k) for k, v in ps.items() for i in range(n) if v)[:n])
        assert {k: got[(g, k)] for k in ps} == {k: want[k] for k in ps}


def test_sainte_lague_gives_highest_quotients(spark):
    votes = {f"s{k:02d}": v for k, v in enumerate([53, 24, 23, 0, 1, 999, 7, 7, 7, 300])}
    df = spark.createDataFrame([(k, float(v)) for k, v in votes.items()], "key string, votes double")
    for seats in (0, 1, 5, 100, 1234):
        quotients = sorted((-v / (2 * k + 1), name) for name, v in votes.items() for k in range(seats) if v)[:seats]
        want = Counter(n for _, n in quotients)
        got = {r.key: r.quota for r in mixing.sainte_lague(df, "votes", seats, Scratch(spark, "t")).collect()}
        assert got == {k: want[k] for k in votes}


# License scan


def brute_licenses(rows):
    import re

    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    out = set()
    for r in rows:
        w = split(r[1] or "")
        for name, text in license_scan.NOTICES:
            t = split(text)
            width = min(5, len(t))
            want = {tuple(t[k : k + width]) for k in range(len(t) - width + 1)}
            for k in range(max(1, len(w) - len(t) + 1)):
                part = w[k : k + len(t)]
                have = {tuple(part[j : j + width]) for j in range(len(part) - width + 1)}
                if len(want & have) >= 0.8 * len(want):
                    out.add((r[0], name))
    return out


def test_license_scan_finds_planted_notices(spark, rows, docs, clashing, empty):
    mit = dict(license_scan.NOTICES)["mit-notice"]
    planted = [
        (800_001, rows[0][1] + "\n" + mit + "\n" + rows[1][1], None, None, None), (800_002, mit.upper().replace(" ", "\n"), None, None, None),
        (800_003, mit.replace("granted", "given"), None, None, None), (800_004, "all rights reserved", None, None, None),
        (800_005, (mit + " other words here ") * 3, None, None, None), (800_006, mit[:40], None, None, None),
    ]
    df = spark.createDataFrame(rows + planted, docs.schema)
    got = license_scan.scan_licenses(spark, df).collect()
    found = {(r.doc_id, r.template_id) for r in got}
    want = brute_licenses(rows + planted)
    assert want <= found
    for r in got:
        assert r.containment >= 0.8
    assert {d for d, _ in found} == {d for d, _ in want}
    assert {r.doc_id: r.n_spans for r in got if r.template_id == "mit-notice"}[800_005] == 3
    assert license_scan.scan_licenses(spark, empty).count() == 0
    assert license_scan.scan_licenses(spark, clashing).count() >= 0
    own = spark.createDataFrame([("t", rows[2][1]), ("none", None), ("blank", "  ")], "template_id string, text string")
    assert (rows[2][0], "t") in {(r.doc_id, r.template_id) for r in license_scan.scan_licenses(spark, docs, own).collect()}


def test_license_scan_finds_whole_licences_without_the_notices(spark):
    whole = dict(license_scan.licences())
    names = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "CC0-1.0", "MPL-2.0-header")
    body = {n: " ".join(whole[n].split()[0 if n.endswith("header") else 10 :]) for n in names}
    rows = [(k, f"some words before {body[n]} and some after") for k, n in enumerate(names)] + [(99, body["MIT"][:300])]
    got = {(r.doc_id, r.template_id) for r in license_scan.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, n) for k, n in enumerate(names)} <= got
    assert not {d for d, n in got if d == 99 and n == "MIT"}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    from ledgerline.llm import words

    rng = np.random.default_rng(2)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(30_000)) + " " + "y" * 5000 + "\n end"
    column = pa.array([text, "a b"])
    (_, raw, offsets), = words.text_chunks(column)
    want, firsts = words.word_hashes(raw, offsets)
    monkeypatch.setattr(words, "CHUNK", 1000)
    (_, raw, offsets), _ = words.text_chunks(column)
    got, ends = words.word_hashes(raw, offsets)
    assert np.array_equal(got, want[: firsts[1]]) and ends.tolist() == [0, len(got)]
    shingles, edges = words.shingles(got, ends, 5)
    both, starts = words.shingles(want, firsts, 5)
    assert np.array_equal(shingles, both[: starts[1]]) and edges.tolist() == [0, len(shingles)]


def test_a_text_of_80_mb_takes_less_than_a_gigabyte(tmp_path):
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from ledgerline.llm import ngram_join
words = [str(k) * 2 for k in range(99991)]
text = " ".join(words[k * 7919 % 99991] for k in range(7_600_000))
assert len(text) > 80_000_000
batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
del text
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for row, values in ngram_join._rows(batch, 5):
    assert len(values) > 7_000_000 or len(values) == 99991
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1000


def brute_scan(rows, templates):
    """(doc_id, template) -> (spans, best share, first word) over every window, by plain sets."""
    import re

    split = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def cut(text):
        return split.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    out = {}
    for name, text in templates:
        t = cut(text)
        width, stride = min(5, len(t)), max(1, len(t) // 4)
        have = {tuple(t[k : k + width]) for k in range(len(t) - width + 1)}
        for doc_id, body, *_ in rows:
            w = cut(body)
            made = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
            if not made or not have.intersection(made):
                continue
            span = len(t) + stride - width
            starts = sorted({*range(0, max(len(made) - span, 0) + 1, stride), max(len(made) - span, 0)})
            shares = [(s, len(have.intersection(made[s : s + span])) / len(have)) for s in starts]
            shares = [(s, x) for s, x in shares if x >= 0.8 - 1e-12]
            if shares:
                spans, at = 0, -len(t)
                for s, _ in shares:
                    if s - at >= len(t):
                        spans, at = spans + 1, s
                out[doc_id, name] = (spans, max(x for _, x in shares), shares[0][0])
    return out


def test_license_scan_of_all_templates_equals_every_window(spark, monkeypatch):
    rng = np.random.default_rng(11)
    whole = license_scan.licences()
    filler = [f"word{k}" for k in range(400)]
    rows = []
    for k, (name, text) in enumerate(whole):
        words = text.split()
        kept = [w for w in words if rng.random() > 0.01]
        before, after = (" ".join(rng.choice(filler, rng.integers(0, 300))) for _ in "ab")
        rows += [(10 * k, text), (10 * k + 1, f"{before} {text} {after} {text}"), (10 * k + 2, f"{before} {' '.join(kept)} {after}"),
                 (10 * k + 3, " ".join(words[: int(len(words) * 0.85)])), (10 * k + 4, " ".join(words[: int(len(words) * 0.6)])),
                 (10 * k + 5, " ".join(rng.permutation(words)))]
    rows += [(None, whole[0][1]), (5001, None), (5002, ""), (5003, "one")]
    want = brute_scan(rows, whole)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for part in (1 << 18, 1000):
        monkeypatch.setattr(license_scan, "PART", part)
        got = license_scan._scan(iter([pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.nulls(len(rows), pa.int64())], names=["doc_id", "text", "_rest"])]), whole)
        found = {(r["doc_id"], r["template_id"]): (r["n_spans"], pytest.approx(r["containment"]), r["first_word"]) for b in got for r in b.to_pylist()}
        assert found == want
    monkeypatch.undo()
    assert {(r.doc_id, r.template_id) for r in license_scan.scan_licenses(spark, df).collect()} == set(want)
    # Nothing is found but through the bands.
    made = license_scan.families(whole)
    for f in made:
        f.values[:] = 0
    monkeypatch.setattr(license_scan, "families", lambda _: made)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([whole[0][1]]), pa.nulls(1, pa.int64())], names=["doc_id", "text", "_rest"])
    assert sum(b.num_rows for b in license_scan._scan(iter([batch]), whole)) == 0
