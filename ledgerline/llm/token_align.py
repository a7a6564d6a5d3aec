"""Cross-tokenizer alignment: which ids of two tokenizers end together, counted over the corpus.

A text, with a space before it, is encoded by A (byte-level BPE) and B (BPE pieces).  Byte offsets
where tokens of both end cut the tokens into groups, and the two tokens that end there are linked.

Texts are encoded once and their ids kept in a table.  First pass: every task aligns its ids, counts
its links by id pair and writes (pair, count) rows.  The distinct pairs get a *minimal perfect hash*:
hash buckets of about BUCKET pairs, in each of which levels of bitmaps place a pair where it meets no
other, the rest going to the next level; the rank of a pair's bit is its place among 0 .. n-1.  With
each function goes its dense array of pairs, so a looked-up pair is *verified*.  Counts become *dense
vectors* indexed by that place: one for every share of the rows of a bucket, summed in a *tree* of FAN
vectors at a time until one is left.

Second pass: the ids are aligned again, and their links' counts looked up in the vectors.  The index
goes to the workers whole if it has at most ``lookup_bytes``; a larger one stays a table, and the
documents' distinct pairs are dealt to its buckets, in salted shares, and streamed past them.  Both
ways look every pair up in the same vectors.

Texts are cut at places no token of A or B can cross, before a space or line feed that follows a
visible character.  B's ids of a cut piece are cached; the cache has a bound and drops no work, as
what isn't in it is encoded again.  A long text is encoded and aligned in parts, cut the same way.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import CACHES, Scratch, heads_first, past_heads
from ledgerline.llm.words import mix

#: Pairs in a bucket of the hash function, on average.
BUCKET = 4096
#: Slots of a level of bitmaps for each pair that is still to be placed.
ROOM = 2.0
#: Rows counted into one vector, and vectors summed at a step of the tree.
SHARE, FAN = 1 << 16, 8
#: The largest index, in bytes, that is sent to the workers whole.
LOOKUP_BYTES = 48_000_000
#: Pieces whose ids of B a worker keeps (about 200 bytes each).
CACHE = 700_000
#: Characters of text encoded at a time, tokens aligned at a time, and distinct pairs a task holds before it writes them.
WINDOW, TOKENS, HELD = 1 << 20, 1 << 19, 1 << 20

_U = np.uint64
_VISIBLE = "[!-~\u00a1-\u167f]"
#: Before a space or line feed after a visible character, and such white space where that isn't so.
_CUT = re.compile(f"(?<={_VISIBLE})(?=[ \\n])")
_UNCUT = re.compile(f"(?<!{_VISIBLE})[ \\n]|\x00")
_made: dict[tuple[str, str], Tokens] = {}
CACHES.append(_made)


def _file(name: str) -> str:
    """A path as it is; the name of a public tokenizer's file is looked up where the task runs."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 ones for themselves, the others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens:
    """Both tokenizers, the bytes of their ids, and a bounded cache of B's ids of pieces."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_file(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=_file(b))
        of = _byte_of_character()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, number in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[number] = bytes(of[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in enumerate(pieces)
        ]
        self.kind = "<u2" if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else "<u4"
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.spelt = [f"{k}{end}" for k in range(len(self.bytes_a)) for end in ",|"]
        self.second = len(self.spelt)
        self.spelt += [f"{k}{end}" for k in range(len(self.bytes_b)) for end in ",;"]
        spec = json.loads(self.a.to_str())
        split = spec["pre_tokenizer"] or {}
        level = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        # A cut is safe where A splits at white space by itself and no piece of B has a space or line feed inside.
        inner = any(" " in p.replace("\u2581", " ").lstrip(" ") or "\n" in p for p in pieces)
        self.cuts = level and not split.get("add_prefix_space") and not inner
        self.plain = self._by_ranks(spec) if level else None
        self.known: dict[str, bytes | None] = {}

    def _by_ranks(self, spec: dict):
        """The same vocabulary for tiktoken, which is faster, if ids rise with the merges as its ranks have to."""
        import public_tokenizers
        import tiktoken

        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(made, made[1:])):
            return None
        ranks = {self.bytes_a[k]: k for k in vocab.values() if self.bytes_a[k] and k not in {t["id"] for t in spec["added_tokens"]}}
        return tiktoken.Encoding("A", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, a: str, b: str) -> Tokens:
        """One instance for each Python worker, kept over tasks."""
        if (a, b) not in _made:
            _made[a, b] = cls(a, b)
        return _made[a, b]

    def parts(self, spaced: str) -> Iterator[str]:
        """A text in parts of about WINDOW characters that tokens don't cross."""
        start = 0
        while start < len(spaced):
            found = _CUT.search(spaced, start + WINDOW) if self.cuts and len(spaced) - start > WINDOW else None
            end = found.start() if found else len(spaced)
            yield spaced[start:end]
            start = end

    def pieces(self, part: str) -> list[str]:
        if not self.cuts:
            return [part]
        if _UNCUT.search(part, 1):
            return _CUT.split(part)
        return (part[0] + part[1:].replace(" ", "\x00 ").replace("\n", "\x00\n")).split("\x00")

    def learn(self, pieces: Iterator[str]) -> None:
        """B's ids of the pieces that aren't known; none where they don't give back the piece's bytes."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if not new:
            return
        if self.cuts:
            # A piece needn't begin with a space; the one that B adds ends before the line feed put here.
            other = [p for p in new if p[0] != " " or len(p) == 1]
            new = [p for p in new if p[0] == " " and len(p) > 1]
            told = self.b.encode([p[1:] for p in new], num_threads=1) + [ids[2:] for ids in self.b.encode(["\n" + p for p in other], num_threads=1)]
            new += other
        else:
            told = self.b.encode([p[1:] for p in new], num_threads=1)
        at = self.bytes_b.__getitem__
        for piece, ids in zip(new, told):
            right = b"".join(map(at, ids)) == piece.encode()
            self.known[piece] = np.array(ids, self.kind).tobytes() if right else None

    def encode(self, texts: list[str | None]) -> list[tuple[list[bytes], list[bytes]]]:
        """Of each text, with a space before it, its parts' ids of A and of B; none unless both give back its bytes."""
        cut = [[(part, self.pieces(part)) for part in self.parts(" " + text)] if text else [] for text in texts]
        out = []
        self.learn(chain.from_iterable(pieces for parts in cut for _, pieces in parts))
        at, known = self.bytes_a.__getitem__, self.known.__getitem__
        for parts in cut:
            of_a, of_b = [], []
            for part, pieces in parts:
                ids = self.plain.encode_ordinary(part) if self.plain else self.a.encode(part, add_special_tokens=False).ids
                second = list(map(known, pieces))
                if None in second or b"".join(map(at, ids)) != part.encode():
                    of_a, of_b = [], []
                    break
                of_a.append(np.array(ids, self.kind).tobytes())
                of_b.append(b"".join(second))
            out.append((of_a, of_b))
        for _ in range(len(self.known) - CACHE):
            self.known.popitem()
        return out

    def align(self, of_a: list[bytes], of_b: list[bytes]) -> Alignment:
        """The alignment of parts of texts, each with the same bytes in A and in B."""
        width = int(self.kind[-1])
        a, b = (np.frombuffer(b"".join(x), self.kind).astype(np.int64) for x in (of_a, of_b))
        first_a, first_b = (np.cumsum([0] + [len(x) // width for x in ids]) for ids in (of_a, of_b))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at_b, at_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
        cut_a, cut_b = end_b[at_b] == end_a, end_a[at_a] == end_b
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        return Alignment(self, a, b, first_a, first_b, cut_a, cut_b, last_a, last_b)


class Alignment:
    """Parts' ids one after another, which of them end a group, and the links' pairs."""

    def __init__(self, tokens, a, b, first_a, first_b, cut_a, cut_b, last_a, last_b):
        self.tokens, self.a, self.b, self.first_a, self.first_b = tokens, a, b, first_a, first_b
        self.cut_a, self.cut_b, self.last_a, self.last_b = cut_a, cut_b, last_a, last_b
        self.pairs = (a[last_a] << 32) | b[last_b]
        #: Each part's first link; one more ends the last.
        self.links = np.searchsorted(last_a, first_a)

    def spelt(self) -> list[str]:
        """Each part's groups as text."""
        of_a, of_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.append(0, self.last_b + 1)[of_a]] = 2 * self.a + self.cut_a
        order[np.arange(len(self.b)) + np.append(self.last_a + 1, 0)[of_b]] = self.tokens.second + 2 * self.b + self.cut_b
        words = list(map(self.tokens.spelt.__getitem__, order.tolist()))
        at = (self.first_a + self.first_b).tolist()
        return ["".join(words[low:high])[:-1] for low, high in zip(at, at[1:])]


def _runs(batch: pa.RecordBatch, tokens: Tokens) -> Iterator[tuple[list[int], Alignment, np.ndarray]]:
    """(row of each part, their alignment, whether a part ends its row) of about TOKENS ids at a time, at least one part for each row."""
    row_of: list[int] = []
    of_a: list[bytes] = []
    of_b: list[bytes] = []
    ends: list[bool] = []
    size = 0
    for row, (parts_a, parts_b) in enumerate(zip(batch.column("a"), batch.column("b"))):
        parts_a, parts_b = parts_a.as_py() or [b""], parts_b.as_py() or [b""]
        for at, (x, y) in enumerate(zip(parts_a, parts_b)):
            row_of.append(row)
            of_a.append(x)
            of_b.append(y)
            ends.append(at + 1 == len(parts_a))
            size += len(x) + len(y)
            if size > 4 * TOKENS:
                yield row_of, tokens.align(of_a, of_b), np.array(ends)
                row_of, of_a, of_b, ends, size = [], [], [], [], 0
    if row_of:
        yield row_of, tokens.align(of_a, of_b), np.array(ends)


class Index:
    """Hash functions, their pairs and counts: buckets in order, and the best count of each id of B."""

    def __init__(self, buckets: list[tuple[list[int], bytes, bytes, bytes]], best: dict[int, int]):
        depth = max([len(levels) for levels, _, _, _ in buckets] + [1])
        self.room = np.zeros((len(buckets), depth), np.uint64)
        for k, (levels, _, _, _) in enumerate(buckets):
            self.room[k, : len(levels)] = levels
        self.first = np.cumsum(np.append(0, self.room.sum(axis=1)))[:-1].astype(np.int64)
        self.begin = self.first[:, None] + (np.cumsum(self.room, axis=1) - self.room).astype(np.int64)
        parts = [np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sum(levels))) for levels, bits, _, _ in buckets]
        self.bits = np.concatenate(parts + [np.zeros(0, np.uint8)]).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32)
        self.keys = np.frombuffer(b"".join(keys for _, _, keys, _ in buckets), np.int64)
        self.count = np.frombuffer(b"".join(counts for _, _, _, counts in buckets), np.int64)
        self.most = np.zeros(max(best, default=0) + 1, np.int64)
        for number, count in best.items():
            self.most[number] = count

    def counts(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's count, and whether it is the highest of its id of B."""
        out = np.zeros(len(pairs), np.int64)
        if len(self.keys) and len(pairs):
            some, back = np.unique(pairs, return_inverse=True)
            place = self.rank[_slots(some, bucket_of(some, len(self.room)), self.room, self.begin, self.bits)] - 1
            verified = self.keys[place] == some
            out = np.where(verified, self.count[place], 0)[back]
        second = pairs & 0xFFFFFFFF
        top = np.where(second < len(self.most), self.most[np.minimum(second, len(self.most) - 1)], 0)
        return out, (out == top) & (out > 0)


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(pairs.astype(np.uint64) + _U(0x5DEECE66D)) % _U(max(buckets, 1))).astype(np.int64)


def _level(pairs: np.ndarray, level: int) -> np.ndarray:
    return mix(pairs.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _slots(pairs: np.ndarray, bucket: np.ndarray, room: np.ndarray, begin: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bit at which each pair is placed; one that isn't of the index ends anywhere."""
    out = np.zeros(len(pairs), np.int64)
    left = np.arange(len(pairs))
    for level in range(room.shape[1]):
        have = room[bucket[left], level]
        left, have = left[have > 0], have[have > 0]
        at = begin[bucket[left], level] + (_level(pairs[left], level) % have).astype(np.int64)
        placed = bits[at]
        out[left[placed]] = at[placed]
        left = left[~placed]
        if not len(left):
            break
    return out


def perfect_hash(pairs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(slots of each level, bits of all levels, the pairs in the order of their places) of distinct pairs."""
    levels: list[int] = []
    bits: list[np.ndarray] = []
    placed: list[np.ndarray] = []
    left = pairs
    while len(left):
        room = int(np.ceil(ROOM * len(left)))
        at = (_level(left, len(levels)) % _U(room)).astype(np.int64)
        alone = np.bincount(at, minlength=room) == 1
        mine = alone[at]
        order = np.argsort(at[mine])
        levels.append(room)
        bits.append(alone)
        placed.append(left[mine][order])
        left = left[~mine]
    return levels, np.concatenate(bits + [np.zeros(0, bool)]), np.concatenate(placed + [np.zeros(0, np.int64)])


def _encode(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    """Each document's ids of both tokenizers."""
    tokens = Tokens.get(a, b)

    def told(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        made = tokens.encode(texts)
        kind = pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays([ids, pa.array([m[0] for m in made], kind), pa.array([m[1] for m in made], kind)], names=["doc_id", "a", "b"])

    for batch in batches:
        start, size = 0, 0
        run: list[str | None] = []
        for row, value in enumerate(batch.column("text")):
            run.append(value.as_py())
            size += len(run[-1] or "")
            if size > WINDOW or row + 1 == batch.num_rows:
                yield told(batch.column("doc_id").slice(start, row + 1 - start), run)
                run, start, size = [], row + 1, 0


def _count_links(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    """The task's links counted by pair."""
    tokens = Tokens.get(a, b)
    held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])

    def fold() -> tuple[np.ndarray, np.ndarray]:
        some, n = np.unique(np.concatenate(waiting), return_counts=True)
        both, back = np.unique(np.concatenate([held, some]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, back, np.concatenate([counts, n]))
        waiting.clear()
        return both, total

    size = 0
    for batch in batches:
        for _, alignment, _ in _runs(batch, tokens):
            waiting.append(alignment.pairs)
            size += len(alignment.pairs)
            if size > 4 * HELD:
                held, counts = fold()
                size = 0
                if len(held) > HELD:
                    yield told()
                    held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if waiting:
        held, counts = fold()
    yield told()


def _hash_bucket(table: pa.Table) -> pa.Table:
    """The perfect hash of a bucket's pairs."""
    pairs = np.sort(table.column("pair").to_numpy())
    levels, bits, placed = perfect_hash(pairs)
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()), "levels": pa.array([levels], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "keys": pa.array([placed.tobytes()], pa.binary()),
    })


def _one_bucket(function: dict) -> Index:
    return Index([(function["levels"], function["bits"], function["keys"], function.get("counts") or bytes(len(function["keys"])))], {})


def _count_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A dense vector of counts for every bucket and share."""

    def told(at: tuple[int, int], vector: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([vector.tobytes()], pa.binary())],
            names=["bucket", "share", "counts"],
        )

    now, index, vector = None, None, None
    for function, rows in heads_first(batches, "bits"):
        if rows is None:
            if now is not None:
                yield told(now, vector)
            now, index = (function["bucket"], function["share"]), _one_bucket(function)
            vector = np.zeros(len(index.keys), np.int64)
            continue
        pairs = rows.column("pair").to_numpy()
        place = index.rank[_slots(pairs, np.zeros(len(pairs), np.int64), index.room, index.begin, index.bits)] - 1
        if not (index.keys[place] == pairs).all():
            raise RuntimeError("a counted pair isn't in the index")
        np.add.at(vector, place, rows.column("n").to_numpy())
    if now is not None:
        yield told(now, vector)


def _sum_vectors(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v.as_py(), np.int64) for v in table.column("counts")], axis=0, dtype=np.int64)
    return pa.table({
        "bucket": table.column("bucket")[:1], "share": table.column("share")[:1], "counts": pa.array([total.tobytes()], pa.binary()),
    })


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs and counts of the index as rows."""
    for batch in batches:
        for keys, counts in zip(batch.column("keys"), batch.column("counts")):
            pairs, n = np.frombuffer(keys.as_py(), np.int64), np.frombuffer(counts.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])


def encode_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, a, b): the ids of each document's parts, as little-endian 16-bit numbers (32-bit ones for larger vocabularies)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(partial(_encode, a=a, b=b), "doc_id long, a array<binary>, b array<binary>")


def build_index(encoded: DataFrame, scratch: Scratch, a: str, b: str) -> DataFrame:
    """(bucket, levels, bits, keys, counts): the hash functions of all pairs and the counts in their order."""
    counted = scratch.save(encoded.select("a", "b").mapInArrow(partial(_count_links, a=a, b=b), "pair long, n long"), "counted")
    pairs = scratch.save(counted.select("pair").distinct(), "pairs")
    buckets = -(-pairs.count() // BUCKET) or 1

    def dealt(df: DataFrame) -> DataFrame:
        def add(batches):
            for batch in batches:
                yield batch.append_column("bucket", pa.array(bucket_of(batch.column("pair").to_numpy(), buckets)))

        return df.mapInArrow(add, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", bucket long")

    functions = scratch.save(
        dealt(pairs).groupBy("bucket").applyInArrow(_hash_bucket, "bucket long, levels array<long>, bits binary, keys binary"), "functions"
    )
    rows = dealt(counted)
    shares = max(1, -(-counted.count() // (buckets * SHARE)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))
    vectors = scratch.save(
        past_heads(
            functions.withColumn("share", every), rows.withColumn("share", F.pmod(F.xxhash64("pair", "n"), F.lit(shares))),
            ["bucket", "share"], "bits",
        ).mapInArrow(_count_vectors, "bucket long, share long, counts binary"),
        "vectors-0",
    )
    step = 0
    while shares > 1:
        shares, step = -(-shares // FAN), step + 1
        vectors = scratch.save(
            vectors.withColumn("share", F.expr(f"share div {FAN}")).groupBy("bucket", "share")
            .applyInArrow(_sum_vectors, "bucket long, share long, counts binary"),
            f"vectors-{step}",
        )
    index = scratch.save(functions.join(vectors.drop("share"), "bucket"), "index")
    scratch.drop("counted")
    return index


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, n): every pair of ids that is linked somewhere, and its number of links."""
    return index.select("keys", "counts").mapInArrow(_spread, "a long, b long, n long")


def _align_documents(
    batches: Iterator[pa.RecordBatch], a: str, b: str, index: object, spell: bool, links: bool
) -> Iterator[pa.RecordBatch]:
    """Each document's alignment, with counts if there is an index, with its distinct links if not."""
    tokens = Tokens.get(a, b)
    for batch in batches:
        made: list[tuple] = []
        start = 0
        numbers, digest, groups, pairs = np.zeros(5, np.int64), hashlib.sha256(), [], []
        for row_of, alignment, ends in _runs(batch, tokens):
            edge = alignment.links
            counts, best = index.value.counts(alignment.pairs) if index is not None else (np.zeros(len(alignment.pairs), np.int64),) * 2
            sums = [np.diff(alignment.first_a), np.diff(alignment.first_b), np.diff(edge)]
            sums += [np.diff(np.append(0, np.cumsum(x))[edge]) for x in (best, counts)]
            each = np.column_stack(sums)
            for at, (row, text, end) in enumerate(zip(row_of, alignment.spelt(), ends)):
                if numbers[0]:
                    digest.update(b";")
                numbers += each[at]
                digest.update(text.encode())
                if spell:
                    groups.append(text)
                if links:
                    pairs.append(alignment.pairs[edge[at] : edge[at + 1]])
                if end:
                    some, times = np.unique(np.concatenate(pairs), return_counts=True) if links else ((), ())
                    told = ";".join(groups) if spell else None
                    made.append((*numbers.tolist(), told, digest.hexdigest() if numbers[0] else "", some, times))
                    numbers, digest, groups, pairs = np.zeros(5, np.int64), hashlib.sha256(), [], []
            if made:
                yield _told(batch.slice(start, len(made)), made)
                start, made = start + len(made), []


def _told(batch: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*made))
    number = [pa.array(columns[k], pa.int64()) for k in range(5)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), number[0], number[1], number[2], number[2], number[3], number[4], pa.array(columns[5], pa.string()),
         pa.array(columns[6], pa.string()), pa.array(columns[7], pa.list_(pa.int64())), pa.array(columns[8], pa.list_(pa.int64())),
         batch.column("row")],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256", "pairs", "times", "row"],
    )


_TOLD = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string, "
    "pairs array<long>, times array<long>, row long"
)


def _look_up(batches: Iterator[pa.RecordBatch], most: object) -> Iterator[pa.RecordBatch]:
    """Best links and counts of documents' pairs, summed by row as far as a run goes."""
    index = None
    for function, rows in heads_first(batches, "bits"):
        if rows is None:
            index = _one_bucket(function)
            index.most = most.value
            continue
        counts, best = index.counts(rows.column("pair").to_numpy())
        times = rows.column("n").to_numpy()
        row, back = np.unique(rows.column("row").to_numpy(), return_inverse=True)
        total, won = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        np.add.at(total, back, counts * times)
        np.add.at(won, back, best * times)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(total), pa.array(won)], names=["row", "count_sum", "n_best"])


def align_documents(
    spark: SparkSession, docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", with_groups: bool = True,
    lookup_bytes: int = LOOKUP_BYTES,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``with_groups``), groups_sha256 of each row of ``docs`` (doc_id, text, ...).

    ``a`` and ``b`` are files of a byte-level BPE of the tokenizers library and of a sentencepiece
    model.  ``groups`` is the alignment as text: ``a1,a2|b1;a3|b2,b3``.  A text that is null or
    empty, or whose ids don't give back its bytes with a space before it, has no tokens: zeros and
    an empty text.  Every row has its own result, so repeated and null doc_ids stay as they are;
    other columns are not read.  No rows give no rows.
    """
    scratch = Scratch(spark, "align")
    encoded = scratch.save(encode_documents(docs, a, b).withColumn("row", F.monotonically_increasing_id()), "encoded")
    index = build_index(encoded, scratch, a, b)
    # One number for each id of B, so its size is that of a vocabulary.
    best = {r.b: r.n for r in pair_counts(index).groupBy("b").agg(F.max("n").alias("n")).collect()}
    size = index.agg(F.sum(F.length("bits") + F.length("keys") + F.length("counts"))).first()[0] or 0
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *["groups"] * with_groups, "groups_sha256"]
    if size <= lookup_bytes:
        rows = index.orderBy("bucket").select("levels", "bits", "keys", "counts").collect()
        sent = spark.sparkContext.broadcast(Index([(r.levels, bytes(r.bits), bytes(r.keys), bytes(r.counts)) for r in rows], best))
        told = encoded.mapInArrow(
            partial(_align_documents, a=a, b=b, index=sent, spell=with_groups, links=False), _TOLD
        )
        return told.select(*columns)
    told = scratch.save(
        encoded.mapInArrow(partial(_align_documents, a=a, b=b, index=None, spell=with_groups, links=True), _TOLD), "told"
    )
    buckets = index.count()
    shares = max(1, -(-encoded.count() // (16 * SHARE)))

    def dealt(batches):
        for batch in batches:
            yield batch.append_column("bucket", pa.array(bucket_of(batch.column("pair").to_numpy(), buckets)))

    asked = told.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_link")).select(
        "row", F.col("_link.pairs").alias("pair"), F.col("_link.times").alias("n")
    ).mapInArrow(dealt, "row long, pair long, n long, bucket long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))
    past = past_heads(
        index.withColumn("share", every), asked.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(shares))), ["bucket", "share"], "bits"
    )
    most = np.zeros(max(best, default=0) + 1, np.int64)
    most[list(best)] = list(best.values())
    found = (
        past.mapInArrow(partial(_look_up, most=spark.sparkContext.broadcast(most)), "row long, count_sum long, n_best long")
        .groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    )
    zero = F.lit(0).cast("long")
    return (
        told.drop("count_sum", "n_best").join(found, "row", "left")
        .withColumns({"count_sum": F.coalesce("count_sum", zero), "n_best": F.coalesce("n_best", zero)})
        .select(*columns)
    )
