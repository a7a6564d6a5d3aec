"""Canonical length-limited Huffman code: lengths, encoder, checkpointed block decoder (numpy)."""

from __future__ import annotations

import numpy as np

#: Longest code in bits; the decoding table has 2^LIMIT entries.
LIMIT = 18
#: Ids between two checkpoints (bit offsets) of a block.
STRIDE = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each id from its count (0: no code), at most ``limit``, by package-merge.

    Coins are kept as sorted weights; a list's packages pair up neighbours, and the ids' coins
    among the chosen ones of each list are a prefix of the ids in order of count.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no code of at most {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.int64)
    leaf_lists, current = [], weight
    is_leaf = np.ones(len(weight), bool)
    leaf_lists.append(is_leaf)
    for _ in range(limit - 1):
        even = current[: len(current) // 2 * 2]
        packages = even[0::2] + even[1::2]
        merged = np.concatenate([weight, packages])
        flags = np.concatenate([np.ones(len(weight), bool), np.zeros(len(packages), bool)])
        sort = np.argsort(merged, kind="stable")
        current, is_leaf = merged[sort], flags[sort]
        leaf_lists.append(is_leaf)
    take = 2 * len(order) - 2
    for flags in reversed(leaf_lists):
        leaves = int(flags[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


class Codebook:
    """Canonical codes: shorter first, then smaller ids; the lengths alone define them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.flatnonzero(lengths)
        order = order[np.lexsort((order, lengths[order]))]
        self.codes = np.zeros(len(lengths), np.uint64)
        self.top = int(lengths.max()) if len(order) else 1
        table = np.zeros(1 << self.top, np.uint32)
        spans = np.left_shift(np.int64(1), self.top - self.lengths[order])
        starts = np.cumsum(spans) - spans
        self.codes[order] = (starts >> (self.top - self.lengths[order])).astype(np.uint64)
        # An entry is id * 32 + length; windows of `top` bits index it.
        filled = np.repeat((order.astype(np.uint32) << np.uint32(5)) | self.lengths[order].astype(np.uint32), spans)
        table[: len(filled)] = filled
        self.table = table

    def encode(self, ids: np.ndarray) -> tuple[bytes, int, np.ndarray]:
        """(bits packed from the most significant, their number, checkpoints every STRIDE ids)."""
        size = self.lengths[ids]
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        bits, at = int(at[-1]), at[:-1]
        words = np.zeros((bits + 31) // 32 + 2, np.uint64)
        # A code touches at most two 32-bit words; the codes' bits are disjoint, so adding joins them.
        shifted = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        if len(ids):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return words[:-2].astype(">u4").tobytes(), bits, at[::STRIDE].astype(np.int64)

    def decode(self, payload: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """All ids of a block."""
        return self.decode_blocks([(payload, n, checkpoints)])[0]

    def decode_blocks(self, blocks: list[tuple[bytes, int, np.ndarray]]) -> list[np.ndarray]:
        """All ids of each block (payload, number of ids, checkpoints): every checkpoint starts a lane, and all lanes step together."""
        words, starts, counts, base = [], [], [], 0
        for payload, n, checkpoints in blocks:
            mine = np.frombuffer(payload, ">u4").astype(np.uint64)
            words += [mine, np.zeros(2, np.uint64)]  # a window may reach past the end
            starts.append(np.asarray(checkpoints, np.int64) + 32 * base)
            lanes = np.full(len(checkpoints), STRIDE, np.int64)
            if len(lanes):
                lanes[-1] = n - (len(lanes) - 1) * STRIDE
            counts.append(lanes)
            base += len(mine) + 2
        joined = np.concatenate(words + [np.zeros(2, np.uint64)])
        pairs = (joined[:-1] << np.uint64(32)) | joined[1:]
        at, lanes = np.concatenate(starts + [np.zeros(0, np.int64)]), np.concatenate(counts + [np.zeros(0, np.int64)])
        out = np.zeros((len(at), STRIDE), np.uint32)
        left, mask = 64 - self.top, np.uint64((1 << self.top) - 1)
        live, shortest = np.arange(len(at)), int(lanes.min(initial=STRIDE))
        for step in range(int(lanes.max(initial=0))):
            if step >= shortest:
                live = live[lanes[live] > step]
            here = at[live]
            window = (pairs[here >> 5] >> (left - (here & 31)).astype(np.uint64)) & mask
            entry = self.table[window]
            out[live, step] = entry >> np.uint32(5)
            at[live] = here + (entry & np.uint32(31))
        edges = np.cumsum([0] + [len(c) for c in counts])
        return [out[low:high].reshape(-1)[:n] for low, high, (_, n, _) in zip(edges, edges[1:], blocks)]
