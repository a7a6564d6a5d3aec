"""Word and shingle hashes of whole texts, computed on UTF-8 bytes with numpy.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z.  A word's hash is a
polynomial over its bytes modulo 2^64, taken from one running sum, then mixed; no word becomes
a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text handled in one numpy pass; a longer text makes a pass of its own.
CHUNK = 1 << 20

_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is not None and len(_powers[0]) >= n:
        return _powers
    up = np.full(n, _BASE, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    tables = np.cumprod(up), np.cumprod(down)
    if n <= 4 * CHUNK:
        _powers = tables
    return tables


def text_chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about CHUNK bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        texts, kind = texts.cast(pa.large_binary()), np.int64
    else:
        texts, kind = texts.cast(pa.binary()), np.int32
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Bytes that separate words, and the larger set in which all ASCII but letters and digits does.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in row order, and each row's first word (one more entry ends it).

    A long text is hashed in parts that end where a word does: a word's hash depends on its bytes only.
    """
    if len(offsets) == 2 and len(raw) > 2 * CHUNK:
        parts, at = [], 0
        while at < len(raw):
            end = at + CHUNK
            while end < len(raw):  # to the next byte between words
                gap = np.flatnonzero(between[raw[end : end + CHUNK]])
                if len(gap):
                    end += int(gap[0])
                    break
                end += CHUNK
            end = min(end, len(raw))
            parts.append(_word_hashes(raw[at:end], np.array([0, end - at]), between)[0])
            at = end
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    return _word_hashes(raw, offsets, between)


def _word_hashes(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = between[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    lower = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    up, down = _power_table(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[lower] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    acc = mix(parts[0] + _U(len(parts)))
    for part in parts[1:]:
        acc = mix(acc * _U(0xC2B2AE3D27D4EB4F) + part)
    return acc


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in row order and each row's first one.

    A row with fewer words than ``width`` has one shingle of all its words; without words, none.
    """
    counts = np.diff(firsts)
    if len(counts) == 1 and counts[0] >= width:  # a long text by itself: no need to place its runs among others
        run = _fold([hashes[j : len(hashes) - width + 1 + j] for j in range(width)])
        return run, np.array([0, len(run)])
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_first = np.zeros(len(firsts), np.int64)
    np.cumsum(made, out=out_first[1:])
    out = np.empty(out_first[-1], np.uint64)
    if len(hashes) >= width:
        run = _fold([hashes[j : len(hashes) - width + 1 + j] for j in range(width)])
        full = counts >= width
        where = np.repeat(firsts[:-1][full] - out_first[:-1][full], made[full])
        at = np.concatenate([np.zeros(0, np.int64)] + [np.arange(out_first[-1])[np.repeat(full, made)]])
        out[at] = run[at + where]
    for k in range(1, width):
        rows = np.flatnonzero(counts == k)
        if len(rows):
            out[out_first[rows]] = _fold([hashes[firsts[rows] + j] for j in range(k)])
    return out, out_first
