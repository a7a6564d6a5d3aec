"""Plain, slow versions of the corpus operators."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def jaccard_groups(texts, width, percent):
    """(set sizes, root of each text's component)."""
    sets = [shingle_set(t, width) for t in texts]
    links = []
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    return [len(s) for s in sets], roots(len(sets), links)


def repeats(ordered_texts, depth=100):
    """(bytes, removed, spans, sha256 of the rest) of texts in order."""
    seen, out = set(), []
    for text in ordered_texts:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - depth + 1):
            piece = raw[k : k + depth]
            if piece in seen:
                gone[k : k + depth] = True
            else:
                seen.add(piece)
        spans = int((gone[1:] < gone[:-1]).sum())
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone[:-1].sum()) if len(raw) else 0, spans, hashlib.sha256(rest).hexdigest()))
    return out


def kept_bytes(ordered_texts, depth=100):
    """The bytes that stay of texts in order."""
    seen, out = set(), []
    for text in ordered_texts:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - depth + 1):
            if raw[k : k + depth] in seen:
                gone[k : k + depth] = [True] * depth
            seen.add(raw[k : k + depth])
        out.append(bytes(b for b, g in zip(raw, gone) if not g))
    return out


def tokens(path, texts, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [e.ids + [end] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def targets(sizes, weights=(5, 2, 1), limit=3):
    """Water filling by bisection over sources in order; sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total = sum(sizes.values())
    low, high = 0.0, float(total) * limit + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(w[s] * mid, limit * sizes[s]) for s in sizes) < total:
            low = mid
        else:
            high = mid
    return {s: min(w[s] * high, limit * sizes[s]) for s in sizes}


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def alignments(path_a, path_b, texts):
    """Per text: (ids of A, ids of B, groups as text, linked pairs), from whole texts by both tokenizers."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    chars = [c for c in range(256) if chr(c).isprintable() and c not in (32, 160, 173)]
    table = {chr(c): c for c in chars}
    for k, c in enumerate(c for c in range(256) if c not in chars):
        table[chr(256 + k)] = c
    out = []
    for text in texts:
        want = (" " + (text or "")).encode()
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw_a = [bytes(table[c] for c in a.id_to_token(k)) for k in x]
        raw_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            out.append(([], [], "", []))
            continue
        ends_a, ends_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, x[i:m])) + "|" + ",".join(map(str, y[j:n])))
            links.append((x[m - 1], y[n - 1]))
            i, j = m, n
        out.append((x, y, ";".join(groups), links))
    return out
