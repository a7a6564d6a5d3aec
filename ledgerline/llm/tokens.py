"""Token ids of whole texts by a public tokenizer file, as packed little-endian 16-bit ids.

Both vocabularies in use have fewer than 65,536 ids.  A text is cut at white space into pieces
whose ids don't depend on what stands around them, and the ids of frequent pieces come from a
cache.  The cache has a bound and drops no work: a piece that isn't in it goes to the tokenizer.
Texts where a cut could change the ids go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter

import numpy as np

from ledgerline.llm.common import CACHES

#: Pieces in the small first cache, and in the large second one (about 200 bytes each).
FRONT, BACK = 1 << 15, 1_500_000
#: Longer pieces aren't cached.
LONGEST = 64

#: Pieces of letters whose normal form is their lower case and which byte-level splitting keeps whole.
_LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u01c3]+")
_ODD = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\x00]")
_RUNS = [a + b + c for a in " \n" for b in " \n" for c in " \n"]
_ENDS = tuple(a + b for a in " \n" for b in " \n")
_made: dict[str, PieceTokenizer] = {}
CACHES.append(_made)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; the default of the operators' path parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.norm, self.pre = self.whole.model, self.whole.normalizer, self.whole.pre_tokenizer
        # Whether a space belongs to the ids of the word after it, or white space has no ids.
        self.spaced = bool(self.encode_whole(" "))
        self.table = self._byte_characters()
        self.front: dict[str, bytes] = {}
        self.back: dict[str, bytes] = {}

    @classmethod
    def get(cls, path: str) -> PieceTokenizer:
        """One instance for each Python worker, kept over tasks."""
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def _byte_characters(self) -> dict[int, str] | None:
        """The character that stands for each byte of a letter, if the steps for letters are lower case and these; None if not."""
        lead = " " if self.spaced else ""
        letters = [chr(c) for c in range(32, 0x1C4) if _LETTERS.fullmatch(chr(c)) and chr(c) != " "]
        table: dict[int, str] = {}
        for c in letters:
            text = lead + c
            words = self.pre.pre_tokenize_str(self.norm.normalize_str(text) if self.norm is not None else text)
            raw = (lead + c.lower() if self.norm is not None else text).encode()
            if len(words) != 1 or len(words[0][0]) != len(raw):
                return None
            for byte, stands in zip(raw, words[0][0]):
                if table.setdefault(byte, stands) != stands:
                    return None
        return table

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        """The tokenizer's own steps for one piece: normalise, split, look up merges."""
        if len(piece) > LONGEST or "<|" in piece or not piece.isprintable():
            return self.encode_whole(piece)
        if self.table is not None and _LETTERS.fullmatch(piece):
            raw = (piece.lower() if self.norm is not None else piece).encode().decode("latin-1")
            return array("H", [t.id for t in self.model.tokenize(raw.translate(self.table))]).tobytes()
        text = self.norm.normalize_str(piece) if self.norm is not None and not (piece.isascii() and piece.islower()) else piece
        if text.isascii() and text.isalpha() and not self.spaced:
            return np.array([t.id for t in self.model.tokenize(text)], dtype="<u2").tobytes()
        ids: list[int] = []
        for word, _ in self.pre.pre_tokenize_str(text):
            ids += [t.id for t in self.model.tokenize(word)]
        return np.array(ids, dtype="<u2").tobytes()

    def _miss(self, piece: str) -> bytes:
        found = self.back.get(piece)
        if found is not None:
            return found
        stem = piece[:-1]
        if piece[-1:] in (",", ".") and stem[-1:].isalpha() and stem[-1:].isascii():
            known = self.back.get(stem)
            if known is None and stem in self.front:
                known = self.front[stem]
            if known is None:
                known = self._keep(stem, self._piece(stem))
            mark = self.front.get(piece[-1])
            if mark is None:
                mark = self.front[piece[-1]] = self._piece(piece[-1])
            return known + mark
        return self._keep(piece, self._piece(piece))

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= LONGEST and len(self.back) < BACK:
            self.back[piece] = ids
        return ids

    def _pieces(self, text: str) -> list[str] | None:
        if "<|" in text or _ODD.search(text):
            return None
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        if text.endswith(_ENDS) or any(run in text for run in _RUNS):
            return None
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def encode(self, text: str | None) -> bytes:
        """All ids of the text, two bytes each, without special ones added; null is empty."""
        if not text:
            return b""
        pieces = self._pieces(text)
        if pieces is None:
            return self.encode_whole(text)
        if len(self.front) < FRONT:
            common = Counter(pieces)
            common.pop("", None)
            for piece in common:
                if piece not in self.front and len(piece) <= LONGEST:
                    self.front[piece] = self._miss(piece)
            self.front[""] = b""
        found = list(map(self.front.get, pieces))
        if None in found:
            miss = self._miss
            found = [miss(p) if f is None else f for p, f in zip(pieces, found)]
        return b"".join(found)
