"""Token ids of texts by the tokenizers library.

The pre-tokenizers in use end a piece wherever white space follows something else and wherever an
ASCII letter meets an ASCII mark or digit (but behind an apostrophe), and keep no state across these places.  So a
text is cut there, and its ids are those of its chunks in a row.  Each distinct chunk is encoded once a
worker; texts with characters for which this does not hold, or with a string of the vocabulary's added
tokens (such as <|endoftext|>, an id of its own), are encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import LOWER, SPACE, buffer_of, byte_set

#: White space of the pre-tokenizers' patterns beyond ASCII, and marks that a normalizer may join with the letter before.
WHOLE = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{300}-\\x{36F}]"
LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
MARK = byte_set((0x21, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Marks behind which a letter may belong to the same piece.
APOSTROPHE = byte_set((0x27, 0x27))
#: Distinct chunks that a worker remembers; beyond that it starts anew.
REMEMBERED = 600_000
#: Chunks given to the library in one call.
CALL = 20_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 6 << 20


class Encoder:
    """The ids of chunk k are ids[ends[k]:ends[k + 1]]; chunk 0 is the end of a text.

    With added, strings of added tokens get the ids of these, as the library does it by default; without, those of plain text."""

    def __init__(self, path: str, end: int, remembered: int = REMEMBERED, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        strings = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.whole = "|".join([WHOLE, *(f"(?i:{x})" for x in strings)])
        self.end, self.remembered = end, remembered
        # White space before a piece and the case of ASCII letters matter only if the library keeps them.
        same = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in (" Az", "az")]
        self.plain = same[0] == same[1]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 1
        self.ids = np.full(1 << 20, self.end, dtype=np.uint32)
        self.ends = np.zeros(1 << 18, dtype=np.int32)
        self.ends[1] = 1

    def _learn(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), CALL):
            part = chunks[at : at + CALL]
            made = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(part))
            n = len(self.known) + 1
            while self.used + len(made.ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(part) >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.ids[self.used : self.used + len(made.ids)] = made.ids
            self.ends[n + 1 : n + 1 + len(part)] = self.used + np.cumsum(counts)
            self.used += len(made.ids)
            self.known.update(zip(part, range(n, n + len(part)), strict=True))

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts and where each text's start."""
        buf, offsets = buffer_of(texts)
        n = len(buf)
        space, letter, mark = SPACE[buf], LETTER[buf], MARK[buf]
        cut = np.zeros(n + 1, dtype=bool)
        if n:
            cut[1:-1] = (~space[:-1] & space[1:]) | (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:] & ~APOSTROPHE[buf[:-1]])
            if self.plain:
                cut[1:-1] |= space[:-1] & ~space[1:]
        cut[offsets] = True
        cut[-1] = False
        at = np.flatnonzero(cut)
        first = np.searchsorted(at, offsets)
        if self.plain:
            buf = LOWER[buf]
            kept = ~space[at]
            ends = np.append(at[1:], n)
            keep = np.zeros(len(at) + 1, dtype=np.int64)
            np.cumsum(kept, out=keep[1:])
            first = keep[first]
            # Chunks of white space have no ids: the bytes of the others are moved together.
            buf = buf[~space]
            bounds = np.append(0, np.cumsum((ends - at)[kept])).astype(np.int32)
        else:
            bounds = np.append(at, n).astype(np.int32)
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))), first

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, with the end id after each, and their offsets; nulls are empty."""
        texts = pc.fill_null(texts, "")
        whole = np.asarray(pc.match_substring_regex(texts, self.whole))
        odd = texts.filter(pa.array(whole)).to_pylist()
        if odd:
            texts = pc.if_else(pa.array(whole), "", texts)
        chunks, first = self._chunks(texts)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.remembered:
            self._forget()
        known = self.known
        self._learn([c for c in distinct if c not in known])
        place = np.fromiter(map(known.__getitem__, distinct), dtype=np.int32, count=len(distinct))
        codes = np.insert(place[np.asarray(coded.indices)], first[1:], 0)
        first = first + np.arange(len(first))
        lists = pa.ListArray.from_arrays(pa.array(self.ends[: len(known) + 2]), pa.array(self.ids[: self.used])).take(pa.array(codes))
        ids, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64)[first]
        if odd:
            parts = [ids[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            for d, text in zip(np.flatnonzero(whole), odd, strict=True):
                parts[d] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end], dtype=np.uint32)
            ids, offsets = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, offsets


@lru_cache(maxsize=2)
def encoder(path: str, end: int, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, end, remembered, added=True)


def public_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
