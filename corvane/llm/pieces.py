"""Whole-text token ids through the tokenizers library, with a cache of pieces.

Both vocabularies used here split a text into pre-tokens before they merge. A text is cut only where a
pre-token surely ends and the next one can't depend on what is before it: before a single white space
between two other characters, and between a Latin letter and an ASCII mark. The cuts of many texts
are found at once on their bytes, Arrow's dictionary encoding leaves the distinct pieces, the library
encodes those that the worker's cache lacks, and one gather puts the ids of all texts together. The ids
equal those of encoding each whole text (tested). Texts that hold a special token's string go to the
library whole.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters that both splitting patterns and lower-casing treat alike in every Unicode version.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
WINDOW = 2 << 20  # bytes cut at once
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True  # all but the apostrophe
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE_LEAD = np.zeros(256, bool)  # first bytes of white space beyond ASCII (and of other characters)
_SPACE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def cuts(a: np.ndarray, starts: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes ``a`` of texts that start at ``starts``; ``space`` marks bytes that may open a piece."""
    n = len(a)
    at = np.flatnonzero(space[a])
    at = at[(at > 0) & (at < n - 1)]
    before, after = a[at - 1], a[at + 1]
    ok = (before > 32) & (after > 32) & ~_SPACE_LEAD[after]
    ok &= ~((before >= 0x80) & ((a[np.maximum(at - 2, 0)] == 0xC2) | _SPACE_LEAD[a[np.maximum(at - 3, 0)]]))
    at = at[ok]
    marks = np.flatnonzero(_MARK[a])
    marks = marks[marks > 0]
    left, lead = a[marks - 1], a[np.maximum(marks - 2, 0)]
    latin = (left >= 0x80) & (lead == 0xC3) & (left != 0x97) & (left != 0xB7)
    marks = marks[_ASCII_LETTER[left] | latin]
    first = np.zeros(n + 1, bool)
    first[at] = True
    first[at[a[at] == 10] + 1] = True  # a line break is a pre-token of its own, or dropped
    first[marks] = True
    # a white space that opens or closes a text is no cut, whatever stands in the text beside it
    edge = starts[(starts > 0) & (starts < n)]
    first[edge - 1] &= ~space[a[edge - 1]]
    first[edge] = True
    first[0] = n > 0
    return np.flatnonzero(first[:n])


def as_bytes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts, a null one as empty, their UTF-8 bytes one after the other, and the edges between them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return texts, np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return texts, np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]


class PieceEncoder:
    """``kind`` is "byte" (byte-level BPE, spaces belong to the next word) or "word" (lower-cased words, white space dropped).

    With ``specials`` a special token's string in a text becomes that token, as in a plain call of the
    library; without, it is ordinary text. ``limit`` bounds the cache: two generations of so many pieces.
    """

    def __init__(self, path: str, kind: str, limit: int = 150_000, longest: int = 48, specials: bool = True):
        from tokenizers import Tokenizer, normalizers
        from tokenizers.pre_tokenizers import ByteLevel, Split

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not specials
        self.kind, self.limit, self.longest = kind, limit, longest
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()] if specials else []
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.space = np.zeros(256, bool)
        self.space[[32, 10] if kind == "byte" else [9, 10, 13, 32]] = True
        #: The character that stands for each UTF-8 byte in the vocabularies; a line break stays, to part words.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        shown = [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]
        assert set(shown) == set(ByteLevel.alphabet())
        self.shown = np.array([10 if b == 10 else ord(c) for b, c in enumerate(shown)], "<u4")
        #: The library's merges over words that are parted by line breaks, without its normalizer and splitting pattern.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer, self.words.pre_tokenizer = normalizers.Sequence([]), Split("\n", "removed")
        end = self.tok.model.end_of_word_suffix or "\n"
        vocabulary = self.tok.get_vocab()
        self.chars = np.zeros(max(vocabulary.values()) + 1, np.int64)  # characters that each token stands for
        for token, i in vocabulary.items():
            self.chars[i] = len(token.removesuffix(end))

    def _plain(self, texts: Sequence[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of one pre-token each."""
        joined = np.frombuffer("\n".join(words).encode(), np.uint8)
        found = np.array(self.words.encode_batch_fast([self.shown[joined].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
        breaks = np.flatnonzero(joined == 10)
        ends = np.append(breaks, len(joined)) - np.arange(len(words))  # of each word, by the characters before it
        at = np.searchsorted(np.cumsum(self.chars[found]), ends) + 1
        flat = found.tobytes()
        return [flat[s:e] for s, e in zip([0, *(4 * at[:-1]).tolist()], (4 * at).tolist(), strict=True)]

    def _learn(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces that the cache lacks; all but the long ones are kept."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        out: list[bytes] = [b""] * len(keys)
        byte, new, old = self.kind == "byte", self.new, self.old
        at, words, rest = [], [], []
        for i, k in enumerate(keys):
            got = old.get(k)
            if got is not None:
                out[i] = new[k] = got
                continue
            lead = k[:1] in (" ", "\n", "\t", "\r")
            word = k[1:] if lead else k
            if word and len(k) <= self.longest and (word.isalpha() if word.isascii() else _WORD.fullmatch(word)) and (not byte or not lead or k[0] == " "):
                at.append(i)
                words.append(k if byte else word.lower())
            else:
                rest.append(i)
        for s in range(0, len(at), 4096):
            block = at[s : s + 4096]
            for i, got in zip(block, self._words(words[s : s + 4096]), strict=True):
                out[i] = new[keys[i]] = got
        for s in range(0, len(rest), 4096):
            block = rest[s : s + 4096]
            for i, got in zip(block, self._plain([keys[i] for i in block]), strict=True):
                out[i] = got
                if len(keys[i]) <= self.longest:
                    new[keys[i]] = got
        return out

    def look_up(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces, each as little-endian unsigned 32-bit integers."""
        got = list(map(self.new.get, keys))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            for i, x in zip(missing, self._learn([keys[i] for i in missing]), strict=True):
                got[i] = x
        return got

    def pieces(self, data: np.ndarray, edges: np.ndarray) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray]:
        """Of the texts in ``data``, which lie between ``edges``: distinct pieces, their ids, which piece comes where, and the texts' edges among the pieces."""
        if not len(data):
            return [], [], np.zeros(0, np.int32), np.zeros(len(edges), np.int64)
        starts = cuts(data, edges[:-1], self.space)
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return keys, self.look_up(keys), coded.indices.to_numpy(), np.searchsorted(starts, edges)

    def _window(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data``, which lie between ``edges``, and the edges among the ids."""
        _, ids, which, at = self.pieces(data, edges)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[which]
        total = np.cumsum(n)
        place = np.repeat(begin[which] - (total - n), n)
        place += np.arange(len(place))
        return flat[place], np.concatenate([[0], total])[at]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text, window by window, cut where a piece starts."""
        out, at = [], 0
        while at < len(data):
            end = min(at + WINDOW, len(data))
            while end < len(data):  # the last piece of the window may go on behind it
                last = int(cuts(data[at:end], np.zeros(1, np.int64), self.space)[-1])
                if last > 0:
                    end = at + last
                    break
                end = min(end + WINDOW, len(data))
            out.append(self._window(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def ids(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of texts: the first one's place, all ids one after the other, and the edges between texts."""
        texts, data, offsets = as_bytes(texts)
        n = len(texts)
        whole = np.zeros(n, bool)  # texts with a special token's string
        for s in self.specials:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole_at = np.flatnonzero(whole).tolist()
        stops = sorted({n, *whole_at, *[i + 1 for i in whole_at]})
        at = 0
        while at < n:
            stop = stops[int(np.searchsorted(stops, at, "right"))]
            stop = min(stop, max(at + 1, int(np.searchsorted(offsets, offsets[at] + WINDOW, "right")) - 1))
            part = data[offsets[at] : offsets[stop]]
            if whole[at]:
                found = np.array(self.tok.encode(texts[at].as_py(), add_special_tokens=False).ids, np.uint32)
                yield at, found, np.array([0, len(found)])
            elif stop == at + 1 and len(part) > WINDOW:
                found = self._long(part)
                yield at, found, np.array([0, len(found)])
            else:
                yield at, *self._window(part, offsets[at : stop + 1] - offsets[at])
            at = stop

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers; a null text has none."""
        out: list[bytes] = []
        for _, found, edges in self.ids(pa.array(texts, pa.large_string())):
            out += [found[s:e].tobytes() for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return out

    def counts(self, pieces: Sequence[str]) -> list[int]:
        """Number of tokens of each pre-token, in the order given."""
        return [len(x) >> 2 for x in self.look_up(pieces)]


def with_end(found: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` behind the ids of each text."""
    return np.insert(found, edges[1:], np.uint32(end_id)), edges + np.arange(len(edges))


_MADE: dict[tuple[str, str, bool], PieceEncoder] = {}


def encoder(path: str, kind: str, specials: bool = True) -> PieceEncoder:
    """One per Python worker."""
    if (path, kind, specials) not in _MADE:
        _MADE[path, kind, specials] = PieceEncoder(path, kind, specials=specials)
    return _MADE[path, kind, specials]


def crc(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids)
