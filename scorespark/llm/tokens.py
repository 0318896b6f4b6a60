"""Token ids of whole texts by the tokenizers library, equal to
``Tokenizer.encode(text, add_special_tokens=False).ids``.

A column of texts is split at blanks and line ends, and each distinct piece is encoded once; words
of up to ``SHORT`` characters stay in a cache of the worker. That is sound because no
pre-token of the tokenizers used here crosses such a border: word BPE drops white
space, and byte BPE joins a single blank to the word after it, so a piece keeps the blank
before it. Texts where that doesn't hold (runs of white space, which byte BPE takes
together, and strings of special tokens among them) are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Cache

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Longer words are not cached.
SHORT = 48
#: Texts are encoded together up to about so many bytes.
PORTION = 6_000_000
#: A run of Latin letters (but for capital dotted I, whose lower case is two characters)
#: before one of the marks or the piece's end is one pre-token.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-įı-ſ]+")
_MARKS = ".,!?;:%$#&*|"
_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]
_WHITE_RUN = r"[\t-\r\x1c-\x20\x{85}\p{Z}]{2}"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_table() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest
    for characters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids as unsigned 32-bit integers."""

    def __init__(self, path: str, cache_size: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.byte_level = self.tok.normalizer is None
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model, self.table = self.tok.model, _byte_table()
        self.cache = Cache(self._word, cache_size)
        self.marks = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a word that is one pre-token; None of any other."""
        blank = word[:1] == " "
        letters = word[1:] if blank else word
        if letters.isascii() and letters.isalpha():  # these bytes stand for themselves
            word = self.table[32] + letters if blank else word
        elif _PLAIN.fullmatch(word):
            word = word.encode("utf-8").decode("latin-1").translate(self.table)
        else:
            return None if word else b""
        ids = [t.id for t in self.model.tokenize(word)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """A word and the marks after it, which are a pre-token of their own."""
        word = piece.rstrip(_MARKS)
        key = word if self.byte_level else word.lower()
        ids = self.cache[key] if len(key) <= SHORT else self._word(key)
        if ids is None:
            return self._whole(piece)
        if len(word) == len(piece):
            return ids
        after = piece[len(word) :]
        if after not in self.marks:
            if len(after) > 4:
                return ids + self._whole(after)
            self.marks[after] = self._whole(after)
        return ids + self.marks[after]

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all the texts, and how many each has."""
        if self.byte_level:
            # a piece that follows no blank is marked by a line end: those at a line's
            # start, and, with a line end that doesn't count, the first of a text
            texts = pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = pc.dictionary_encode(split.flatten())
        code, known = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.byte_level:
            line = self._whole("\n")
            made = [line + self._piece(p[1:]) if p[:1] == "\n" else self._piece(" " + p) for p in known]
        else:
            made = list(map(self._piece, known))
        size = np.fromiter(map(len, made), np.int32, len(made)) >> 2
        begin = np.cumsum(size, dtype=np.int32) - size
        pool = np.frombuffer(b"".join(made), "<u4")
        begin, size = begin[code], size[code]
        if self.byte_level:
            begin[first[:-1]] += len(line) >> 2
            size[first[:-1]] -= len(line) >> 2
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
        at = np.repeat(begin - ends[:-1], size)
        at += np.arange(ends[-1], dtype=np.int32)
        self.cache.trim()
        return pool[at], np.diff(ends[first])

    def columns(self, texts: pa.Array):
        """Yields (flat ids, ids in each text) of portions of a column of texts, in order;
        null counts as empty."""
        texts = pc.fill_null(texts, "")
        long = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        odd = pc.match_substring_regex(texts, "|".join(map(re.escape, self.special))) if self.special else pa.array(np.zeros(len(texts), bool))
        if self.byte_level:
            odd = pc.or_(odd, pc.match_substring_regex(texts, _WHITE_RUN))
        odd = odd.to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(long, (long[at - 1] if at else 0) + PORTION, side="right")))
            part, whole = texts.slice(at, to - at), odd[at:to]
            if not whole.any():
                yield self._together(part)
            else:
                flat, sizes = self._together(pc.if_else(pa.array(whole), pa.scalar("", part.type), part))
                by_text = np.split(flat, np.cumsum(sizes)[:-1])
                for i in np.flatnonzero(whole):
                    by_text[i] = np.frombuffer(self._whole(part[int(i)].as_py()), "<u4")
                yield np.concatenate(by_text), np.array([len(x) for x in by_text], dtype=np.int64)
            at = to

    def each(self, texts: pa.Array):
        """Yields the ids of each text."""
        for flat, sizes in self.columns(texts):
            at = 0
            for n in sizes.tolist():
                yield flat[at : at + n]
                at += n

    def ids(self, text: str) -> np.ndarray:
        return next(self.each(pa.array([text], pa.string())))


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker process; it survives from task to task."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
