"""Chunk-wise token ids against whole-text encoding, character by character."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scorespark.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, tokenizer_path


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_every_latin_letter(name):
    enc, whole = Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    for c in map(chr, range(0x21, 0x180)):
        for word in (c, c + "stanbul", f"a{c}b", f"ab{c}.", c + c):
            got, want = enc.ids("x " + word), whole.encode("x " + word, add_special_tokens=False).ids
            assert got.tolist() == want, word


PARTS = [
    "İstanbul", "a", "B.", "don't", "'s", " ", "  ", "\n", "\n\n", " \n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "é", "e\u0301", "\u0301", "\x85", "\u3000",
    "\x1c", "12,5", "日本", "Σίσυφος", "ſ", "ß", "ŉ", "word", "Word:", "|", "\t", "\r\n", "👩‍👩‍👧", "ǅ", "\xa0", "<|", "|>", "'", "foo.bar", "naïveα", "x'll", "\x00", "_", "K", "long" * 30,
]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_any_text(name):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + [None, "", "\n", "\nx", "x\n"]
    enc, whole = Encoder(tokenizer_path(name), cache_size=50), Tokenizer.from_file(tokenizer_path(name))
    got = list(enc.each(pa.array(texts, pa.string())))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)
