"""Ids of parts against those of whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm.encoding import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ATOMS = [
    *"aZéßÿÀ×÷ªµº²Ⅷ09_'-.,!/@[`{~<|>&%#", *"中日ñłЖקا😀", "e\u0301", "<\u0338", "\u0301", "\u200b", "\ufe0f", "\x00", " ", " ", " ", "  ", "\n", "\n\n",
    "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "<|endoftext|>", "<|EndOfText|>",
    "the", " nation", "'s", "'LL", "n't", " word's,", "word!", "é'été", "a" * 63, "b" * 64, "c" * 300, "x-" * 40, "q" * 5000,
]


class Spy:
    """A tokenizer that notes what it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **kw):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **kw)


@pytest.mark.parametrize("path, keeps_space", [(BYTES, True), (WORDS, False)])
@pytest.mark.parametrize("limit", [0, 40, 600_000])
def test_ids_equal_those_of_whole_texts(path, keeps_space, limit):
    r = random.Random(limit)
    plain = [a for a in ATOMS if not any(c.isspace() and c not in " \n" for c in a) and "<|e" not in a.lower()]
    texts = ["".join(r.choices(plain if i % 3 else ATOMS, k=r.randrange(60))) for i in range(1500)]
    encoder = Encoder(path, "<u4", keeps_space, limit)
    got = [x for at in range(0, len(texts), 50) for x in encoder.encode(texts[at : at + 50])]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == want


def test_a_word_is_encoded_once_whatever_follows_it():
    encoder = Encoder(BYTES, "<u2", True)
    encoder.encode(["An ostrelble andthehaon"])
    encoder.tokenizer = spy = Spy(encoder.tokenizer)
    text = "An ostrelble, andthehaon. ostrelble&&& andthehaon's"
    assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == spy.tokenizer.encode(text, add_special_tokens=False).ids
    assert spy.given and not any("ostrelble" in t or "andthehaon" in t for t in spy.given)


def test_odd_characters_behind_known_words():
    encoder = Encoder(BYTES, "<u2", True)
    for text in ("known words here", "known words\there", "known words here<|ENDOFTEXT|>", "known words here<|endoftext|> known", "known\xa0words here", "known words here"):
        assert np.frombuffer(encoder.encode(["known", text])[1], "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
