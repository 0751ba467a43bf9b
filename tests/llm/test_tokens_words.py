"""New words of operator 2 go through the library joined, and come out as each by itself."""

import random

import public_tokenizers

from palisade.llm import op2_tokens as op2


class Counted:
    def __init__(self, tok):
        self.tok, self.sequences = tok, 0

    def encode_batch_fast(self, texts, **more):
        self.sequences += len(texts)
        return self.tok.encode_batch_fast(texts, **more)


def test_new_words_are_encoded_together():
    enc, rng = op2.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    whole, enc.tok = enc.tok, Counted(enc.tok)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzÀÖØöøÿéßABC") for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    texts = ["x" + "".join(" " + w for w in words[lo:lo + 60]) for lo in range(0, 6000, 60)]
    texts += [" I'll it's 'd", "a  b\n c", " don't Ġa ĠĠ Ġ", " " + "a" * 3000 + " b", "日本 x y", " <|endoftext|> q", "\u00aa \u00b5 \u00d7 a"]
    for _ in range(2):
        got = enc(texts)
        assert got == [op2.array("I", e.ids).tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert enc.tok.sequences < 100  # one a word before
