import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recollect.llm import _tokens
from recollect.llm._tokens import TAIL, UnitEncoder

TEXTS = [
    "", " ", "a", "Hello world", "  two  spaces ", "line\nbreak \n both\t\ttabs ", "don't we'll 'S it 's", "<|endoftext|> x <|startoftext|>",
    "Ünïcödé Straße ΣΊΣΥΦΟΣ Σ", "é ́x", "a b   c  d", "x\x1cy \x1c z", "\u0085 a \u0085b", "123 45a6 !!! ?!a", " lead", "trail ", "日本語 テキスト", "a" * 3000, "👍🏽 ok",
    "a<|endoftext|>", "end.<|endoftext|>.", "<|ENDOFTEXT|> <|EndOfText|>!", "\u00bfqu\u00e9 tal? \u00a1s\u00ed!", "x\u00a0y \u2003 z\u3000 w", "one\ntwo.\nThree\r\nfour\n\nfive\n", "a.) b) c!?, d... (e) 3.5 4, \u00d7. \u00e9! \u65e5.",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_equal_to_whole_texts(name, special_as_text, monkeypatch):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = special_as_text
    rnd = random.Random(3)
    alphabet = ["a", "b", "B", " ", " ", "\n", "\t", "'s", "1", "!", "\u00e9", "\u00a0", "\u00df", "word", "\u0301", "\x1c", ".", ",", ")", "<|endoftext|>", "<|ENDOFTEXT|>", "\u00bf"]
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    texts += [f"{a}{m}{n}{b}" for a in ("a", "Z", "\u00fc", "7") for m in TAIL for n in ("", *TAIL) for b in ("", " x", "\ny")]
    monkeypatch.setattr(_tokens, "REMEMBERED", 50)
    encoder = UnitEncoder(path, special_as_text)
    for i in range(0, len(texts), 7):
        for t, got in zip(texts[i : i + 7], encoder.encode_texts(texts[i : i + 7]), strict=True):
            assert got == whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert encoder.at_space and encoder.at_line and encoder.at_tail and len(encoder.key[0]) < 300


def test_special_strings_are_tokens_by_default():
    assert UnitEncoder(public_tokenizers.path("byte_bpe_50k.json")).encode_texts(["<|endoftext|> x", None, ""]) == [[50256, 2124], [], []]
    assert UnitEncoder(public_tokenizers.path("word_bpe_49k.json")).encode_texts(["<|endoftext|> x"]) == [[49407, 343]]


def test_equal_hashes_cost_only_the_memory(monkeypatch):
    monkeypatch.setattr(_tokens, "spans", lambda values, starts, ends, base: (ends - starts).astype("uint64") * 0 + (base == _tokens.BASES[1]) * values[starts])
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["abc def", "ghi jkl, mno", "abc xyz"]
    assert UnitEncoder(path).encode_texts(texts) == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
