import random

import public_tokenizers
import pytest
import tokenizers

from graphloom.llm.bpe import Vocabulary

TEXTS = ["", "  ", " a  b\n\n c", "Hello <|endoftext|> World's don't", "ΑΣ ΟΔΟΣ", "İstanbul é é", "x" * 3000, "\x1c a\x1db \x85 c d", "12345 ½ ²", "日本語 テスト!!??", "<|startoftext|><|endoftext|>x", "tab\t\tq  "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_like_the_library(name):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("abAB ''\n\t  éÉßΣσς0١½́ \x1cİ!?.<|>日") for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    v, lib = Vocabulary.load(public_tokenizers.path(name)), tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [v.encode(t) for t in texts] == want
    assert list(v.encode_all(texts)) == want
    assert [v.decode(x) for x in want] == [lib.decode(x, skip_special_tokens=False) for x in want]
