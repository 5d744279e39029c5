"""Ids from cached pieces against encoding whole texts."""

import numpy as np
import pytest

from almanac.llm.common import public_tokenizer
from almanac.llm.tokens import Encoder

TEXTS = [
    "", " ", "a", "A  b\n\n c\t\td ", "it's we'll 'sly'S x'y' ''s d'd,'re", "thea, Thea. (thea) thea!!$$$ th-ea a_b 12,5 1a2b",
    "Café ÀÉÎ straße İstanbul ŉ ª º ǅ ǆ ﬁ ΑΣ ας e\u0301 o\u0308. x\u0338 >\u0338", "日本語のテキスト 123 ①② ½ \U0001f600 ok\U0001f600.",
    "a\u00a0b\u2003c\u3000d\x85e\x1cf\x1fg \u200b h", "<|endoftext|> <|startoftext|>x", "word" * 3000, "x " * 2000, "\n\n\nline\n \n  end  ", "' '' ''' don't DON'T", "naïve, NAÏVE; ÆØÅ! ñandú:",
    "\r\n\r\n a\r b", "tail...   ", "…—–“quoted”", "�\ufeffbom", "a'b,c'd.e", "é, è. ê;x",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_ids_as_whole_texts(name):
    enc = Encoder(public_tokenizer(name), limit=50)
    rng = np.random.default_rng(3)
    letters = list("abcdeéßñÄst'.,!$ \n\tIX19_-")
    texts = TEXTS + ["".join(rng.choice(letters, n)) for n in rng.integers(1, 400, 300)]
    whole = [np.array(x.ids, dtype="<u4").tobytes() for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 20):
        assert enc.encode(texts[i : i + 20]) == whole[i : i + 20]
    assert enc.encode(texts) == whole
