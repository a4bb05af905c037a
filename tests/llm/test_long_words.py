"""Words of any length against the tokenizers library."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from ledgerloom.llm import bpe


def test_long_words_against_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(alphabet, k=n)) for alphabet in (letters, "ab", "a", "tion", "é漢字كلمة") for n in (510, 513, 700, 3000, 20_000)]
    texts += ["short words and " + texts[2] + " between " + texts[4] + "!", ",;" * 2000, texts[0] + "the" * 300]
    for text, (ids, decoded) in zip(texts, bpe.vocabulary(path).encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_a_line_without_a_break():
    text = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    vocabulary = bpe.vocabulary(bpe.default_path())
    began = time.time()
    vocabulary.encode_batch([text])
    assert time.time() - began < 20
