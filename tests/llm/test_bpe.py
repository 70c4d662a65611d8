import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

CODER = bpe.Bpe(*bpe.default_paths())
PIECES = st.sampled_from([" ", "  ", "\n", "\t", "a", "Word", "é", "ñ", "12", "٣", "Ⅷ", "!", "'", "'s", "'re", " 't", "<|endoftext|>", " ", " ", "​", "\x1c", "\x85", "漢字", "𝄞", "é", "_", "x'd"])


def ids(texts):
    out = [None] * len(texts)
    for first, flat, ptr in CODER.encode(texts):
        for i in range(len(ptr) - 1):
            out[first + i] = flat[ptr[i] : ptr[i + 1]].tolist()
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=5))
def test_ids_equal_the_library(texts):
    assert ids(texts) == [CODER.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_nulls_long_texts_and_a_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_ROWS", 50)
    texts = [None, "", "word " * 200000] + [f"t{i} u{i * i} v" for i in range(300)]
    got = ids(texts)
    assert got[:2] == [[], []] and got[2:] == [CODER.whole.encode(t, add_special_tokens=False).ids for t in texts[2:]]
    assert isinstance(CODER.known, np.ndarray)
