"""Tokens are told apart by their bytes, not by chance."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import brute_statistics

from sieveline.llm import bpe, outliers, textarrays

#: Two words of 1024 letters, each the other with its letters swapped: polynomial hashes modulo a power of two are equal for them, whatever the base.
TWINS = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1)]


def counts(texts):
    parts = [outliers.text_statistics(data, rows) for _, _, data, rows in textarrays.slices(pa.array(texts, pa.string()))]
    return [tuple(int(p[c][i]) for c in outliers.COUNTS) for p in parts for i in range(len(p["n_words"]))]


def test_twins_are_two_words():
    from tokenizers import Tokenizer

    text = " ".join([*TWINS, TWINS[0], "x", *TWINS]) + "\n" + TWINS[0] + "\n" + TWINS[1]
    assert counts([text]) == [brute_statistics(text)]
    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = [ids for ids, _ in bpe.encoded(bpe.PairIndex(bpe.vocabulary_path()), [text])]
    assert got == [" ".join(map(str, t.encode(text, add_special_tokens=False).ids))]


def test_equal_hashes_are_compared_byte_by_byte(monkeypatch):
    words = ["a", "b", "a" * 9, "a" * 8 + "b", "a" * 80, "a" * 79 + "b", "a", "a" * 79 + "b"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    monkeypatch.setattr(textarrays, "hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    first, which = textarrays.distinct(data, starts, ends)
    assert [words[first[k]] for k in which] == words and len(first) == 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab#é \n\t", max_size=40), max_size=8))
def test_statistics_of_any_texts(texts):
    assert counts(texts) == [brute_statistics(t) for t in texts]


def test_windows_do_not_cross_rows():
    texts = ["a b c", "a b c", "a b c a b c", "", "x\n\nx\n \nx"]
    assert [c[-1] for c in counts(texts)] == [0, 0, 6, 0, 0]
    assert counts(texts) == [brute_statistics(t) for t in texts]
