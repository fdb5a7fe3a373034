"""Gains of models far larger than any test table."""

import numpy as np
import pytest

from ruletrace.llm.language_model import STEP, Numbers, Trie


@pytest.mark.parametrize("total", [1e4, 2e8, 4.6e9, 1e13])
def test_gains_reach_any_total(tmp_path, total):
    numbers = Numbers(total, 10, 2.0)
    count, pair = np.array([1.0, 1.0, 3.0, 1e6]), np.array([1.0, 1.0, 2.0, 5.0])
    gains = numbers.gain(pair, count)
    words, firsts = np.array([5, 9, 11, 70], np.uint64), np.arange(5)
    cells = Trie.rows(words, count.astype(np.int64), firsts, np.array([3, 1, 4, 1], np.uint64), gains, numbers.step)
    trie = Trie.read(Trie.write(str(tmp_path), cells))
    got = trie.gain(trie.word(words), np.array([3, 1, 4, 1], np.uint64))
    assert np.abs(got - gains).max() <= numbers.step / 2 + 1e-9
    assert numbers.step == STEP or numbers.step <= 0.06
