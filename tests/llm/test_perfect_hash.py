import numpy as np
import pytest

from lexloom.llm import perfect_hash as ph


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 20_000])
def test_numbers_are_a_permutation(n):
    rng = np.random.default_rng(n)
    first, second = rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, n, np.uint64)
    packed, numbers = ph.build(first, second)
    assert sorted(numbers.tolist()) == list(range(n))
    assert (ph.PerfectHash(packed).numbers(first, second) == numbers).all()


def test_equal_first_halves_are_listed():
    first = np.array([7, 7, 7, 9], np.uint64)
    second = np.array([1, 2, 3, 1], np.uint64)
    packed, numbers = ph.build(first, second)
    assert sorted(numbers.tolist()) == [0, 1, 2, 3]
    assert ph.PerfectHash(packed).numbers(np.array([7], np.uint64), np.array([4], np.uint64)).tolist() == [-1]


def test_bits_a_key():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 50_000, np.uint64)
    packed, _ = ph.build(keys, keys)
    assert 8 * len(packed) / 50_000 < 5
