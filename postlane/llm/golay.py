"""The perfect binary Golay code (23, 12, 7) as an index of nearby words."""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, DATA = 23, 12
_GENERATOR = 0b101011100011


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for i in range(BITS - 1, BITS - DATA - 1, -1):
        x ^= ((x >> i) & 1) * (_GENERATOR << (i - (BITS - DATA)))
    return x


_HIGH = _remainder(np.arange(1 << DATA, dtype=np.int64) << (BITS - DATA))


def syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder by the generator: that of the upper 12 bits from a table, the lower 11 are their own."""
    x = np.asarray(x, np.int64)
    return _HIGH[x >> (BITS - DATA)] ^ (x & ((1 << (BITS - DATA)) - 1))


def _leaders() -> np.ndarray:
    """The error of at most three bits that each of the 2,048 syndromes stands for."""
    table = np.full(1 << (BITS - DATA), -1, np.int64)
    table[0] = 0
    for k in (1, 2, 3):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(BITS), k)], np.int64)
        table[syndrome(errors)] = errors
    return table


_LEADERS = _leaders()


def decode(x: np.ndarray) -> np.ndarray:
    """The index, in 12 bits, of the only code word within three bits of each 23-bit word."""
    x = np.asarray(x, np.int64)
    return (x ^ _LEADERS[syndrome(x)]) >> (BITS - DATA)


def _around() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the errors that lead from a word to the code words nearest to it and to its 23 neighbours, and how many they are."""
    every = np.arange(1 << (BITS - DATA))
    bits = 1 << np.arange(BITS)
    errors = np.concatenate([_LEADERS[:, None], bits ^ _LEADERS[every[:, None] ^ syndrome(bits)]], axis=1)
    errors.sort(axis=1)
    new = np.ones(errors.shape, bool)
    new[:, 1:] = errors[:, 1:] != errors[:, :-1]
    order = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(errors, order, 1), np.minimum(new.sum(axis=1), 6)


_ERRORS, _COUNT = _around()


def indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 indices, n x 6 mask of the distinct ones): the code words nearest to each word and to its 23 neighbours.

    Two words that differ in at most two bits have a neighbour in common, hence an index. A word within two bits of
    its code word has one index; one at three bits has six.
    """
    x = np.asarray(x, np.int64)
    s = syndrome(x)
    return (x[:, None] ^ _ERRORS[s]) >> (BITS - DATA), np.arange(6) < _COUNT[s][:, None]
