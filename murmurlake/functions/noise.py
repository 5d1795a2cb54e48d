"""Noise that is the same on every machine: a seeded xorshift generator that can start anywhere.

A step is linear over bits, so n steps are a matrix of 64 x 64 bits: its powers of two come from squaring, and any block of a
signal starts in the state that the blocks before it would have left, without making them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: the state before the first step of a signal without a seed.
SEED = 0x2545F4914F6CDD1D
#: Fixed value: a state's remainder by this becomes a number from -1 to 1.
MODULUS = 2_000_003
_ONE = np.uint64(1)
_BITS = np.arange(64, dtype=np.uint64)


def step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint64(13))
    x = x ^ (x >> np.uint64(7))
    return x ^ (x << np.uint64(17))


def apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix (an image for each bit) times states."""
    bits = (x[:, None] >> _BITS & _ONE).astype(bool)
    return np.bitwise_xor.reduce(np.where(bits, matrix, np.uint64(0)), axis=1)


@lru_cache(maxsize=64)
def power(k: int) -> np.ndarray:
    """The matrix of 2^k steps."""
    return step(_ONE << _BITS) if k == 0 else apply(power(k - 1), power(k - 1))


def jump(x: np.ndarray, n: int) -> np.ndarray:
    """States after n steps."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            x = apply(power(k), x)
    return x


def first_state(seed: int | None) -> int:
    """A seed changes the state before the first step by its bits; no state may be 0, as it would stay so."""
    return ((seed or 0) & (1 << 64) - 1) ^ SEED or SEED


def noise(seed: int | None, start: int, n: int) -> np.ndarray:
    """n numbers from -1 to 1, from the one with number start on."""
    if n <= 0:
        return np.zeros(0)
    lanes = max(1, int(n**0.5))
    each = -(-n // lanes)
    # A lane makes `each` numbers; all lanes step together.
    state = np.empty(lanes, np.uint64)
    state[:1] = jump(np.array([first_state(seed)], np.uint64), start)
    made = 1
    while made < lanes:
        more = min(made, lanes - made)
        state[made : made + more] = jump(state[:more], each * made)
        made += more
    out = np.empty((lanes, each))
    for j in range(each):
        state = step(state)
        out[:, j] = (state % np.uint64(MODULUS)).astype(float)
    return out.reshape(-1)[:n] / 1_000_001.5 - 1.0
