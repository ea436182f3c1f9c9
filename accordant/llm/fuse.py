"""Static three-way binary fuse filters over 64-bit keys, built and probed with NumPy."""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of key plus seed."""
    with np.errstate(over="ignore"):
        x = keys + _U(seed)
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three slots in consecutive segments, one row per key."""
    first = ((h >> _U(32)) * _U(length * segments)) >> _U(32)
    mask = _U(length - 1)
    second = (first + _U(length)) ^ ((h >> _U(18)) & mask)
    third = (first + _U(2 * length)) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _U(32))) & _U(0xFF)).astype(np.uint8)


def build(keys: np.ndarray, attempts: int = 100) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a filter that holds every key.

    Keys are peeled in rounds: a key is set aside as soon as one of its slots is its own.
    Slots set aside in the same round never depend on one another, so every round is one
    vector operation, forwards and back.
    """
    keys = np.unique(keys.astype(_U))
    n = len(keys)
    length = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    length = min(length, 1 << 18)
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(room / length) - 2) + 1
    for seed in range(1, attempts + 1):
        h = _mixed(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        slots = _slots(h, length, segments)
        size = length * (segments + 2)
        left, rounds = np.arange(n), []
        while len(left):
            flat = slots[left].ravel()
            alone = np.bincount(flat, minlength=size)[slots[left]] == 1
            own = alone.any(axis=1)
            if not own.any():
                break
            rounds.append((left[own], alone[own].argmax(axis=1)))
            left = left[~own]
        if len(left):
            continue
        table = np.zeros(size, dtype=np.uint8)
        prints = _prints(h)
        for who, at in reversed(rounds):
            s = slots[who]
            others = table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]
            table[s[np.arange(len(who)), at]] = prints[who] ^ others
        return seed, length, segments, table.tobytes()
    raise ValueError("no filter found")


def probe(keys: np.ndarray, seed: int, length: int, segments: int, prints: bytes) -> np.ndarray:
    """Whether each key may be held: always for a held key, for others once in about 256."""
    table = np.frombuffer(prints, dtype=np.uint8)
    h = _mixed(keys.astype(_U), seed * 0x9E3779B97F4A7C15 % (1 << 64))
    s = _slots(h, length, segments)
    return (table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]) == _prints(h)
