"""Static binary-fuse filters (Graf and Lemire, 2022) over 64-bit keys, built and probed by numpy.

Three slots a key, one byte a slot: about nine bits a key and one false positive in 256. The slots
of a key lie in three neighbouring segments, so that peeling (repeatedly taking keys that are alone
in a slot) succeeds with an eighth of slack. A filter answers for one fixed set of keys.
"""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = "<QIII"
_U = np.uint64
TRIES = 100


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + _U(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ h >> _U(shift)) * _U(factor)
    return h ^ h >> _U(33)


def _high(h: np.ndarray, n: int) -> np.ndarray:
    """Upper 64 bits of h * n, for n under 2^32."""
    low = (h & _U(0xFFFFFFFF)) * _U(n) >> _U(32)
    return (h >> _U(32)) * _U(n) + low >> _U(32)


class FuseFilter:
    def __init__(self, seed: int, segment: int, spread: int, slots: np.ndarray):
        self.seed, self.segment, self.spread, self.slots = seed, segment, spread, slots

    @staticmethod
    def _places(h: np.ndarray, segment: int, spread: int) -> np.ndarray:
        mask = _U(segment - 1)
        first = _high(h, spread)
        second = first + _U(segment) ^ (h >> _U(18)) & mask
        third = first + _U(2 * segment) ^ h & mask
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ h >> _U(32)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Filter of a set of keys (uint64; repeats are one key); none gives a filter that refuses all."""
        keys = np.unique(keys)
        n = len(keys)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8))
        # sizes of three-wise fuse graphs as published
        segment = 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)) if n > 1 else 4
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) if n > 1 else 4
        segments = max(1, -(-round(n * factor) // segment) - 2)
        size, spread = (segments + 2) * segment, segments * segment
        for seed in range(1, TRIES + 1):
            seed = seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            h = _mix(keys, seed)
            places = cls._places(h, segment, spread)
            if (order := cls._peel(places, size)) is not None:
                break
        else:
            raise RuntimeError(f"no filter for {n} keys in {TRIES} tries")
        slots, prints = np.zeros(size, np.uint8), cls._print(h)
        for taken, slot in reversed(order):
            # no two keys of a round touch each other's slots; the own one is still zero
            slots[slot] = prints[taken] ^ np.bitwise_xor.reduce(slots[places[:, taken]], axis=0)
        return cls(seed, segment, spread, slots)

    @staticmethod
    def _peel(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, own slots), or None where a core is left."""
        n = places.shape[1]
        count = np.bincount(places.ravel(), minlength=size)
        total = np.zeros(size, np.int64)  # sum of key numbers: with one key left, that key
        for row in places:
            np.add.at(total, row, np.arange(n))
        order, left, front = [], n, np.flatnonzero(count == 1)
        while len(front):
            taken, first = np.unique(total[front], return_index=True)
            order.append((taken, front[first]))
            left -= len(taken)
            touched = places[:, taken].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(total, touched, np.tile(taken, 3))
            touched = np.unique(touched)
            front = touched[count[touched] == 1]
        return None if left else order

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for one in 256 of the others."""
        if not len(self.slots):
            return np.zeros(len(keys), bool)
        h = _mix(keys, self.seed)
        return np.bitwise_xor.reduce(self.slots[self._places(h, self.segment, self.spread)], axis=0) == self._print(h)

    def to_bytes(self) -> bytes:
        return struct.pack(_HEAD, self.seed, self.segment, self.spread, len(self.slots)) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        seed, segment, spread, _ = struct.unpack_from(_HEAD, data)
        return cls(seed, segment, spread, np.frombuffer(data, np.uint8, offset=struct.calcsize(_HEAD)))
