"""Draws that depend on keys alone, never on partitions or task attempts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*keys: Column | str | int) -> Column:
    """A whole number in [0, 2^32) from keys joined by colons; equals ``('0x' || substr(md5(k), 1, 8))::BIGINT``."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*keys: Column | str | int) -> Column:
    """In [0, 1)."""
    return hashed(*keys).cast("double") / F.lit(4294967296.0)


def choice(n: int, *keys: Column | str | int) -> Column:
    """0 to n - 1."""
    return hashed(*keys) % n


def gauss(*keys: Column | str | int) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(1 - uniform(*keys, "r"))) * F.cos(2 * math.pi * uniform(*keys, "t"))


_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers that are hashed at once, so that all of it stays in a core's cache.
_AT_ONCE = 1 << 15


def _scalar(x: int) -> np.ndarray:
    """A number that numpy need not convert at every use."""
    return np.array(x & 0xFFFFFFFF, np.uint32)


#: Each step's round, word and both shifts of its turn. The first register is settled three steps before the last.
_STEPS = [(i // 16, _WORD[i // 16](i), _scalar(_TURN[i // 16][i % 4]), _scalar(32 - _TURN[i // 16][i % 4])) for i in range(61)]


def _md5_first(words: list[np.ndarray | int], room: np.ndarray) -> np.ndarray:
    """The first 32 bits of MD5 of one-block messages, given as their 16 words; a word that all share is a plain number.

    ``room`` has six rows, a column for each message; they are overwritten.
    """
    xor, both, add, left, right = np.bitwise_xor, np.bitwise_and, np.add, np.left_shift, np.right_shift
    a, b, c, d, f, t = room
    for r, x in zip((a, b, c, d), _START, strict=True):
        r.fill(x)
    # Results go to the last argument; few arrays are touched, so that they stay in the cache.
    for (turn, at, up, down), k in zip(_STEPS, _K, strict=False):
        if turn == 0:
            xor(c, d, f), both(f, b, f), xor(f, d, f)
        elif turn == 1:
            xor(b, c, f), both(f, d, f), xor(f, c, f)
        elif turn == 2:
            xor(b, c, f), xor(f, d, f)
        else:
            np.invert(d, f), np.bitwise_or(f, b, f), xor(f, c, f)
        add(a, f, a)
        w = words[at]
        if isinstance(w, np.ndarray):
            add(a, w, a), add(a, _scalar(k), a)
        else:
            add(a, _scalar(k + w), a)
        left(a, up, t), right(a, down, a), np.bitwise_or(a, t, a), add(a, b, a)
        a, b, c, d = d, a, b, c
    return add(b, _scalar(_START[0]), b).byteswap()


class Draws:
    """``hashed`` of keys of which one is a whole number, for many such numbers at once: prefix + number + suffix, 55 bytes at most."""

    def __init__(self, numbers: np.ndarray, suffix: bytes = b""):
        text = np.asarray(numbers, np.int64).astype("S20")
        size = np.char.str_len(text)
        raw = text.view(np.uint8).reshape(-1, 20)
        self.n, self.suffix, self._made = len(text), suffix, {}
        self.parts = [(at, raw[at, :k]) for k in np.unique(size) for at in [np.flatnonzero(size == k)]]

    def _words(self, lead: int) -> list[list[np.ndarray | int]]:
        """Words of each part's messages after ``lead`` zero bytes for a prefix."""
        if lead not in self._made:
            out = []
            for at, digits in self.parts:
                k = digits.shape[1]
                end = lead + k + len(self.suffix)
                if end > 55:
                    raise ValueError(f"{end} bytes to hash, 55 at most")
                m = np.zeros((len(at), 64), np.uint8)
                m[:, lead : lead + k], m[:, lead + k : end], m[:, end] = digits, np.frombuffer(self.suffix, np.uint8), 0x80
                m[:, 56:64] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
                w = m.view("<u4")
                vary = range(lead // 4, (lead + k - 1) // 4 + 1)
                out.append([np.ascontiguousarray(w[:, i]) if i in vary else int(w[0, i]) for i in range(16)])
            self._made[lead] = out
        return self._made[lead]

    def under(self, prefix: str, of: np.ndarray | None = None) -> np.ndarray:
        """uint32 for each number, or for those where the booleans ``of`` hold, in their order."""
        raw = prefix.encode()
        front = np.frombuffer(raw.ljust(64, b"\0"), "<u4")
        out = np.empty(self.n, np.uint32)
        for (at, _), words in zip(self.parts, self._words(len(raw)), strict=True):
            mine = None if of is None else np.flatnonzero(of[at])
            own = [w if mine is None or not isinstance(w, np.ndarray) else w[mine] for w in words]
            where = at if mine is None else at[mine]
            room = np.empty((6, min(len(where), _AT_ONCE)), np.uint32)
            for x in range(0, len(where), _AT_ONCE):
                y = min(x + _AT_ONCE, len(where))
                words_ = [w[x:y] | front[i] if isinstance(w, np.ndarray) else w | int(front[i]) for i, w in enumerate(own)]
                out[where[x:y]] = _md5_first(words_, room[:, : y - x])
        return out if of is None else out[of]


def below(p: float) -> int:
    """``uniform`` is below ``p`` exactly if ``hashed`` is below this."""
    return min(max(math.ceil(p * 4294967296.0), 0), 1 << 32)
