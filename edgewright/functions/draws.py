"""Repeatable pseudo-randomness: an MD5 of a seed and a row's keys, the same wherever it is computed."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws that are made together; their words stay in a core's cache.
CHUNK = 1 << 15


def ticket(seed: int, *keys: str | Column) -> Column:
    """A hex string that orders rows at random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number from 0 to below 1, from the first 48 bits of the ticket."""
    return F.conv(F.substring(ticket(seed, *keys), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def below(n: Column, seed: int, *keys: str | Column) -> Column:
    """A whole number from 0 to below n."""
    return F.conv(F.substring(ticket(seed, *keys), 1, 12), 16, 10).cast("long") % n


def ticket_sql(seed: int, *keys: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"({k})::VARCHAR" for k in keys) + "))"


def uniform_sql(seed: int, *keys: str) -> str:
    return f"(('0x' || substr({ticket_sql(seed, *keys)}, 1, 12))::BIGINT / {float(1 << 48)})"


#: Rotations and constants of MD5 (RFC 1321), and what a block starts from.
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLACES = ([i for i in range(16)], [(5 * i + 1) % 16 for i in range(16)], [(3 * i + 5) % 16 for i in range(16)], [7 * i % 16 for i in range(16)])


def _first_bytes(words: list[np.ndarray | int]) -> np.ndarray:
    """The first six bytes, as one number, of the MD5 of each block; a word is one number where all blocks agree."""
    shape = next(w.shape for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(shape, s, np.uint32) for s in _START)
    f, high = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word, turn = words[_PLACES[kind][i % 16]], _TURNS[kind][i % 4]
        np.add(f, a, out=f)
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
            np.add(f, np.uint32(_SINES[i]), out=f)
        else:
            np.add(f, np.uint32((_SINES[i] + word) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(turn), out=high)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, high, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    a, b = a + np.uint32(_START[0]), b + np.uint32(_START[1])
    return a.byteswap().astype(np.int64) << 16 | (b.astype(np.uint16).byteswap()).astype(np.int64)


def below_each(n: int, seed: int, key: int | str, first: int, end: int) -> np.ndarray:
    """What ``below(n, seed, key, x)`` is for each whole number x from ``first`` to ``end``, which itself is
    left out: many draws of one key at once, inside a task."""
    out = np.empty(max(0, end - first), np.int64)
    at = first
    while at < end:
        digits = len(str(at))
        to = min(end, 10**digits, at + CHUNK)
        head = f"{seed}|{key}|".encode()
        length = len(head) + digits
        if length > 55:
            raise ValueError(f"a key of {length} bytes is more than one block of MD5")
        block = bytearray(head + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little")
        plain = np.frombuffer(bytes(block), "<u4")
        words: list[np.ndarray | int] = [int(w) for w in plain]
        rest = np.arange(at, to, dtype=np.uint32 if to < 1 << 32 else np.uint64)
        for i in range(digits - 1, -1, -1):
            ten = rest // rest.dtype.type(10)
            digit = (rest - ten * rest.dtype.type(10)).astype(np.uint32) + np.uint32(ord("0"))
            word, byte = divmod(len(head) + i, 4)
            now = words[word]
            words[word] = (digit << np.uint32(8 * byte)) | (now if isinstance(now, np.ndarray) else np.uint32(now))
            rest = ten
        out[at - first : to - first] = _first_bytes(words) % n
        at = to
    return out
