"""The draws of ``inference.draw`` in numpy, for rows times replicates: the first four bytes of md5 of ``seed:replicate:id``."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Draws made at once, so that the operands of a round stay in a core's cache
CELLS = 16384


def _first_word(m: list, n: int) -> np.ndarray:
    """First word of md5 of ``n`` messages of one block, as a big-endian number; ``m`` holds the 16 words, None for zeros."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three rounds do not reach the first word
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, _K[i], out=f)
        if m[g] is not None:
            np.add(f, m[g], out=f)
        r = _TURN[i // 16][i % 4]
        np.left_shift(f, np.uint32(r), out=t), np.right_shift(f, np.uint32(32 - r), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + _START[0]).byteswap()


def draws(seed: str, ids: list[str | None], replicates: range) -> Iterator[tuple[int, np.ndarray]]:
    """The draws of all ``ids`` in blocks of replicates: ``(first, h)`` with ``h[i, j]`` of replicate ``first + i`` and id
    ``j``. A missing id is left out of what is hashed, as ``concat_ws`` does."""
    n = len(ids)
    tails = [b"" if s is None else s.encode() for s in ids]
    at = replicates.start
    while at < replicates.stop and n:
        end = min(replicates.stop, 10 ** len(str(at)))  # as many digits
        size = len(f"{seed}:{at}:".encode())
        room = 55 - size
        odd = [j for j, s in enumerate(ids) if s is None or len(tails[j]) > room]
        block = np.zeros((n, 64), np.uint8)
        if room >= 0:
            block[:, size:56] = np.frombuffer(b"".join((s[:room] + b"\x80").ljust(56 - size, b"\0") for s in tails), np.uint8).reshape(n, -1)
        block[:, 56:] = (8 * (size + np.array([len(s) for s in tails], "<u8"))).view(np.uint8).reshape(n, 8)
        words = np.ascontiguousarray(block.view("<u4").T)
        step = max(1, CELLS // n)
        tiled = [np.tile(w, step) if w.any() else None for w in words]
        while at < end:
            k = min(step, end - at)
            m = [None if w is None else w[: k * n] for w in tiled]
            if room >= 0:
                heads = np.zeros((k, 64), np.uint8)
                heads[:, :size] = np.frombuffer(b"".join(f"{seed}:{b}:".encode() for b in range(at, at + k)), np.uint8).reshape(k, size)
                for g, h in enumerate(heads.view("<u4").T[: (size + 3) // 4]):
                    m[g] = np.repeat(h, n) if m[g] is None else m[g] | np.repeat(h, n)
            out = _first_word(m, k * n).reshape(k, n)
            for j in odd:
                for i in range(k):
                    text = f"{seed}:{at + i}".encode() + (b"" if ids[j] is None else b":" + tails[j])
                    out[i, j] = int.from_bytes(hashlib.md5(text).digest()[:4], "big")
            yield at, out
            at += k
