"""MD5 of many short texts at once, on NumPy arrays: for draws from digests, where each text is hashed often."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of padded messages that are hashed together.
BYTES = 1 << 22
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [*range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_SINES = [floor(abs(sin(i + 1)) * (1 << 32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _round(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, f: np.ndarray) -> None:
    """MD5's function of step i into f."""
    if i < 16:
        np.bitwise_xor(c, d, out=f)
        np.bitwise_and(f, b, out=f)
        np.bitwise_xor(f, d, out=f)
    elif i < 32:
        np.bitwise_xor(b, c, out=f)
        np.bitwise_and(f, d, out=f)
        np.bitwise_xor(f, c, out=f)
    elif i < 48:
        np.bitwise_xor(b, c, out=f)
        np.bitwise_xor(f, d, out=f)
    else:
        np.invert(d, out=f)
        np.bitwise_or(f, b, out=f)
        np.bitwise_xor(f, c, out=f)


def _block(state: list[np.ndarray], words: list[np.ndarray | int]) -> None:
    """Takes one block of 16 words into the state, in place. A word is an array, or an int if all texts share it."""
    a, b, c, d = (x.copy() for x in state)
    f = np.empty_like(a)
    for i in range(64):
        _round(i, b, c, d, f)
        np.add(a, f, out=a)
        w = words[_WORD[i]]
        if isinstance(w, int):
            np.add(a, np.uint32((w + _SINES[i]) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, w, out=a)
            np.add(a, np.uint32(_SINES[i]), out=a)
        np.left_shift(a, np.uint32(_SHIFTS[i]), out=f)
        np.right_shift(a, np.uint32(32 - _SHIFTS[i]), out=a)
        np.bitwise_or(a, f, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    for s, x in zip(state, (a, b, c, d)):
        np.add(s, x, out=s)


def _padded(texts: pa.Array, lead: int, blocks: int) -> list[np.ndarray | int]:
    """Words of the padded messages of so many blocks: lead bytes of zeros, the text, its end and the length in bits."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, 4 * texts.offset).astype(np.int64)
    sizes, starts = np.diff(offsets), offsets[:-1] - offsets[0]
    m = np.zeros((n, 64 * blocks), np.uint8)
    if offsets[-1] > offsets[0]:
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        m[np.repeat(np.arange(n), sizes), np.arange(len(data)) - np.repeat(starts - lead, sizes)] = data
    m[np.arange(n), lead + sizes] = 0x80
    m[:, -8:] = ((lead + sizes) * 8).astype("<u8").view(np.uint8).reshape(n, 8)
    words = np.ascontiguousarray(m.view("<u4").T)
    return [w if w.any() else 0 for w in words]


def leading_bits(texts: pa.Array, prefixes: list[str], bits: int = 52) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of a prefix, positions of texts, uint64s of the first bits of the MD5 digests of prefix + text), until every
    prefix met every text once. texts are strings without nulls, of any length; bits are at most 64."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    heads = [p.encode() for p in prefixes]
    for lead in sorted({len(h) for h in heads}):
        blocks = (lead + sizes + 8) // 64 + 1
        for k in np.unique(blocks).tolist():
            of_size, most = np.flatnonzero(blocks == k), max(1, BYTES // (64 * k))
            for at in (of_size[i : i + most] for i in range(0, len(of_size), most)):
                words = _padded(texts.take(pa.array(at)), lead, k)
                for r, h in enumerate(heads):
                    if len(h) != lead:
                        continue
                    own = list(words)
                    for j in range(0, lead, 4):
                        own[j // 4] = own[j // 4] | int.from_bytes(h[j : j + 4], "little")
                    state = [np.full(len(at), x, np.uint32) for x in _START]
                    for j in range(0, len(own), 16):
                        _block(state, own[j : j + 16])
                    pair = np.stack(state[:2], axis=1).astype("<u4")
                    yield r, at, pair.view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)
