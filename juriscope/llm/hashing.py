"""Vectorised hashes of words and word windows over UTF-8 bytes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes never
occur inside a multi-byte character, so byte runs are the words of the text.

Words of up to 16 bytes are two integers that hold them whole, longer ones their
XXH3 digest of 128 bits; a bit mixer makes one number of those and the length.
Windows double: the hash of 2n words mixes those of their halves, any other length
those of two windows that overlap.  No sums of powers, on which texts of few
letters could collide by their structure.  Two families are independent; together
they make keys of 96 or 128 bits.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two families.
_ODD = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every text
    (with the number of all words at the end)."""
    inside = NOT_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three numbers of every word that tell it from all others: its bytes 0 to 7 and 8
    to 15 and its length, or for a longer word the halves of its digest and its length."""
    size = (stops - starts).astype(np.uint64)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    # Every place of the text read as an integer of the eight bytes from there on.
    eights = np.ndarray(len(data) + 9, np.dtype("<u8"), padded.data, strides=(1,))
    full = np.uint64((1 << 64) - 1)
    low = eights[starts] & (full >> (np.uint64(64) - np.uint64(8) * np.minimum(size, np.uint64(8))))
    high = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(size > 8)
    rest = np.minimum(size[long] - np.uint64(8), np.uint64(8))
    high[long] = eights[starts[long] + 8] & (full >> (np.uint64(64) - np.uint64(8) * rest))
    for i in np.flatnonzero(size > 16).tolist():
        digest = xxhash.xxh3_128_intdigest(data[starts[i] : stops[i]])
        high[i], low[i] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
    return low, high, size


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, family: int = 0) -> np.ndarray:
    low, high, size = word_codes(data, starts, stops)
    a, b, c = map(np.uint64, _ODD[family])
    return mix(mix(low * a + size) + high * b + c)


def _both(first: np.ndarray, second: np.ndarray, family: int) -> np.ndarray:
    a, b, c = map(np.uint64, _ODD[family])
    x = first * a
    x += (second ^ c) * b
    return mix(x)


def window_hashes(words: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Hash of the ``length`` words from each position on, across texts too; the
    last ``length - 1`` positions have none."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    out, n = words, 1
    while n < length:
        step = min(n, length - n)
        out, n = _both(out[: len(out) - step], out[step:], family), n + step
    return out


def inside_texts(firsts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of the first ``n`` positions start a window that its text holds whole."""
    stop = np.repeat(firsts[1:], np.diff(firsts))[:n]
    return np.arange(n) + length <= stop
