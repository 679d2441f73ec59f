"""Vectorised text kernels shared by the operators: whole Arrow batches at a time, no per-word Python.

A *word* is a maximal run of ASCII letters and digits and of other characters that are no ASCII, of the lower-cased
text. General, Latin-1, CJK and full-width punctuation and spaces are no word characters, and a character of a script
without spaces (Han, kana, Thai, Lao, Burmese, Khmer) is a word by itself. A null text has no words, exactly as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text hashed in one go; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

_WORDS = np.zeros(256, dtype=np.uint8)
_WORDS[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_WORDS[128:] = 1
_SIGNS = np.where(_WORDS == 0, 2, 1).astype(np.uint8)
_SIGNS[list(b" \t\r\n\v\f\0")] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: uint64 -> uint64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_INV = np.uint64(_inverse(int(_BASE)))


def release() -> None:
    """Gives memory that is free in this process back to the system: idle Python workers stay, beside busy ones."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; it decides by itself


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Splits an array of texts into consecutive runs of about PIECE_BYTES: (first row, run)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array, null as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more entry for the end)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


_ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
_MARKS = ((0x2000, 0x206F), (0x3001, 0x3004), (0x3008, 0x3030), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_SPACES = ((0x2000, 0x200B), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))


def _within(code: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    return np.logical_or.reduce([(code >= low) & (code <= high) for low, high in ranges])


def _beyond_ascii(raw: np.ndarray, kind: np.ndarray, sign: int) -> np.ndarray:
    """Sets the kind of punctuation (sign) and spaces (0) beyond ASCII; where characters begin and end that are words alone."""
    two = np.flatnonzero(raw == 0xC2)
    other = raw[two + 1]
    two = two[(other != 0xAA) & (other != 0xB5) & (other != 0xBA)]  # ordinals and the micro sign are letters
    kind[two] = kind[two + 1] = np.where((raw[two + 1] <= 0x9F) | (raw[two + 1] == 0xA0), 0, sign)
    times = np.flatnonzero(raw == 0xC3)
    times = times[(raw[times + 1] == 0x97) | (raw[times + 1] == 0xB7)]
    kind[times] = kind[times + 1] = sign
    at = np.flatnonzero((raw >= 0xE0) & (raw < 0xF0))
    code = ((raw[at] & 0xF).astype(np.int32) << 12) | ((raw[at + 1] & 0x3F).astype(np.int32) << 6) | (raw[at + 2] & 0x3F)
    space = _within(code, _SPACES)
    for which, value in ((_within(code, _MARKS) & ~space, sign), (space, 0)):
        for i in range(3):
            kind[at[which] + i] = value
    alone = at[_within(code, _ALONE)]
    far = np.flatnonzero(raw == 0xF0)
    far = far[(raw[far + 1] >= 0xA0) & (raw[far + 1] <= 0xAF)]  # further Han characters
    return np.concatenate([alone, alone + 3, far, far + 4])


def word_hashes(texts: pa.Array, signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash per word in order, and the offsets of each text's words.

    signs: runs of other characters than words and white space count as words too, and case stays.
    """
    texts = as_text(texts) if signs else pc.utf8_lower(as_text(texts))
    raw, starts = _buffer(texts)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kind = (_SIGNS if signs else _WORDS)[raw]
    alone = _beyond_ascii(raw, kind, 2 if signs else 0) if (raw >= 0xC2).any() else np.zeros(0, np.int64)
    turn = np.empty(n + 1, dtype=bool)
    turn[0] = turn[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=turn[1:-1])
    turn[alone] = True
    turn[starts] = True  # a text's first byte begins a word even if the text before ended in one
    some = kind != 0
    begin = np.flatnonzero(turn[:-1] & some)
    end = np.flatnonzero(turn[1:] & some) + 1
    return span_hashes(raw, begin, end), np.searchsorted(begin, starts)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial modulo 2**64 from prefix sums, mixed with the length."""
    n = len(raw)
    if not n:
        return mix((end - begin).astype(np.uint64))
    total = np.full(n + 1, _BASE, dtype=np.uint64)
    total[0], total[1] = 0, 1
    np.multiply.accumulate(total[1:], out=total[1:])
    total[1:] *= raw.astype(np.uint64) + np.uint64(1)
    np.cumsum(total, out=total)
    value = total[end] - total[begin]
    del total
    back = np.full(n + 1, _INV, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    value *= back[begin]
    return mix(value ^ (end - begin).astype(np.uint64))


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int, pad: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words, and their offsets.

    pad: a text of 1 to n-1 words gets one gram of all its words; otherwise it gets none.
    """
    count = np.diff(offsets)
    size = np.maximum(count - n + 1, (count > 0).astype(np.int64) if pad else 0)
    out = np.concatenate([[0], np.cumsum(size)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    first = np.repeat(offsets[:-1] - out[:-1], size) + np.arange(out[-1])
    last = np.repeat(offsets[1:], size)
    with np.errstate(over="ignore"):
        h = mix(words[first] + np.uint64(n))
        for i in range(1, n):
            at = first + i
            inside = at < last
            step = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[np.minimum(at, len(words) - 1)])
            h = step if inside.all() else np.where(inside, step, h)
    return h, out
