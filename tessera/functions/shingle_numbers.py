"""32-bit numbers of word shingles from md5, which SQL has too, over whole Arrow batches."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

#: of RFC 1321
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PLACE = [lambda i: i, lambda i: 5 * i + 1, lambda i: 3 * i + 5, lambda i: 7 * i]
#: messages at once, which stay in the cache, and blocks of 64 bytes up to which they are arrays
AT_ONCE, BLOCKS = 8192, 3


def _block(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    a, b, c, d = state
    for i in range(64):
        turn = i // 16
        mixed = d ^ (b & (c ^ d)) if turn == 0 else c ^ (d & (b ^ c)) if turn == 1 else b ^ c ^ d if turn == 2 else c ^ (b | ~d)
        mixed += a
        mixed += _ADDED[i]
        mixed += words[_PLACE[turn](i) % 16]
        by = _TURNS[turn][i % 4]
        turned = mixed << np.uint32(by)
        mixed >>= np.uint32(32 - by)
        turned |= mixed
        turned += b
        a, b, c, d = d, turned, b, c
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def md5_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight hex digits of the md5 of each ``data[start:end]``, as numbers."""
    out, sizes = np.empty(len(starts), np.uint32), ends - starts
    blocks = (sizes + 9 + 63) // 64
    padded = np.concatenate([data, np.zeros(64 * BLOCKS, np.uint8)])
    for count in range(1, BLOCKS + 1):
        width, chosen = 64 * count, np.flatnonzero(blocks == count)
        rows, column = np.lib.stride_tricks.sliding_window_view(padded, width), np.arange(width)
        for k in range(0, len(chosen), AT_ONCE):
            at = chosen[k : k + AT_ONCE]
            size = sizes[at]
            message = rows[starts[at]] * (column < size[:, None])
            message[np.arange(len(at)), size] = 0x80
            words = np.ascontiguousarray(message.view("<u4").T)
            words[-2] = size * 8
            state = [np.full(len(at), x, np.uint32) for x in _START]
            for block in range(count):
                state = _block(state, words[16 * block : 16 * block + 16])
            out[at] = state[0].byteswap()
    for i in np.flatnonzero(blocks > BLOCKS):
        out[i] = int(hashlib.md5(data[starts[i] : ends[i]].tobytes(), usedforsecurity=False).hexdigest()[:8], 16)
    return out


def numbered(texts: pa.Array, size: int) -> pa.Array:
    """For each text, words with single spaces between them, the sorted distinct numbers of its runs of ``size`` words; of all words where there are fewer, none for none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    low, high = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    full, gaps = high > low, np.flatnonzero(data == 32)
    starts, ends = np.sort(np.concatenate([low[full], gaps + 1])), np.sort(np.concatenate([high[full], gaps]))
    words = np.where(full, np.searchsorted(gaps, high) - np.searchsorted(gaps, low) + 1, 0)
    runs = np.where(full, np.maximum(1, words - size + 1), 0)
    row = np.repeat(np.arange(len(texts)), runs)
    first = np.arange(len(row)) + np.repeat(np.cumsum(words) - words - (np.cumsum(runs) - runs), runs)
    last = first + np.minimum(words, size)[row] - 1
    found = np.sort(row.astype(np.uint64) << np.uint64(32) | md5_numbers(data, starts[first], ends[last]))
    found = found[np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]]
    counts = np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.int64)))
