"""Words of texts as arrays: bounds and 64-bit hashes, computed on UTF-8 bytes at once."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_SPAN = 64


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bytes, lower-cased bytes, and one random number for each (place, byte).

    A word is a run of 0-9, a-z (A-Z count as lower case) and bytes above 127, that
    is of all characters outside ASCII. The numbers follow the splitmix64 rule."""
    byte = np.arange(256)
    word = ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122)) | (byte > 127)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.int64)
    z = (np.arange(1, _SPAN * 256 + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return word, lower, z ^ (z >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text starts (one more at the end).
    A null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data = texts.cast(pa.large_binary())
    _, offsets, values = data.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(data) + 1, data.offset * 8) if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and the number of the first word of each text
    (one more at the end). Words never reach over the bounds of a text."""
    word, lower, numbers = _tables()
    inside = word[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = bounds[:-1][bounds[:-1] < len(raw)]
    begins[at] = inside[at]
    places = np.flatnonzero(inside)
    starts = np.flatnonzero(begins[places])
    first = np.searchsorted(places[starts], bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = np.diff(np.append(starts, len(places)))
    within = np.arange(len(places)) - np.repeat(starts, lengths)
    values = numbers[(within % _SPAN) * 256 + lower[raw[places]]]
    if lengths.max() > _SPAN:
        values = values * (within // _SPAN * 2 + 1).astype(np.uint64)
    return np.add.reduceat(values, starts), first
