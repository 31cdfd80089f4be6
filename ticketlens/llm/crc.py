"""CRC-32C of many byte strings at once, and the masked form that record files store."""

from __future__ import annotations

import functools

import numpy as np

#: The reversed polynomial of CRC-32C, and the number the masked form adds.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8


@functools.cache
def _byte_tables() -> np.ndarray:
    """Row i: the state after a byte and i zero bytes, for each byte."""
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(POLYNOMIAL), rows >> 1).astype(np.uint32)
    tables = [rows]
    for _ in range(3):
        tables.append((tables[-1] >> 8) ^ rows[tables[-1] & 0xFF])
    return np.stack(tables)


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = tables[0][state & 0xFF]
    for k in (1, 2, 3):
        out = out ^ tables[k][(state >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


@functools.cache
def _zeros(level: int) -> np.ndarray:
    """Tables by byte of the state: what 4 * 2**level zero bytes make of it."""
    bytes_of = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    if level:
        half = _zeros(level - 1)
        return np.stack([_apply(half, _apply(half, row)) for row in bytes_of])
    return np.stack([_apply(_byte_tables()[::-1], row) for row in bytes_of])


def crc32c(strings: list[bytes]) -> np.ndarray:
    """The checksum of each string, as uint32.

    Strings of about one length are taken together: words of four bytes are reduced to
    their states, then neighbours are joined, pair by pair. Zero bytes in front change
    nothing, so each string is filled up to a power of two."""
    sizes = np.array([len(s) for s in strings], np.int64)
    out = np.zeros(len(strings), np.uint32)
    words = np.maximum((sizes + 3) // 4, 1)
    level_of = np.ceil(np.log2(words)).astype(np.int64)
    for level in np.unique(level_of).tolist():
        own = np.flatnonzero(level_of == level)
        rows = np.zeros((len(own), 4 << level), np.uint8)
        for row, at in zip(rows, own.tolist()):
            if sizes[at]:
                row[len(row) - sizes[at] :] = np.frombuffer(strings[at], np.uint8)
        # The register starts with all bits set: the first four bytes are inverted.
        for i in range(4):
            has = np.flatnonzero(sizes[own] > i)
            rows[has, rows.shape[1] - sizes[own][has] + i] ^= 0xFF
        state = _apply(_byte_tables()[::-1], rows.view("<u4").astype(np.uint32))
        for step in range(level):
            state = _apply(_zeros(step), state[:, 0::2]) ^ state[:, 1::2]
        state = state[:, 0]
        out[own] = state ^ np.uint32(0xFFFFFFFF)
    for at in np.flatnonzero(sizes < 4).tolist():  # too short for the starting register
        out[at] = _plain(strings[at])
    return out


def _plain(data: bytes) -> int:
    table, state = _byte_tables()[0], 0xFFFFFFFF
    for byte in data:
        state = (state >> 8) ^ int(table[(state ^ byte) & 0xFF])
    return state ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits and moved on, so that checksums of checksums differ."""
    turned = (crc >> np.uint32(15)) | (crc << np.uint32(17))
    with np.errstate(over="ignore"):
        return turned + np.uint32(MASK_DELTA)
