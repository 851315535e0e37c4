"""Decoders of the compressions of TIFF pages, as the format defines them."""

from __future__ import annotations

import zlib

import numpy as np

#: Fixed values of the format: compression schemes.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_CLEAR, _END = 256, 257


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    out, table, last = bytearray(), [], b""
    bits = held = at = 0
    width = 9
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    while True:
        while held < width and at < len(data):
            bits, held, at = (bits << 8) | data[at], held + 8, at + 1
        if held < width:
            return bytes(out)
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == _END:
            return bytes(out)
        if code == _CLEAR:
            table, width, last = list(base), 9, b""
            continue
        if not table:
            raise ValueError("codes before the first clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("a code that is not in the table")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1


def packbits(data: bytes) -> bytes:
    """Runs of a byte and stretches of bytes as they are."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked(data: bytes, scheme: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if scheme == LZW:
        return lzw(data)
    if scheme == PACKBITS:
        return packbits(data)
    raise ValueError(f"compression {scheme} is not read")


def unpredicted(rows: np.ndarray, predictor: int) -> np.ndarray:
    """rows (lines, columns) with the differences along lines summed up (predictor 2), in their own type."""
    if predictor == 1:
        return rows
    if predictor != 2 or rows.dtype.kind not in "ui":
        raise ValueError(f"predictor {predictor} is not read")
    return np.cumsum(rows, axis=1, dtype=rows.dtype)
