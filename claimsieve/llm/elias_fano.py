"""Elias-Fano sequences: ascending integers in near-minimal space, read at any place.

Of every value the low bits stand in a packed array. The rest, value >> low, is written in
unary as a one at bit (value >> low) + index, so n values below u take about
n * (2 + log2(u / n)) bits. To find the i-th one, the place of every SAMPLE-th one is
kept in 32 bits; from there the bits are counted.
"""

from __future__ import annotations

import struct

import numpy as np

#: Values per remembered place of a one; steps of packing, so that each ends on a whole byte.
SAMPLE = 256
STEP = 1 << 16
#: Fixed layout of the header: values, low bits, bytes of low bits, bytes of high bits.
HEADER = struct.Struct("<QQQQ")


def low_bits(n: int, largest: int) -> int:
    """Bits of a value that are stored as they are."""
    return max(0, ((largest + 1) // n).bit_length() - 1) if n else 0


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each uint64, one value after another, highest bit first."""
    if not width:
        return b""
    out = []
    for start in range(0, len(values), STEP):
        step = values[start : start + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(step, axis=1)[:, 64 - width :]).tobytes())
    return b"".join(out)


def unpack_bits(data: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` values from place ``first`` on, as :func:`pack_bits` wrote them."""
    if not width or not count:
        return np.zeros(count, np.uint64)
    begin = first * width
    taken = np.frombuffer(data, np.uint8, (begin + count * width + 7) // 8 - begin // 8, begin // 8)
    bits = np.unpackbits(taken)[begin % 8 :][: count * width].reshape(count, width)
    wide = np.zeros((count, 64), np.uint8)
    wide[:, 64 - width :] = bits
    return np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)


def encode(values: np.ndarray) -> bytes:
    """The sequence of ascending uint64 ``values`` as bytes."""
    values = np.asarray(values, np.uint64)
    n, largest = len(values), int(values[-1]) if len(values) else 0
    width = low_bits(n, largest)
    places = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
    size = int(places[-1]) + 1 if n else 0
    if size >= 1 << 32:
        raise ValueError(f"{n} values are too many for one sequence")
    bits = np.zeros(size, np.uint8)
    bits[places.astype(np.int64)] = 1
    high, low = np.packbits(bits).tobytes(), pack_bits(values, width)
    samples = places[::SAMPLE].astype("<u4").tobytes()
    return HEADER.pack(n, width, len(low), len(high)) + low + high + samples


class Sequence:
    """Random access to the values of an encoded sequence."""

    def __init__(self, data: bytes) -> None:
        self.n, self.width, low, high = HEADER.unpack_from(data)
        view = memoryview(data)[HEADER.size :]
        self.low, self.high = view[:low], np.frombuffer(view[low : low + high], np.uint8)
        self.samples = np.frombuffer(view[low + high :], "<u4")
        if len(self.samples) != -(-self.n // SAMPLE):
            raise ValueError("a sequence of wrong length")

    def __len__(self) -> int:
        return self.n

    def select(self, first: int, count: int) -> np.ndarray:
        """Bits where the ones number ``first`` to ``first + count - 1`` stand."""
        if not count:
            return np.zeros(0, np.int64)
        begin = int(self.samples[first // SAMPLE])
        skip, byte, reach = first % SAMPLE, begin // 8, max(64, count)
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + reach])) + 8 * byte
            ones = ones[np.searchsorted(ones, begin) :]
            if len(ones) >= skip + count or byte + reach >= len(self.high):
                return ones[skip : skip + count]
            reach *= 2

    def take(self, first: int, count: int) -> np.ndarray:
        """Values number ``first`` to ``first + count - 1`` as uint64."""
        if not 0 <= first <= first + count <= self.n:
            raise IndexError(f"values {first} to {first + count} of {self.n}")
        high = self.select(first, count) - np.arange(first, first + count)
        return (high.astype(np.uint64) << np.uint64(self.width)) | unpack_bits(self.low, self.width, first, count)

    def __getitem__(self, i: int) -> int:
        return int(self.take(i, 1)[0])
