"""Elias-Fano coding of rising numbers, with select.

``n`` numbers below a universe ``u`` take ``n * (2 + log2(u / n))`` bits: the low bits of each in a packed
array, the high bits as a unary bit vector, in which the i-th number is the i-th one. Every 64th one has its
place sampled, so that reading one number looks at a few bytes only.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 64
HEAD = struct.Struct("<QQQBB")  # count, least number, largest number less the least, low bits, bytes of a sample
ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def encode(numbers: np.ndarray) -> bytes:
    numbers = np.asarray(numbers, np.int64)
    n = len(numbers)
    if n == 0:
        return HEAD.pack(0, 0, 0, 0, 4)
    if (np.diff(numbers) < 0).any():
        raise ValueError("numbers must not fall")
    least = int(numbers[0])
    rest = (numbers - numbers[0]).astype(np.uint64)
    top = int(rest[-1])
    low = max(0, (max(top, 1) // n).bit_length() - 1)
    high = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    ones = np.zeros(int(high[-1]) + 1, np.uint8)
    ones[high] = 1
    unary = np.packbits(ones, bitorder="little").tobytes()
    bits = ((rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    wide = 4 if high[-1] < 1 << 32 else 8
    samples = high[::EVERY].astype(f"<u{wide}").tobytes()
    head = HEAD.pack(n, least & (1 << 64) - 1, top, low, wide)
    return head + struct.pack("<QQ", len(packed), len(unary)) + packed + unary + samples


class EliasFano:
    """Reads what ``encode`` wrote, from bytes or a memory map; nothing is unpacked before it is asked for."""

    def __init__(self, data: bytes | memoryview):
        self.count, least, self.top, self.low, self.wide = HEAD.unpack_from(data, 0)
        self.least = least - (1 << 64) if least >> 63 else least
        at = HEAD.size
        if self.count == 0:
            self.size = at
            return
        packed, unary = struct.unpack_from("<QQ", data, at)
        at += 16
        self.packed = np.frombuffer(data, np.uint8, packed, at)
        self.unary = np.frombuffer(data, np.uint8, unary, at + packed)
        samples = -(-self.count // EVERY)
        self.samples = np.frombuffer(data, f"<u{self.wide}", samples, at + packed + unary)
        self.size = at + packed + unary + samples * self.wide

    def __len__(self) -> int:
        return self.count

    def select(self, i: int) -> int:
        """The i-th number, from one sample and the bytes after it."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place = int(self.samples[i // EVERY])
        left = i % EVERY
        byte = place // 8
        word = int(self.unary[byte]) >> place % 8 << place % 8
        while (ones := int(ONES[word])) <= left:
            left -= ones
            byte += 1
            word = int(self.unary[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        start = i * self.low
        value = 0
        for k in range(start // 8, (start + self.low + 7) // 8):
            value |= int(self.packed[k]) << 8 * (k - start // 8)
        low = value >> start % 8 & (1 << self.low) - 1
        return self.least + ((place - i) << self.low | low)

    def all(self) -> np.ndarray:
        """All numbers, in one pass."""
        if self.count == 0:
            return np.empty(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.unary, bitorder="little"))[:self.count] - np.arange(self.count)
        bits = np.unpackbits(self.packed, bitorder="little")[:self.count * self.low].reshape(self.count, self.low)
        low = (bits.astype(np.int64) << np.arange(self.low)).sum(1) if self.low else 0
        return self.least + (high.astype(np.int64) << self.low | low)
