"""Bit packing in numpy: what the coders' byte streams are made of.

Bitmaps put the first bit into the lowest place of a byte, bit vectors into the highest.
"""

from __future__ import annotations

import numpy as np

from gridloom.plans.types import Elem


class BitMap:
    """Single bits, lowest place first."""

    def __init__(self, bits: list[bool] | None = None):
        self.bits: list[bool] = [bool(b) for b in bits or []]

    @classmethod
    def from_bytes(cls, data: bytes, size: int | None = None) -> BitMap:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool).tolist()
        return cls(bits if size is None else bits[:size])

    def append(self, bit: bool) -> None:
        self.bits.append(bool(bit))

    def append_four(self, value: int) -> None:
        self.bits += [bool(value >> k & 1) for k in range(4)]

    def set(self, k: int) -> None:
        self.bits[k] = True

    def clear(self, k: int) -> None:
        self.bits[k] = False

    def toggle(self, k: int) -> None:
        self.bits[k] = not self.bits[k]

    def __len__(self) -> int:
        return len(self.bits)

    def __getitem__(self, k: int) -> bool:
        return self.bits[k]

    def to_bytes(self) -> bytes:
        return np.packbits(np.array(self.bits, bool), bitorder="little").tobytes()

    def view(self) -> BitMapView:
        return BitMapView(self.to_bytes(), len(self.bits))


class BitMapView:
    """Reads a bitmap from its start; beyond its end there are zeros."""

    def __init__(self, data: bytes, size: int | None = None):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:size].tolist()
        self.at = 0

    def next(self) -> int:
        k, self.at = self.at, self.at + 1
        return self.bits[k] if k < len(self.bits) else 0

    def next_bits(self, n: int) -> int:
        return sum(self.next() << k for k in range(n))

    def to_next_byte(self) -> None:
        self.at = -(-self.at // 8) * 8


class BitVector:
    """Bits in reading order, highest place first."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def append(self, value: int, count: int) -> None:
        """The ``count`` low bits of ``value``."""
        self.value = self.value << count | value & (1 << count) - 1
        self.size += count

    def append_bytes(self, data: bytes) -> None:
        self.append(int.from_bytes(data, "big"), 8 * len(data))

    def to_bytes(self) -> bytes:
        n = -(-self.size // 8)
        return (self.value << (8 * n - self.size)).to_bytes(n, "big")


class BitVectorView:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def next_number(self, count: int) -> int:
        """The next bits as a number; beyond the end there are zeros."""
        first, last = self.at // 8, -(-(self.at + count) // 8)
        chunk = self.data[first:last].ljust(last - first, b"\0")
        number = int.from_bytes(chunk, "big") >> (8 * last - self.at - count) & (1 << count) - 1
        self.at += count
        return number

    def next(self, count: int) -> bytes:
        """The next bits, left-aligned in bytes."""
        n = -(-count // 8)
        return (self.next_number(count) << (8 * n - count)).to_bytes(n, "big")

    def to_next_byte(self) -> None:
        self.at = -(-self.at // 8) * 8


def pack_fields(values: np.ndarray, counts: np.ndarray) -> bytes:
    """The ``counts`` low bits of each value on end, highest first, padded to a byte."""
    counts = counts.astype(np.int64)
    full = counts > 0
    n, v = counts[full], values.astype(np.int64).view(np.uint64)[full]
    if not len(n):
        return b""
    ends = np.cumsum(n)
    word, room = (ends - n) >> 6, 64 - ((ends - n) & 63)
    v = v & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - n).astype(np.uint64))
    over = n - room  # bits that go into the next word
    out = np.zeros((int(ends[-1]) + 63) >> 6, np.uint64)
    head = np.where(over > 0, v >> np.clip(over, 0, 63).astype(np.uint64), v << np.clip(-over, 0, 63).astype(np.uint64))
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[firsts]] = np.bitwise_or.reduceat(head, firsts)
    late = over > 0
    out[word[late] + 1] |= v[late] << (64 - over[late]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: -(-int(ends[-1]) // 8)]


def unpack_fields(data: bytes, counts: np.ndarray, skip: int = 0) -> np.ndarray:
    """The inverse, as int64 patterns; ``skip`` bits go before the first field."""
    n = counts.astype(np.int64)
    if not n.sum():
        return np.zeros(len(n), np.int64)
    starts = np.cumsum(n) - n + skip
    size = 8 * ((int(starts[-1] + n[-1]) >> 6) + 2)
    words = np.frombuffer(data[:size].ljust(size, b"\0"), ">u8").astype(np.uint64)
    word, off = starts >> 6, (starts & 63).astype(np.uint64)
    tail = np.where(off > 0, words[word + 1] >> ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
    both = words[word] << off | tail
    return np.where(n > 0, both >> np.clip(64 - n, 0, 63).astype(np.uint64), np.uint64(0)).view(np.int64)


def to_big_endian(values: np.ndarray | list, kind: Elem | str) -> bytes:
    """Numbers of an element type, highest byte first."""
    name = kind.numpy if isinstance(kind, Elem) else kind
    return np.asarray(values, dtype=name).astype(f">{name}").tobytes()


def from_big_endian(data: bytes, kind: Elem | str) -> np.ndarray:
    name = kind.numpy if isinstance(kind, Elem) else kind
    return np.frombuffer(data, f">{name}").astype(name)


def serialize(value: float | int, kind: Elem, big: bool = True) -> bytes:
    """One number, in either byte order."""
    return np.array(value, dtype=kind.numpy).astype((">" if big else "<") + kind.numpy).tobytes()


def deserialize(data: bytes, kind: Elem, big: bool = True) -> float | int:
    return np.frombuffer(data, (">" if big else "<") + kind.numpy)[0].item()
