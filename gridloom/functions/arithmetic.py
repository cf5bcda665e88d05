"""A static arithmetic coder over 31-bit ranges, and its frequency tables.

Coding is sequential, so it runs per chunk in Python workers; tables are made by aggregates elsewhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np

from gridloom.functions.symbols import TARGET

#: The quarters of the coder's 31-bit range.
FIRST, MIDDLE, THIRD, TOP = 0x20000000, 0x40000000, 0x60000000, 0x7FFFFFFF
_WORD = 31
#: Bytes of codes whose bits are held at a time.
_WINDOW = 1 << 16


def cumulative(frequencies: list[int] | np.ndarray) -> list[int]:
    """Running sums of frequencies scaled to about ``TARGET``; what occurs keeps at least 1."""
    f = np.asarray(frequencies, np.int64)
    scale = f.sum() / TARGET
    scaled = np.where(f > 0, np.maximum((f / scale if scale else f).astype(np.int64), 1), 0)
    return np.cumsum(scaled).tolist()


def table_bytes(cum: list[int]) -> bytes:
    """The number of symbols and the running sums, as 32-bit numbers."""
    return np.array([len(cum), *cum], ">u4").tobytes()


def table_from(data: bytes) -> list[int]:
    n = int.from_bytes(data[:4], "big")
    return np.frombuffer(data, ">u4", n, 4).astype(np.int64).tolist()


def encode(places: np.ndarray | list[int], cum: list[int]) -> bytes:
    """Codes of symbols given by their places in the table. The stream has a spare byte and 32 bits at least."""
    return encode_parts([places], cum)


def encode_parts(parts: Iterable[np.ndarray | list[int]], cum: list[int]) -> bytes:
    """As ``encode`` of all parts on end; only one part's numbers and bits are held at a time, and the codes."""
    low, high, pending = 0, TOP, 0
    below = [0, *cum[:-1]]
    total = cum[-1] if cum else 1
    out, done = bytearray(), []  # one bit per entry, and packed bytes
    for part in parts:
        for k in part if isinstance(part, list) else part.tolist():
            step = (high - low + 1) // total
            high = low + step * cum[k] - 1
            low += step * below[k]
            while True:
                if high < MIDDLE:
                    bit = 0
                elif low >= MIDDLE:
                    bit = 1
                    low -= MIDDLE
                    high -= MIDDLE
                else:
                    break
                out.append(bit)
                if pending:
                    out += bytes([1 - bit]) * pending
                    pending = 0
                low <<= 1
                high = high << 1 | 1
            while FIRST <= low and high < THIRD:
                pending += 1
                low = (low - FIRST) << 1
                high = (high - FIRST) << 1 | 1
        whole = len(out) // 8 * 8
        done.append(_packed(out[:whole]))
        del out[:whole]
    out += bytes([0]) + bytes([1]) * (pending + 1) if low < FIRST else bytes([1])
    data = b"".join(done) + _packed(out)
    return data.ljust(max(len(data) + 1, 4), b"\0")


def _packed(bits: bytearray) -> bytes:
    return np.packbits(np.frombuffer(bits, np.uint8), bitorder="little").tobytes()


def decode(data: bytes, cum: list[int], count: int | None = None) -> np.ndarray:
    """Places of ``count`` symbols, or of all before the last symbol of the table, which ends a chunk."""
    return np.concatenate([np.zeros(0, np.int64), *decode_parts(data, cum, count)])


def decode_parts(data: bytes, cum: list[int], count: int | None = None, part: int = 1 << 18) -> Iterator[np.ndarray]:
    """As ``decode``, ``part`` places at a time; only a window of the bits is held."""
    windows = (np.unpackbits(np.frombuffer(data, np.uint8, min(_WINDOW, len(data) - at), at), bitorder="little").tolist() for at in range(0, len(data), _WINDOW))
    bits = chain(chain.from_iterable(windows), repeat(0))  # beyond the end there are zeros
    low, high = 0, TOP
    buffer = 0
    for b in islice(bits, _WORD):
        buffer = buffer << 1 | b
    below, total, last = [0, *cum[:-1]], cum[-1], len(cum) - 1
    out: list[int] = []
    made = 0
    while count is None or made < count:
        step = (high - low + 1) // total
        k = bisect_right(cum, min((buffer - low) // step, total - 1))
        if count is None and k == last:
            break
        out.append(k)
        made += 1
        if len(out) == part:
            yield np.array(out, np.int64)
            out = []
        high = low + step * cum[k] - 1
        low += step * below[k]
        while True:
            if high < MIDDLE:
                pass
            elif low >= MIDDLE:
                low -= MIDDLE
                high -= MIDDLE
                buffer -= MIDDLE
            elif FIRST <= low and high < THIRD:
                low -= FIRST
                high -= FIRST
                buffer -= FIRST
            else:
                break
            low <<= 1
            high = high << 1 | 1
            buffer = buffer << 1 | next(bits)
    if out:
        yield np.array(out, np.int64)
