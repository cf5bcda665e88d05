"""Huffman codes of small alphabets (their frequency tables have at most a few dozen entries)."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from gridloom.functions.packing import BitVector, BitVectorView


def codes(frequencies: Mapping[int, int]) -> dict[int, tuple[int, int]]:
    """(code, number of bits) of each symbol that occurs; a lone symbol has a code of no bits."""
    heap = [(f, n, (s,)) for n, (s, f) in enumerate(sorted(frequencies.items())) if f]
    heapq.heapify(heap)
    out = {s: "" for _, _, group in heap for s in group}
    made = len(frequencies)
    while len(heap) > 1:
        f, _, left = heapq.heappop(heap)
        g, _, right = heapq.heappop(heap)
        for group, bit in ((left, "0"), (right, "1")):
            for s in group:
                out[s] = bit + out[s]
        heapq.heappush(heap, (f + g, made, left + right))
        made += 1
    return {s: (int(c or "0", 2), len(c)) for s, c in sorted(out.items())}


def serialize(table: Mapping[int, tuple[int, int]], symbol_bits: int = 6) -> bytes:
    """Symbol, length and code of each entry on end; of a lone entry the symbol alone. The number of entries goes first."""
    v = BitVector()
    v.append(len(table), 16)
    for s, (code, n) in table.items():
        v.append(s, symbol_bits)
        if len(table) > 1:
            v.append(n, symbol_bits)
            v.append(code, n)
    return v.to_bytes()


def deserialize(data: bytes, symbol_bits: int = 6) -> dict[int, tuple[int, int]]:
    v = BitVectorView(data)
    n = v.next_number(16)
    if n == 1:
        return {v.next_number(symbol_bits): (0, 0)}
    out = {}
    for _ in range(n):
        s, bits = v.next_number(symbol_bits), v.next_number(symbol_bits)
        out[s] = (v.next_number(bits), bits)
    return out


def reader(table: Mapping[int, tuple[int, int]]):
    """A function that reads one symbol from a view."""
    by_code = {(n, code): s for s, (code, n) in table.items()}
    if len(by_code) == 1:
        only = next(iter(by_code.values()))
        return lambda view: only

    def read(view: BitVectorView) -> int:
        code = n = 0
        while (n, code) not in by_code:
            code, n = code << 1 | view.next_number(1), n + 1
            if n > 64:
                raise ValueError("no such code")
        return by_code[n, code]

    return read
