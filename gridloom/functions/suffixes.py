"""Alternative encodings of ordered suffixes: lists of (pattern, length) pairs, as numpy arrays.

Each encoder gives bytes and has a decoder that gives back the suffixes it got. Where lengths are not part of the stream
the decoder takes them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

from gridloom.functions import arithmetic, huffman
from gridloom.functions.packing import BitVector, BitVectorView, pack_fields, unpack_fields

#: Fixed values of the length code: four-bit codes from START on for lengths from 3 on; LONGER adds 8 and goes on.
START, LONGER = 0b1000, 0b1110
_STRIDE, _RUN = 8, 15


def append_length(v: BitVector, n: int) -> None:
    """Two bits for lengths 1 and 2, four for 3 to 8; longer ones take four bits for each 8 before the rest."""
    while n > 8:
        v.append(LONGER, 4)
        n -= 8
    if n <= 2:
        v.append(n - 1, 2)
    else:
        v.append(START + n - 3, 4)


def read_length(view: BitVectorView) -> int:
    n = 0
    while True:
        two = view.next_number(2)
        if two < 2:
            return n + two + 1
        four = two << 2 | view.next_number(2)
        if four != LONGER:
            return n + four - START + 3
        n += 8


def length_bits(n: np.ndarray) -> np.ndarray:
    """Bits that the length code takes."""
    n = n.astype(np.int64)
    long_ = np.maximum(-(-n // 8) - 1, 0)
    return 4 * long_ + np.where(n - 8 * long_ <= 2, 2, 4)


def length_codes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) that ``append_length`` puts for each length of at most 64."""
    made = [BitVector() for _ in range(65)]
    for k in range(1, 65):
        append_length(made[k], k)
    return np.array([v.value for v in made], np.int64)[n], np.array([v.size for v in made], np.int64)[n]


def _framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "big") + p for p in parts)


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "big")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def encode_indicated(bits: np.ndarray, lengths: np.ndarray) -> bytes:
    """One bit for whether there is a suffix, its length in two- and four-bit codes, the suffixes."""
    there = np.packbits(lengths > 0, bitorder="little").tobytes()
    return _framed(len(lengths).to_bytes(8, "big"), there, pack_fields(*length_codes(lengths[lengths > 0])), pack_fields(bits, lengths))


def decode_indicated(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, there, codes, body = _parts(data)
    has = np.unpackbits(np.frombuffer(there, np.uint8), bitorder="little", count=int.from_bytes(n, "big")).astype(bool)
    lengths, view = np.zeros(len(has), np.int64), BitVectorView(codes)
    lengths[has] = [read_length(view) for _ in range(int(has.sum()))]
    return unpack_fields(body, lengths), lengths


def encode_huffman(bits: np.ndarray, lengths: np.ndarray) -> bytes:
    """Lengths in Huffman codes."""
    table = huffman.codes(Counter(lengths.tolist()))
    code = np.array([table[n] for n in lengths.tolist()], np.int64).reshape(-1, 2)
    return _framed(len(lengths).to_bytes(8, "big"), huffman.serialize(table, 7), pack_fields(code[:, 0], code[:, 1]), pack_fields(bits, lengths))


def decode_huffman(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, table, codes, body = _parts(data)
    n = int.from_bytes(n, "big")
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    read, view = huffman.reader(huffman.deserialize(table, 7)), BitVectorView(codes)
    lengths = np.array([read(view) for _ in range(n)], np.int64)
    return unpack_fields(body, lengths), lengths


def encode_plain(bits: np.ndarray, lengths: np.ndarray) -> bytes:
    """The suffixes alone; lengths follow from what is known elsewhere."""
    return pack_fields(bits, lengths)


def decode_plain(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return unpack_fields(data, lengths), lengths


def _width(bits: np.ndarray) -> np.ndarray:
    """Bits up to the highest set one."""
    x = bits.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(x), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        high = x >> np.uint64(s)
        more = high > 0
        out[more] += s
        x = np.where(more, high, x)
    return out + (x > 0)


def encode_first_one(bits: np.ndarray, lengths: np.ndarray) -> bytes:
    """Zeros before the first one in an arithmetic code, then the rest; the decoder takes the lengths."""
    zeros = lengths - _width(bits)
    cum = arithmetic.cumulative(np.bincount(zeros, minlength=66) + 1)
    return _framed(arithmetic.table_bytes(cum), arithmetic.encode(zeros, cum), pack_fields(bits, lengths - zeros))


def decode_first_one(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table, codes, body = _parts(data)
    zeros = arithmetic.decode(codes, arithmetic.table_from(table), len(lengths))
    return unpack_fields(body, lengths - zeros), lengths


def encode_lengths(bits: np.ndarray, lengths: np.ndarray) -> bytes:
    """Lengths in an arithmetic code; of suffixes, whose last bit is 1, all but that bit."""
    cum = arithmetic.cumulative(np.bincount(lengths, minlength=66) + 1)
    return _framed(len(lengths).to_bytes(8, "big"), arithmetic.table_bytes(cum), arithmetic.encode(lengths, cum), pack_fields(bits >> 1, np.maximum(lengths - 1, 0)))


def decode_lengths(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, table, codes, body = _parts(data)
    lengths = arithmetic.decode(codes, arithmetic.table_from(table), int.from_bytes(n, "big"))
    bits = unpack_fields(body, np.maximum(lengths - 1, 0))
    return np.where(lengths > 0, bits << 1 | 1, 0), lengths


def xor_previous(bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each suffix XOR the one before it, within its own length."""
    x = bits.astype(np.int64).view(np.uint64).copy()
    x[1:] ^= bits.astype(np.int64).view(np.uint64)[:-1]
    return (x & _ones(lengths)).view(np.int64)


def undo_xor(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ones, out, last = _ones(lengths).tolist(), [], 0
    for a, m in zip(x.view(np.uint64).tolist(), ones, strict=True):
        last = (a ^ last) & m
        out.append(last)
    return np.array(out, np.uint64).view(np.int64)


def _ones(lengths: np.ndarray) -> np.ndarray:
    n = lengths.astype(np.uint64)
    return np.where(n >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def encode_xor_huffman(bits: np.ndarray, lengths: np.ndarray) -> bytes:
    """XOR with the suffix before; from two leading zeros on a flag and their Huffman code. The decoder takes the lengths."""
    x = xor_previous(bits, lengths)
    zeros = lengths - _width(x)
    table = huffman.codes(Counter(zeros[zeros >= 2].tolist()))
    far = zeros >= 2
    codes = np.array([table.get(z, (0, 0)) for z in range(65)], np.int64)[np.where(far, zeros, 0)]
    # a flag, the code of the zeros and the rest of each suffix
    fields = np.stack([far.astype(np.int64), np.where(far, codes[:, 0], 0), x.astype(np.int64)], axis=1)
    sizes = np.stack([np.ones(len(x), np.int64), np.where(far, codes[:, 1], 0), lengths - np.where(far, zeros, 0)], axis=1)
    return _framed(huffman.serialize(table, 7), pack_fields(fields.ravel(), sizes.ravel()))


def decode_xor_huffman(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table, body = _parts(data)
    entries = huffman.deserialize(table, 7)
    read, view = huffman.reader(entries) if entries else None, BitVectorView(body)
    out = []
    for n in lengths.tolist():
        z = read(view) if view.next_number(1) else 0
        out.append(view.next_number(n - z))
    return undo_xor(np.array(out, np.uint64).view(np.int64), lengths), lengths


def encode_xor_four(bits: np.ndarray, lengths: np.ndarray) -> bytes:
    """XOR with the suffix before; leading zeros, 15 at most, in four bits. The decoder takes the lengths."""
    x = xor_previous(bits, lengths)
    zeros = np.minimum(lengths - _width(x), 15)
    return _framed(pack_fields(zeros, np.full(len(zeros), 4)), pack_fields(x, lengths - zeros))


def decode_xor_four(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head, body = (*_parts(data), b"", b"")[:2]
    zeros = unpack_fields(head, np.full(len(lengths), 4))
    return undo_xor(unpack_fields(body, lengths - zeros), lengths), lengths


def encode_bit_planes(bits: np.ndarray, lengths: np.ndarray) -> bytes:
    """XOR with the suffix before; eight neighbours of one length as run-length coded bit planes, others as they are.

    A run is its bit and, in four bits, its length less one. The decoder takes the lengths.
    """
    x, lengths = xor_previous(bits, lengths).view(np.uint64), lengths.astype(np.int64)
    at = np.arange(len(x))
    # neighbours of one length: as many whole strides as they have, the rest one by one
    heads = np.flatnonzero(np.diff(lengths, prepend=-1))
    run = np.searchsorted(heads, at, side="right") - 1
    within = at - heads[run]
    same = within < np.diff(heads, append=len(x))[run] // _STRIDE * _STRIDE
    alone, first = at[~same], at[same & (within % _STRIDE == 0)]
    m = lengths[first]
    # the strides' planes on end, highest first
    stride = np.repeat(np.arange(len(first)), m * _STRIDE)
    place = np.arange(len(stride)) - np.repeat(np.cumsum(m * _STRIDE) - m * _STRIDE, m * _STRIDE)
    bit = (x[first[stride] + place % _STRIDE] >> (m[stride] - 1 - place // _STRIDE).astype(np.uint64)) & np.uint64(1)
    begins = np.flatnonzero((np.diff(bit.astype(np.int64), prepend=-1) != 0) | (place == 0))
    length = np.diff(begins, append=len(bit))
    count = -(-length // (_RUN + 1))
    owner = np.repeat(np.arange(len(begins)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    piece = np.minimum(length[owner] - nth * (_RUN + 1), _RUN + 1)
    runs = bit[begins][owner].astype(np.int64) << 4 | piece - 1
    # flags, single suffixes and runs in order of the suffixes that they belong to
    spot = np.concatenate([at[~same | np.isin(at, first)], alone, first[stride[begins]][owner]])
    values = np.concatenate([same[~same | np.isin(at, first)].astype(np.int64), x[alone].view(np.int64), runs])
    sizes = np.concatenate([np.ones(len(alone) + len(first), np.int64), lengths[alone], np.full(len(runs), 5)])
    order = np.argsort(spot, kind="stable")
    return pack_fields(values[order], sizes[order])


def decode_bit_planes(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    view, out, at, n = BitVectorView(data), [], 0, len(lengths)
    while at < n:
        m = int(lengths[at])
        if not view.next_number(1):
            out.append(view.next_number(m))
            at += 1
            continue
        planes: list[int] = []
        while len(planes) < m * _STRIDE:
            code = view.next_number(5)
            planes += [code >> 4] * ((code & 15) + 1)
        for k in range(_STRIDE):
            out.append(sum(planes[p * _STRIDE + k] << (m - 1 - p) for p in range(m)))
        at += _STRIDE
    return undo_xor(np.array(out, np.uint64).view(np.int64), lengths), lengths


ENCODERS = {
    "indicated": encode_indicated,
    "huffman": encode_huffman,
    "plain": encode_plain,
    "first_one": encode_first_one,
    "lengths": encode_lengths,
    "xor_huffman": encode_xor_huffman,
    "xor_four": encode_xor_four,
    "bit_planes": encode_bit_planes,
}
DECODERS = {
    "indicated": lambda data, _: decode_indicated(data),
    "huffman": lambda data, _: decode_huffman(data),
    "plain": decode_plain,
    "first_one": decode_first_one,
    "lengths": lambda data, _: decode_lengths(data),
    "xor_huffman": decode_xor_huffman,
    "xor_four": decode_xor_four,
    "bit_planes": decode_bit_planes,
}
