"""Bounded bit trimming, vectorised in numpy: at most as many rounds as a type has bits.

Two ways of getting trailing zeros are tried under the permitted errors: clearing the lowest set bit, and clearing the
lowest run of ones while setting the zero above. Patterns are int64 as in the bit functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from gridloom.plans.types import Elem

Complies = Callable[[np.ndarray, np.ndarray], np.ndarray]


def as_values(bits: np.ndarray, kind: Elem) -> np.ndarray:
    """Patterns as numbers of the type."""
    unsigned = bits.astype(np.int64).view(np.uint64).astype(f"u{kind.width // 8}")
    return unsigned.view(kind.numpy)


def as_bits(values: np.ndarray, kind: Elem) -> np.ndarray:
    return np.asarray(values, kind.numpy).view(f"u{kind.width // 8}").astype(np.uint64).view(np.int64)


def trailing_zeros(bits: np.ndarray, width: int) -> np.ndarray:
    u = bits.view(np.uint64)
    low = ~u & (u - np.uint64(1))
    return np.minimum(np.bitwise_count(low), width).astype(np.int64)


def compliance(real: np.ndarray, abs_eps: np.ndarray, rel_eps: np.ndarray) -> Complies:
    """Tests values against bounds around ``real``; a NaN bound permits anything. NaN and infinite values must stay as they are."""
    truth = real.astype(np.float64)

    def test(value: np.ndarray, where: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            v, t = value.astype(np.float64), truth[where]
            d = np.abs(v - t)
            same = (value == real[where]) | (np.isnan(v) & np.isnan(t))
            rel = np.where(t == 0, np.where(d == 0, 0.0, np.inf), d / np.abs(t))
            ok = np.isfinite(v) & np.isfinite(t)
            ok &= np.isnan(abs_eps[where]) | (d <= abs_eps[where])
            ok &= np.isnan(rel_eps[where]) | (rel <= rel_eps[where])
        return ok | same

    return test


def _trimmed(bits: np.ndarray, width: int, step: Callable[[np.ndarray], np.ndarray], value: Callable[[np.ndarray, np.ndarray], np.ndarray], test: Complies, rounds: int) -> np.ndarray:
    """Repeats a step as long as its result complies."""
    now, live = bits.copy(), np.arange(len(bits))
    ones = np.uint64(0xFFFFFFFFFFFFFFFF if width == 64 else (1 << width) - 1)
    for _ in range(rounds):
        live = live[now[live] != 0]
        if not len(live):
            break
        tried = (step(now[live].view(np.uint64)) & ones).view(np.int64)
        good = test(value(tried, live), live)
        live = live[good]
        now[live] = tried[good]
    return now


def _clear(x: np.ndarray) -> np.ndarray:
    return x & (x - np.uint64(1))


def _toggle(x: np.ndarray) -> np.ndarray:
    return x + (x & (~x + np.uint64(1)))


def truncate_tails(bits: np.ndarray, kind: Elem, abs_eps: np.ndarray, rel_eps: np.ndarray, missing: float | int | None) -> tuple[np.ndarray, np.ndarray]:
    """(patterns with most trailing zeros within the bounds, their lengths); of equals the toggled one.

    The last one of each value is implied: its length ends before it. A value of 0 has length 0; what would be taken for
    it, a lone highest bit, keeps all bits. Missing values are not changed.
    """
    width = kind.width
    real = as_values(bits, kind)
    test = compliance(real, abs_eps, rel_eps)
    value = lambda x, where: as_values(x, kind)
    toggled, cleared = (_trimmed(bits, width, f, value, test, width) for f in (_toggle, _clear))
    out = np.where(trailing_zeros(toggled, width) >= trailing_zeros(cleared, width), toggled, cleared)
    if missing is not None:
        with np.errstate(invalid="ignore"):
            gap = np.abs(real.astype(np.float64) - missing) < 4 * kind.epsilon if kind.is_float else real == missing
        out = np.where(gap, bits, out)
    zeros = trailing_zeros(out, width)
    lengths = np.where(out == 0, 0, np.where(zeros == width - 1, width, width - zeros - 1))
    top = np.int64(-(1 << 63)) if width == 64 else np.int64(1 << (width - 1))
    kept = np.where((lengths < width) & (out != 0), out & ~_lowest(out), out)
    return np.where(out == top, top, kept), lengths


def _lowest(bits: np.ndarray) -> np.ndarray:
    u = bits.view(np.uint64)
    return (u & (~u + np.uint64(1))).view(np.int64)


def restore_tails(bits: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Sets the implied one below each value's last bit."""
    place = np.clip(width - 1 - lengths, 0, 63).astype(np.uint64)
    one = (np.uint64(1) << place).view(np.int64)
    return np.where((lengths > 0) & (lengths < width), bits | one, bits)


def minimal_residuals(approx: np.ndarray, real: np.ndarray, kind: Elem, abs_eps: np.ndarray, rel_eps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the residual is subtracted, its pattern, what the approximation becomes).

    0 if the approximation complies; else the residual with the longer tail of zeros of the cleared and the toggled one,
    of equals the cleared.
    """
    width = kind.width
    ones = np.uint64(0xFFFFFFFFFFFFFFFF if width == 64 else (1 << width) - 1)
    a, r = approx.view(np.uint64), real.view(np.uint64)
    greater = a >= r
    diff = (np.where(greater, a - r, r - a) & ones).view(np.int64)
    test = compliance(as_values(real, kind), abs_eps, rel_eps)
    applied = lambda x, where: np.where(greater[where], a[where] - x.view(np.uint64), a[where] + x.view(np.uint64)) & ones
    value = lambda x, where: as_values(applied(x, where).view(np.int64), kind)
    every = np.arange(len(real))
    fine = test(as_values(approx, kind), every)
    cleared, toggled = (_trimmed(diff, width, f, value, test, width) for f in (_clear, _toggle))
    best = np.where(trailing_zeros(cleared, width) >= trailing_zeros(toggled, width), cleared, toggled)
    best = np.where(fine, 0, best)
    return greater & (best != 0), best, applied(best, every).view(np.int64)
