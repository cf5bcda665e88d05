"""Element types of grids: codes, widths and the Spark types that hold them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Elem:
    """An element type. ``width`` in bits; ``spark`` is wide enough for all its values."""

    name: str
    code: int
    width: int
    spark: str
    numpy: str

    @property
    def is_float(self) -> bool:
        return self.numpy[0] == "f"

    @property
    def is_signed(self) -> bool:
        return self.numpy[0] in "fi"

    @property
    def lowest(self) -> float | int:
        """The default missing value: the lowest number of the type."""
        return float(np.finfo(self.numpy).min) if self.is_float else int(np.iinfo(self.numpy).min)

    @property
    def epsilon(self) -> float:
        return float(np.finfo(self.numpy).eps) if self.is_float else 0.0


#: Type codes of the container format.
ELEMS = {
    e.name: e
    for e in (
        Elem("int8", 0, 8, "tinyint", "i1"),
        Elem("char", 1, 8, "tinyint", "i1"),
        Elem("int16", 2, 16, "smallint", "i2"),
        Elem("int32", 3, 32, "int", "i4"),
        Elem("float", 4, 32, "float", "f4"),
        Elem("double", 5, 64, "double", "f8"),
        Elem("uint8", 6, 8, "smallint", "u1"),
        Elem("uint16", 7, 16, "int", "u2"),
        Elem("uint32", 8, 32, "bigint", "u4"),
        Elem("int64", 9, 64, "bigint", "i8"),
        Elem("uint64", 10, 64, "decimal(20,0)", "u8"),
    )
}


def elem(kind: str | Elem) -> Elem:
    """An element type by name; ``int32_t`` and the like are understood."""
    if isinstance(kind, Elem):
        return kind
    name = kind.lower().removesuffix("_t")
    if name not in ELEMS:
        raise ValueError(f"unknown element type {kind!r}; known: {', '.join(ELEMS)}")
    return ELEMS[name]


def by_code(code: int) -> Elem:
    for e in ELEMS.values():
        if e.code == code:
            return e
    raise ValueError(f"unknown element type code {code}")
