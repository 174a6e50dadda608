"""Cell-wise algebra on cubes, with the nodata rules of each operator, on matrices of many tiles at once."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from tilewright.cube import DOUBLE, Header, RasterError, is_valid

UNARY = {
    "neg": np.negative,
    "abs": np.abs,
    "sqrt": np.sqrt,
    "log": np.log,
    "exp": np.exp,
}
BINARY = {
    "add": np.add,
    "subtract": np.subtract,
    "multiply": np.multiply,
    "divide": lambda a, b: np.where(b != 0, np.divide(a, b), a),
    "pow": np.power,
    "mod": np.fmod,
    "equal": lambda a, b: (a == b).astype(np.float64),
    "not_equal": lambda a, b: (a != b).astype(np.float64),
    "less": lambda a, b: (a < b).astype(np.float64),
    "less_equal": lambda a, b: (a <= b).astype(np.float64),
    "greater": lambda a, b: (a > b).astype(np.float64),
    "greater_equal": lambda a, b: (a >= b).astype(np.float64),
    "set": lambda a, b: b,
    "min": lambda a, b: np.where(a < b, a, b),
    "max": lambda a, b: np.where(a > b, a, b),
}
#: fill and set_nodata have rules of their own.
BINARY_NAMES = (*BINARY, "fill", "set_nodata")


def unary(name: str, head: Header, a: np.ndarray) -> tuple[Header, np.ndarray]:
    """Valid cells get the function's value, others stay. The result is of type DOUBLE."""
    with np.errstate(all="ignore"):
        return replace(head, data_type=DOUBLE), np.where(is_valid(a, head.no_data), UNARY[name](a), a)


def binary(name: str, head: Header, a: np.ndarray, other: Header | None, b: np.ndarray) -> tuple[Header, np.ndarray]:
    """Where both cells are valid the function's value, else the left cell. other: None if b is a scalar.

    a: tiles x cells; b likewise, or one value a tile (tiles x 1). A scalar has no nodata value.
    """
    if not head.cells:
        return head, a
    if other is not None and (head.bands, head.cols, head.rows) != (other.bands, other.cols, other.rows):
        raise RasterError(f"Datacubes of different dimensions: {head.bands} x {head.cols} x {head.rows} and {other.bands} x {other.cols} x {other.rows}")
    out = replace(head, data_type=DOUBLE)
    if name == "set_nodata":
        raise RasterError("set_nodata changes headers and is handled by the caller")
    if name == "fill":
        return out, np.broadcast_to(b, a.shape).astype(np.float64)
    valid = is_valid(a, head.no_data) & (np.isfinite(b) if other is None else is_valid(b, other.no_data))
    with np.errstate(all="ignore"):
        return out, np.where(valid, BINARY[name](a, b), a)
