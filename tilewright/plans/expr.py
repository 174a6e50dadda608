"""A cube column with operators. However deep the expression, it crosses to Python once.

    ndvi = (cube("nir") - cube("red")) / (cube("nir") + cube("red"))
    df.select(ndvi.to_type("float").column().alias("ndvi"))
"""

from __future__ import annotations

import ast
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.cube import DOUBLE, DTYPES, HEADER, Batch, Header, RasterError, compress, convert, format_code, type_code
from tilewright.operators import algebra

Groups = list  # of (Header, row numbers, cells)


def _aligned(left: Groups, right: Groups):
    """The parts of left and right that share rows: (head, rows, a, head of b, b)."""
    if len(left) == 1 and len(right) == 1 and np.array_equal(left[0][1], right[0][1]):
        yield left[0][0], left[0][1], left[0][2], right[0][0], right[0][2]
        return
    where = {int(r): (i, j) for i, (_, rows, _) in enumerate(right) for j, r in enumerate(rows)}
    for head, rows, a in left:
        parts: dict[int, list[tuple[int, int]]] = {}
        for j, r in enumerate(rows):
            if int(r) in where:
                i, k = where[int(r)]
                parts.setdefault(i, []).append((j, k))
        for i, pairs in parts.items():
            js, ks = map(list, zip(*pairs))
            yield head, rows[js], a[js], right[i][0], right[i][2][ks]


def evaluate(node: tuple, leaves: list) -> Groups:
    """The groups of a tree. leaves: Batch of each cube column, or an array of doubles (NaN where null) and a null mask."""
    kind = node[0]
    if kind == "leaf":
        return leaves[node[1]].groups
    if kind == "unary":
        return [(*_u(node[1], head, a, rows),) for head, rows, a in evaluate(node[2], leaves)]
    if kind == "type":
        return [(replace(head, data_type=node[1]), rows, convert(a, node[1]).astype(np.float64) if head.data_type != node[1] else a) for head, rows, a in evaluate(node[2], leaves)]
    if kind == "binary":
        left = evaluate(node[2], leaves)
        if node[3][0] in ("const", "scalar"):
            out = []
            for head, rows, a in left:
                if node[3][0] == "const":
                    b = np.full((len(rows), 1), node[3][1])
                else:
                    values, null = leaves[node[3][1]]
                    keep = ~null[rows]
                    rows, a = rows[keep], a[keep]
                    b = values[rows][:, None]
                out += _b(node[1], head, rows, a, None, b)
            return out
        out = []
        for head, rows, a, other, b in _aligned(left, evaluate(node[3], leaves)):
            out += _b(node[1], head, rows, a, other, b)
        return out
    raise ValueError(kind)


def _u(name, head, a, rows):
    head, cells = algebra.unary(name, head, a)
    return head, rows, cells


def _b(name, head, rows, a, other, b) -> Groups:
    if name == "set_nodata":
        if other is not None:
            return [(replace(head, data_type=DOUBLE, no_data=other.no_data), rows, a)]
        return [(replace(head, data_type=DOUBLE, no_data=float(v)), rows[b[:, 0] == v] if v == v else rows[np.isnan(b[:, 0])], a[b[:, 0] == v] if v == v else a[np.isnan(b[:, 0])]) for v in np.unique(b[:, 0])]
    head, cells = algebra.binary(name, head, a, other, b)
    return [(head, rows, cells)]


def to_column(groups: Groups, size: int, data_format: int = 0) -> pa.Array:
    """Cubes of groups as a binary column; rows in no group are null."""
    out: list = [None] * size
    for head, rows, cells in groups:
        fill(out, head, rows, cells, data_format)
    return pa.array(out, pa.binary())


def fill(out: list, head: Header, rows: np.ndarray, cells: np.ndarray, data_format: int = 0) -> None:
    """Puts the cubes of a matrix, tiles x cells, at their rows of out."""
    front = replace(head, data_format=data_format).pack()
    matrix = np.ascontiguousarray(cells, DTYPES[head.data_type]) if cells.dtype == DTYPES[head.data_type] else cells.astype(DTYPES[head.data_type])
    size, raw = matrix.shape[1] * matrix.itemsize, matrix.tobytes()
    for j, r in enumerate(rows.tolist()):
        out[r] = front + compress(raw[j * size : (j + 1) * size], data_format)


class CubeExpr:
    """A tree of cube operators over Spark columns."""

    def __init__(self, node: tuple, columns: list[Column], scalars: frozenset[int] = frozenset()):
        self.node, self.columns, self.scalars = node, columns, scalars

    def _join(self, other) -> tuple[tuple, list[Column], frozenset[int]]:
        if isinstance(other, CubeExpr):
            names = [str(c) for c in self.columns]
            columns, place = list(self.columns), {}
            for i, c in enumerate(other.columns):
                same = [j for j, n in enumerate(names) if n == str(c) and (j in self.scalars) == (i in other.scalars)]
                place[i] = same[0] if same else len(columns)
                if not same:
                    columns.append(c)
            scalars = self.scalars | {place[i] for i in other.scalars}
            return _renumber(other.node, place), columns, frozenset(scalars)
        if isinstance(other, Column):
            return ("scalar", len(self.columns)), [*self.columns, other.cast("double")], self.scalars | {len(self.columns)}
        return ("const", float(other)), self.columns, self.scalars

    def binary(self, name: str, other) -> CubeExpr:
        node, columns, scalars = self._join(other)
        return CubeExpr(("binary", name, self.node, node), columns, scalars)

    def unary(self, name: str) -> CubeExpr:
        return CubeExpr(("unary", name, self.node), self.columns, self.scalars)

    def to_type(self, kind: str | int) -> CubeExpr:
        return CubeExpr(("type", type_code(kind), self.node), self.columns, self.scalars)

    __add__ = lambda self, x: self.binary("add", x)
    __sub__ = lambda self, x: self.binary("subtract", x)
    __mul__ = lambda self, x: self.binary("multiply", x)
    __truediv__ = lambda self, x: self.binary("divide", x)
    __pow__ = __xor__ = lambda self, x: self.binary("pow", x)
    __mod__ = lambda self, x: self.binary("mod", x)
    __neg__ = lambda self: self.unary("neg")

    def _run(self, finish, kind) -> Column:
        node, scalars = self.node, self.scalars

        def run(*columns: pa.Array) -> pa.Array:
            leaves: list = []
            for i, c in enumerate(columns):
                leaves.append((c.fill_null(0.0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)) if i in scalars else Batch(c))
            return finish(evaluate(node, leaves), len(columns[0]))

        run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR if hasattr(F, "ArrowUDFType") else None)(*self.columns)

    def column(self, data_format: str = "RAW") -> Column:
        """The result as a binary cube column."""
        code = format_code(data_format)
        return self._run(lambda groups, size: to_column(groups, size, code), T.BinaryType())

    def apply(self, finish, kind: T.DataType) -> Column:
        """finish(head, cells of many tiles) -> one value a tile, in the same crossing to Python."""

        def done(groups: Groups, size: int) -> pa.Array:
            out: list = [None] * size
            for head, rows, cells in groups:
                for r, v in zip(rows.tolist(), finish(head, cells)):
                    out[r] = v
            return pa.array(out, from_spark(kind))

        return self._run(done, kind)


def from_spark(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _renumber(node: tuple, place: dict[int, int]) -> tuple:
    if node[0] in ("leaf", "scalar"):
        return node[0], place[node[1]]
    return tuple(_renumber(x, place) if isinstance(x, tuple) else x for x in node)


def cube(column: Column | str) -> CubeExpr:
    """A cube column to build expressions on."""
    return CubeExpr(("leaf", 0), [F.col(column) if isinstance(column, str) else column])


_SYMBOLS = {ast.Add: "add", ast.Sub: "subtract", ast.Mult: "multiply", ast.Div: "divide", ast.Pow: "pow", ast.BitXor: "pow", ast.Mod: "mod"}
_TESTS = {ast.Eq: "equal", ast.NotEq: "not_equal", ast.Lt: "less", ast.LtE: "less_equal", ast.Gt: "greater", ast.GtE: "greater_equal"}


def parse(text: str) -> CubeExpr:
    """Band algebra as text: `(nir - red) / (nir + red)`, `max(abs(a), 2) ^ 2`, `type(a * 100, int16)`; names are cube columns."""

    def build(node):
        if isinstance(node, ast.Name):
            return cube(node.id)
        if isinstance(node, ast.Constant):
            return float(node.value)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            inner = build(node.operand)
            return -inner
        if isinstance(node, ast.BinOp) and type(node.op) in _SYMBOLS:
            return _left(build(node.left)).binary(_SYMBOLS[type(node.op)], build(node.right))
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _TESTS:
            return _left(build(node.left)).binary(_TESTS[type(node.ops[0])], build(node.comparators[0]))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            name = node.func.id.lower()
            if name == "type" and len(node.args) == 2 and isinstance(node.args[1], ast.Name):
                return _left(build(node.args[0])).to_type(node.args[1].id)
            if name in algebra.UNARY and len(node.args) == 1:
                return _left(build(node.args[0])).unary(name)
            if name in algebra.BINARY_NAMES and len(node.args) == 2:
                return _left(build(node.args[0])).binary(name, build(node.args[1]))
        raise RasterError(f"Not band algebra: {ast.unparse(node)}")

    def _left(x) -> CubeExpr:
        if not isinstance(x, CubeExpr):
            raise RasterError("A cube must stand on the left of an operator")
        return x

    try:
        # ^ binds like a power, not like the loose operator it is in Python
        return _left(build(ast.parse(text.replace("^", "**"), mode="eval").body))
    except SyntaxError as e:
        raise RasterError(f"Not band algebra: {text}") from e


__all__ = ["HEADER", "CubeExpr", "Header", "cube", "evaluate", "parse", "to_column"]
