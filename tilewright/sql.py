"""SQL text: the table functions RT_Read, RT_ReadCells, RT_Create, RT_Drivers, RT_GdalConfig, and statements in a wider dialect.

    spark.sql("SELECT id, databand_1 FROM RT_Read('/data/a.tif', blocksize_x => 256, blocksize_y => 256)")
    run(spark, "SELECT count(*) FROM 'a.tif'")
    run(spark, "COPY (SELECT * FROM RT_Read(['a.tif', 'b.tif'], blocksize_x := 256, blocksize_y := 256)) TO 'c.tif' WITH (FORMAT RASTER, DRIVER 'COG')")

run() takes raster files as tables, named arguments with :=, lists in square brackets and COPY … (FORMAT RASTER).
A table function runs in one task; run() therefore reads files with literal arguments through the data source,
which spreads the same tiles over the cluster. Algebra on cubes has functions in SQL text, not operator symbols;
tilewright.plans.expr.parse takes the symbols.
"""

from __future__ import annotations

import ast
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LISTS = ("open_options", "allowed_drivers", "sibling_files", "warp_options", "bands")
_PLAIN = ("separate_bands", "data_format", "blocksize_x", "blocksize_y", "skip_empty_tiles", "datacube", "ignore_nodata")


def options_of(path, named: dict) -> dict:
    out = {"paths": json.dumps(path)} if isinstance(path, (list, tuple)) else {"path": path}
    for name, value in named.items():
        if name not in (*_LISTS, *_PLAIN):
            raise ValueError(f"Unknown argument: {name}")
        if value is not None:
            out[name] = json.dumps(list(value)) if name in _LISTS else str(value).lower() if isinstance(value, bool) else str(value)
    return out


def _scan(source):
    class Scan:
        @staticmethod
        def analyze(path, **named):
            from pyspark.sql.udtf import AnalyzeResult

            options = options_of(path.value, {k: v.value for k, v in named.items()})
            return AnalyzeResult(schema=source(options).schema())

        def eval(self, path, **named):
            from tilewright.sources.reader import Tiles

            options = options_of(path, named)
            made = source(options)
            reader = made.reader(made.schema())
            for part in reader.partitions():
                if isinstance(part, Tiles):
                    for batch in reader.read(part):
                        for row in batch.to_pylist():
                            yield tuple(row.values())

    return Scan


def register(spark: SparkSession) -> None:
    from tilewright.sources.reader import CellSource, RasterSource

    spark.udtf.register("RT_Read", F.udtf(_scan(RasterSource)))
    spark.udtf.register("RT_ReadCells", F.udtf(_scan(CellSource)))

    class Create:
        @staticmethod
        def analyze(path, crs, xmin, ymin, xmax, ymax, width, height, num_bands, data_type, nodata, **named):
            from pyspark.sql.udtf import AnalyzeResult

            from tilewright.sources.reader import TILE_FIELDS

            cube = named["datacube"].value if "datacube" in named else False
            bands = ["datacube"] if cube else [f"databand_{i + 1}" for i in range(num_bands.value)]
            return AnalyzeResult(schema=T.StructType([T.StructField(n, t) for n, t in TILE_FIELDS] + [T.StructField(b, T.BinaryType()) for b in bands]))

        def eval(self, path, crs, xmin, ymin, xmax, ymax, width, height, num_bands, data_type, nodata, **named):
            from tilewright.sources.create import created_tiles

            yield from created_tiles(path, crs, float(xmin), float(ymin), float(xmax), float(ymax), width, height, num_bands, data_type, float(nodata), **named)

    spark.udtf.register("RT_Create", F.udtf(Create))

    class Drivers:
        def eval(self):
            from tilewright.sources.dataset import DRIVERS

            for name, (_, opener, long, can_create, can_copy) in DRIVERS.items():
                yield name, long, can_create, can_copy, opener is not None, None

    spark.udtf.register("RT_Drivers", F.udtf(Drivers, returnType="short_name string, long_name string, can_create boolean, can_copy boolean, can_open boolean, help_url string"))
    spark.udf.register("RT_GdalConfig", F.udf(lambda key, value: True, T.BooleanType()))


# ---- statements ----

_STRING = r"'(?:[^']|'')*'"


def _outside(text: str, change) -> str:
    """Applies change to the parts of a text that are not string literals."""
    return "".join(part if part.startswith("'") else change(part) for part in re.split(f"({_STRING})", text))


def _lists(text: str) -> str:
    """Lists in square brackets as array(…); subscripts stay."""
    out, stack = [], []
    parts = re.split(f"({_STRING})", text)
    for part in parts:
        if part.startswith("'"):
            out.append(part)
            continue
        for ch in part:
            if ch == "[":
                before = "".join(out).rstrip()
                subscript = bool(re.search(r"[\w\])\"`]$", before)) and not re.search(r"\b(ENVELOPE|DATABAND_COLUMNS|SELECT|IN|AND|OR)$", before, re.IGNORECASE)
                stack.append("]" if subscript else ")")
                out.append("[" if subscript else "array(")
            elif ch == "]":
                out.append(stack.pop() if stack else "]")
            else:
                out.append(ch)
    return "".join(out)


def _arguments(text: str) -> tuple | None:
    """(path, named arguments) of a table function's literal arguments; None if any is not a literal."""
    words = {"true": "True", "false": "False", "null": "None"}
    change = lambda t: re.sub(r"(\w+)\s*=>", r"\1=", re.sub(r"\b(true|false|null)\b", lambda m: words[m[0].lower()], t, flags=re.IGNORECASE)).replace("array(", "list((")
    plain = _outside(text, change)
    try:
        call = ast.parse("f(" + text_to_python(plain) + ")", mode="eval").body
        value = lambda node: [value(x) for x in (node.args[0].elts if isinstance(node.args[0], ast.Tuple) else node.args)] if isinstance(node, ast.Call) and getattr(node.func, "id", "") == "list" else ast.literal_eval(node)
        return [value(a) for a in call.args], {k.arg.lower(): value(k.value) for k in call.keywords}
    except (SyntaxError, ValueError, AttributeError, IndexError):
        return None


def text_to_python(text: str) -> str:
    """list(( … ) of a rewritten array gets its missing bracket; '' inside a string becomes an escape."""
    out, depth = [], []
    for part in re.split(f"({_STRING})", text):
        if part.startswith("'"):
            out.append(repr(part[1:-1].replace("''", "'")))
            continue
        i = 0
        while i < len(part):
            if part.startswith("list((", i):
                out.append("list((")
                depth.append(",))")
                i += 6
            elif part[i] == "(":
                out.append("(")
                depth.append(")")
                i += 1
            elif part[i] == ")":
                out.append(depth.pop() if depth else ")")
                i += 1
            else:
                out.append(part[i])
                i += 1
    return "".join(out).replace("(,)", "()")


def _close(text: str, start: int) -> int:
    """Where the bracket that opens at start closes."""
    depth, quoted = 0, False
    for i in range(start, len(text)):
        if text[i] == "'":
            quoted = not quoted
        elif not quoted:
            depth += (text[i] == "(") - (text[i] == ")")
            if not depth:
                return i
    raise ValueError("a bracket that does not close")


def _scans(spark: SparkSession, text: str) -> str:
    """RT_Read and RT_ReadCells of literal arguments as views on the data source."""
    from tilewright.sources.reader import read_tiles

    at = 0
    while found := re.compile(r"\bRT_Read(Cells)?\s*\(", re.IGNORECASE).search(text, at):
        end = _close(text, found.end() - 1)
        given = _arguments(text[found.end() : end])
        if given is None or len(given[0]) != 1:
            at = found.end()
            continue
        view = f"raster_{uuid.uuid4().hex}"
        named = {k: v for k, v in given[1].items() if v is not None}
        read_tiles(spark, given[0][0], cells=bool(found[1]), **named).createOrReplaceTempView(view)
        text = text[: found.start()] + view + text[end + 1 :]
        at = found.start() + len(view)
    return text


def run(spark: SparkSession, text: str) -> DataFrame:
    """Runs a statement; COPY gives one row with the number of rows that it wrote."""
    from tilewright.functions import register_all
    from tilewright.sources.writer import write_raster

    register_all(spark)
    text = re.sub(r"/\*.*?\*/|--[^\n]*", " ", text, flags=re.DOTALL).strip().rstrip(";").strip()
    text = _lists(_outside(text, lambda t: t.replace(":=", "=>")))
    if re.match(r"COPY\b", text, re.IGNORECASE):
        start = text.index("(")
        end = _close(text, start)
        target = re.match(rf"\s*TO\s*({_STRING})\s*(?:WITH\s*)?\(", text[end + 1 :], re.IGNORECASE)
        if not target:
            raise ValueError("COPY needs TO 'path' and options")
        body = text[end + 1 + target.end() : _close(text, end + target.end())]
        named = dict(re.findall(rf"\b([A-Za-z_]+)\s+((?:array)?\((?:[^()']|{_STRING})*\)|{_STRING}|[\w.+-]+)", body))
        named = {k.lower(): v for k, v in named.items()}
        if named.pop("format", "").strip("'").upper() != "RASTER":
            raise ValueError("COPY is for FORMAT RASTER; other formats have df.write")
        options = {}
        for k, v in named.items():
            if v.startswith(("array(", "(")):
                options[k] = [x[1:-1] if x.startswith("'") else float(x) for x in re.findall(rf"{_STRING}|[-+\d.eE]+", v[v.index("(") :])]
            else:
                options[k] = v[1:-1] if v.startswith("'") else v.lower() == "true" if v.lower() in ("true", "false") else v
        n = write_raster(run(spark, text[start + 1 : end]), target[1][1:-1].replace("''", "'"), **options)
        return spark.createDataFrame([(n,)], "count long")
    text = _states(_configured(spark, _files(text)))
    return spark.sql(_scans(spark, text))


def _states(text: str) -> str:
    """RT_CubeStats_Agg(…) over states: a small one a tile is shuffled, not the tile."""
    at = 0
    while found := re.compile(r"\bRT_CubeStats_Agg\s*\(", re.IGNORECASE).search(text, at):
        end = _close(text, found.end() - 1)
        head = f"{text[: found.start()]}RT_CubeStatsMerge(collect_list(RT_CubeState("
        at, text = len(head), f"{head}{text[found.end() : end]}))){text[end + 1 :]}"
    return text


def _configured(spark: SparkSession, text: str) -> str:
    """Carries out RT_GdalConfig('key', 'value') where both are literals; what it gives is true."""
    from tilewright.functions import rt_gdal_config

    def put(found: re.Match) -> str:
        value = None if found[2].upper() == "NULL" else found[2][1:-1].replace("''", "'")
        return str(rt_gdal_config(spark, found[1][1:-1], value)).lower()

    return re.sub(rf"\bRT_GdalConfig\s*\(\s*({_STRING})\s*,\s*({_STRING}|NULL)\s*\)", put, text, flags=re.IGNORECASE)


def _files(text: str) -> str:
    """Raster files that stand where a table does become scans."""
    return re.sub(rf"\b(FROM|JOIN)(\s+)({_STRING})", lambda m: f"{m[1]}{m[2]}RT_Read({m[3]})" if re.search(r"\.(img|tiff?|vrt)'$", m[3], re.IGNORECASE) else m[0], text, flags=re.IGNORECASE)
