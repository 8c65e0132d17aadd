"""Text forms of tables: a ``line`` column beside the sequence columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import debug_quoted, hex_list


def _text(c: Column) -> Column:
    return c.cast("string")


RENDERERS = {
    "default": lambda k, v: F.concat(_text(k), F.lit(": "), _text(v)),
    "pair": lambda k, v: F.concat(F.lit("("), _text(k), F.lit(", "), _text(v), F.lit(")")),
    "tsv": lambda k, v: F.concat(_text(k), F.lit("\t"), _text(v)),
    "tsv_hex": lambda k, v: F.concat(hex_list(k), F.lit("\t"), hex_list(v)),
    "json": lambda k, v: F.to_json(F.map_from_arrays(F.array(_text(k)), F.array(_text(v)))),
    "csv": lambda k, v: F.to_csv(F.struct(_text(k).alias("key"), _text(v).alias("value")), {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}),
    # without escaping, as the established tool prints them
    "json_compat": lambda k, v: F.concat(F.lit('{"'), _text(k), F.lit('": "'), _text(v), F.lit('"},')),
    "csv_compat": lambda k, v: F.concat(_text(k), F.lit(","), _text(v)),
}


def lines(df: DataFrame, form: str = "default") -> DataFrame:
    """A line per row; an unknown form falls back to ``key: value``."""
    make = RENDERERS.get(form, RENDERERS["default"])
    return df.select(make(F.col("key"), F.col("value")).alias("line"), "file_ord", "offset")


def dump_lines(df: DataFrame) -> DataFrame:
    line = F.concat(F.lit("("), F.col("offset").cast("string"), F.lit(") "), debug_quoted(F.col("key")), F.lit(": "), debug_quoted(F.col("value")))
    return df.select(line.alias("line"), "file_ord", "offset")


def index_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(debug_quoted(F.col("key")), F.lit(": "), F.col("offset").cast("string")).alias("line"), "file_ord", F.col("ordinal").alias("offset"))


def info_lines(rows) -> list[str]:
    """Block of lines per row of ``ops.info``; as many rows as paths were asked for."""
    out = []
    mark = lambda ok: "(exists ✔)" if ok else "(missing ✘)"
    flag = {True: "true", False: "false"}
    for r in sorted(rows, key=lambda r: r["pos"]):
        out += ["---", f"data path: {r['path']} {mark(r['data_exists'])}"]
        out += [f" size: {r['data_size']}"] if r["data_exists"] else []
        out.append(f"index path: {r['index_path']} {mark(r['index_exists'])}")
        if r["index_exists"]:
            out += [f" size: {r['index_size']}", f" count: {r['count']}", f" sorted: {r['sorted']}", f" min: {r['min']}", f" max: {r['max']}", f" unique: {flag[r['unique']]}"]
    return out
