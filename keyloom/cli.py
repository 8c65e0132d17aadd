"""Command line with ten verbs: append dump export get index info keys merge sort values."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from keyloom.operators import ops, render
from keyloom.sources import register
from keyloom.sources.paths import index_path, local, split_existing


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyloom")
    p.add_argument("-v", "--verbose", action="count", default=0, help="accepted and ignored")
    sub = p.add_subparsers(dest="verb")
    verbs = {v: sub.add_parser(v) for v in ("append", "dump", "export", "get", "index", "info", "keys", "merge", "sort", "values")}
    for v in verbs.values():
        v.add_argument("paths", nargs="+")
    for v in ("append", "get"):
        verbs[v].add_argument("-k", "--key", required=True)
    verbs["append"].add_argument("-d", "--data", required=True)
    verbs["get"].add_argument("-n", type=int)
    for v in ("dump", "export"):
        verbs[v].add_argument("-f", "--format")
    for v in ("merge", "sort"):
        verbs[v].add_argument("-o", "--output")
        verbs[v].add_argument("--mode", choices=("errorifexists", "append", "overwrite"), default="errorifexists")
    for v in ("dump", "info", "export", "get"):
        verbs[v].add_argument("--compat", action="store_true")
    verbs["index"].add_argument("--rebuild", action="store_true", help="first write a complete index")
    return p


def _print(df: DataFrame, out) -> None:
    for row in ops.in_order(df).toLocalIterator():
        print(row["line"], file=out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args, out = parser().parse_args(argv), out or sys.stdout
    if not args.verb:
        return 0
    spark = spark or SparkSession.builder.appName("keyloom").getOrCreate()
    register(spark)
    if args.verb == "append":
        ops.append(spark, args.paths, args.key, args.data)
        return 0
    if args.verb == "info":
        print(*render.info_lines(ops.info(spark, args.paths, compat=args.compat).collect()), sep="\n", file=out)
        return 0
    if args.verb in ("merge", "sort"):
        for p in args.paths:
            for f in (p, index_path(p)):
                if f not in split_existing([f])[0]:
                    print(f"File does not exist: {f}", file=sys.stderr)
                    return 1
        merged = ops.merge(ops.read(spark, args.paths))
        if args.output:
            if local(args.output) in map(local, args.paths):
                print("the output is one of the inputs", file=sys.stderr)
                return 1
            ops.save_sorted(merged, args.output, args.mode)
        else:
            for row in render.lines(merged, "pair").toLocalIterator():
                print(row["line"], file=out)
        return 0
    there, missing = split_existing(args.paths)
    for p in missing:
        print(f"File does not exist: {p}", file=out)
    if not there:
        return 0
    if args.verb == "index":
        for p in there if args.rebuild else ():
            ops.rebuild_index(spark, p)
        _print(render.index_lines(ops.read(spark, there, mode="index")), out)
        return 0
    data = ops.read(spark, there)
    if args.verb == "dump":
        _print(render.dump_lines(ops.dump(data, args.compat)), out)
    elif args.verb == "export":
        form = args.format or "default"
        _print(render.lines(data, f"{form}_compat" if args.compat and form in ("json", "csv") else form), out)
    elif args.verb == "get" and args.compat:
        files = spark.createDataFrame([(i, split_existing([index_path(p)])[0] != []) for i, p in enumerate(there)], "file_ord int, indexed boolean")
        _print(ops.get_compat(data, ops.read(spark, there, mode="index", missing="skip"), files, args.key, args.n), out)
    elif args.verb == "get":
        _print(render.lines(ops.get(data, args.key, args.n)), out)
    else:
        col = "key" if args.verb == "keys" else "value"
        _print(data.selectExpr(f"{col} AS line", "file_ord", "offset"), out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
