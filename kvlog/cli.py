"""Command line: put, get, delete, scan.  Exit codes: 0 done, 1 failure, 2 usage, 3 not found."""

from __future__ import annotations

import argparse
import base64
import json
import sys

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .model import NotFound, StatusError
from .sources.store import Store


def base64_column(c: Column) -> Column:
    """Base64 without the line breaks that the built-in function inserts."""
    return F.regexp_replace(F.base64(c), "\r\n", "")


def json_lines(view):
    """One JSON object a row of a (key, value) view."""
    return view.select(F.to_json(F.struct(base64_column(F.col("key")).alias("key_base64"), base64_column(F.col("value")).alias("value_base64"))).alias("line"))


def main(argv: list[str] | None = None, out=sys.stdout, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="kvlog")
    p.add_argument("path")
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in (("put", ("key", "value")), ("get", ("key",)), ("delete", ("key",)), ("scan", ())):
        s = sub.add_parser(name)
        for x in extra:
            s.add_argument(x)
        if name == "scan":
            s.add_argument("begin", nargs="?", default="")
            s.add_argument("end", nargs="?", default="")
            s.add_argument("--json", action="store_true")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        with Store.open(spark, a.path) as store:
            if a.command == "put":
                store.put(a.key.encode(), a.value.encode())
            elif a.command == "delete":
                store.delete(a.key.encode())
            elif a.command == "get":
                out.write(store.get(a.key.encode()).decode("utf-8", "surrogateescape") + "\n")
            else:
                code = lambda b: base64.b64encode(bytes(b)).decode()
                for r in store.scan(a.begin.encode(), a.end.encode()).toLocalIterator():
                    if a.json:
                        out.write(json.dumps({"key_base64": code(r["key"]), "value_base64": code(r["value"])}, separators=(",", ":")) + "\n")
                    else:
                        out.write(bytes(r["key"]).decode("utf-8", "surrogateescape") + "\t" + bytes(r["value"]).decode("utf-8", "surrogateescape") + "\n")
    except NotFound:
        return 3
    except StatusError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
