"""Run any operator over stored tables (for spark-submit).

    spark-submit --py-files slotwise.zip slotwise/__main__.py run owner_sales_headline --tables s3://lake/booking --out s3://lake/reports/headline \\
        --as-of "2001-06-15 12:00:00"
    spark-submit --py-files slotwise.zip slotwise/__main__.py run admit_bookings --tables DIR --requests DIR/requests --out DIR/admission
    python -m slotwise list

``--tables`` holds one parquet folder per table (see ``sources.tables.load_tables``).
Extra ``--param key=value`` pairs become keyword arguments (ints, floats,
true/false and text are recognised). A single DataFrame result is written to
``--out``; multi-output jobs write one folder per output; booking tables are
partitioned by booking_date.
"""

from __future__ import annotations

import argparse
import inspect
import sys

from pyspark.sql import DataFrame

from slotwise.operators import changes, dashboard, intervals, listings, quality, reports, search, vouchers
from slotwise.session import build_session
from slotwise.sources.tables import Tables, load_tables, write_table

MODULES = (search, listings, intervals, reports, vouchers, changes, quality, dashboard)


def operators() -> dict:
    ops = {}
    for mod in MODULES:
        for name, fn in vars(mod).items():
            if name.startswith("_") or not inspect.isfunction(fn) or fn.__module__ != mod.__name__:
                continue
            params = list(inspect.signature(fn).parameters)
            if params and params[0] == "t":
                ops[name] = fn
    return ops


def _value(text: str):
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    for cast in (int, float):
        try:
            return cast(text)
        except ValueError:
            pass
    return text


def _write(result, out: str) -> None:
    if isinstance(result, DataFrame):
        write_table(result, out, partition_by=["booking_date"] if "booking_date" in result.columns
                    and "total_amount" in result.columns else None)
    elif isinstance(result, Tables):
        for name, df in result.items():
            _write(df, f"{out}/{name}")
    elif isinstance(result, tuple) and hasattr(result, "_fields"):
        for name, df in zip(result._fields, result):
            if df is not None:
                _write(df, f"{out}/{name}")
    else:
        raise TypeError(f"cannot write {type(result).__name__}")


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="slotwise")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("operator")
    run.add_argument("--tables", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--requests")
    run.add_argument("--optional", action="append", default=[], help="a table that may be missing (repeat the option)")
    run.add_argument("--as-of")
    run.add_argument("--param", action="append", default=[])
    args = parser.parse_args(argv)
    ops = operators()
    if args.cmd == "list":
        for name in sorted(ops):
            print(name, inspect.signature(ops[name]))
        return 0
    fn = ops[args.operator]
    spark = build_session()
    t = load_tables(spark, args.tables, args.optional)
    kwargs = dict(p.split("=", 1) for p in args.param)
    kwargs = {k: _value(v) for k, v in kwargs.items()}
    params = inspect.signature(fn).parameters
    if "requests" in params:
        kwargs["requests"] = spark.read.parquet(args.requests)
    if "as_of" in params and args.as_of:
        kwargs["as_of"] = args.as_of
    _write(fn(t, **kwargs), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
