"""Command line for the whole job, for ``spark-submit pinax/cli.py ...``.

    run       workbooks -> panel, country table, indexed panel, series, gap to nation
    coverage  panel localities missing from entity lists scraped from web pages

The session comes from spark-submit (master, resources, ``spark.checkpoint.dir``);
``build_session`` only adds this library's settings.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pinax.plans import stages  # noqa: E402
from pinax.session import build_session  # noqa: E402
from pinax.sources import html, workbook  # noqa: E402
from pinax.sources.files import write_table  # noqa: E402


def _run(args, spark) -> dict:
    header = args.header or workbook_header()
    rows = workbook.read_workbooks(spark, args.workbooks, sheets=args.sheets, skip_rows=args.skip_rows,
                                   header=header)
    raw = workbook.sheet_frame(rows, header, strict=not args.lenient)
    headers = workbook.sheet_headers(spark, args.workbooks, args.skip_rows, args.sheets)
    previous = spark.read.parquet(args.previous) if args.previous else None
    dim = spark.read.parquet(args.entities) if args.entities else None
    return stages.run(spark, raw, args.out, selected=args.select, base=args.base,
                      thousands_sep=args.thousands_sep, previous=previous, dim=dim,
                      fail_on=stages.MUST_BE_EMPTY if args.strict_checks else None, headers=headers, expected=header)


def _coverage(args, spark) -> dict:
    panel = spark.read.parquet(args.panel)
    pages = spark.read.parquet(args.pages)
    def of(page: int):
        return html.html_tables(pages.filter(pages.page_id == page))  # only this page is parsed

    current = stages.entity_list(of(args.current_page), args.current_table, args.current_header_rows, "Name",
                                 occurrence=args.current_occurrence)
    former = stages.entity_list(of(args.former_page), args.former_table, args.former_header_rows, "Name")
    missing = stages.coverage(panel, stages.communes(current, former))
    write_table(missing, args.out)
    return {"missing": args.out}


def workbook_header() -> list[str]:
    from pinax.plans.panels import SHEET_HEADERS
    return list(SHEET_HEADERS)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="pinax")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run", help="clean workbooks, index, write all outputs")
    r.add_argument("--workbooks", required=True, help="folder or glob of .xlsx files (any Spark filesystem)")
    r.add_argument("--out", required=True)
    r.add_argument("--skip-rows", type=int, default=6)
    r.add_argument("--sheets", nargs="*", default=None)
    r.add_argument("--header", nargs="*", default=None, help="declared header texts")
    r.add_argument("--select", nargs="*", default=None, help="localities for the series output")
    r.add_argument("--base", type=int, default=stages.BASE_YEAR)
    r.add_argument("--thousands-sep", default=None, help="grouping character in number cells, such as ,")
    r.add_argument("--previous", default=None, help="panel of an earlier run, to report changed values")
    r.add_argument("--entities", default=None, help="parquet table (commune), to report localities it lacks")
    r.add_argument("--strict-checks", action="store_true", help="stop when a check that must be empty has rows")
    r.add_argument("--lenient", action="store_true", help="drop unreadable workbooks instead of failing")
    c = sub.add_parser("coverage", help="panel localities missing from scraped entity lists")
    c.add_argument("--panel", required=True)
    c.add_argument("--pages", required=True, help="parquet table (page_id, url, html)")
    c.add_argument("--out", required=True)
    c.add_argument("--current-page", type=int, default=1)
    c.add_argument("--current-table", type=int, default=1)
    c.add_argument("--current-header-rows", type=int, default=2)
    c.add_argument("--current-occurrence", type=int, default=2)
    c.add_argument("--former-page", type=int, default=2)
    c.add_argument("--former-table", type=int, default=2)
    c.add_argument("--former-header-rows", type=int, default=1)
    args = p.parse_args(argv)
    spark = build_session()
    out = _run(args, spark) if args.cmd == "run" else _coverage(args, spark)
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
