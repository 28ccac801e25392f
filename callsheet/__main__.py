"""Command line.

    python -m callsheet summary --source /data --portfolio 518 --out /counts
    python -m callsheet list geral --source /data --portfolio 518 --label "Banco IV" \\
        --phones 3 --min-sum 50.000,00 --out /lists
    python -m callsheet list today --source /data --out /lists
    python -m callsheet list week --source /data --out /lists
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Sequence
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.functions.amounts import parse_br_amount
from callsheet.operators.accounts import in_portfolio
from callsheet.operators.portfolios import portfolio_counts, portfolio_total
from callsheet.params import PHONE_SLOTS, REPEATED_DIGIT_LITERAL, CampaignParams
from callsheet.plans.campaigns import campaign_list, weekly_lists
from callsheet.plans.catalogue import CORE, PORTFOLIOS, WEEK
from callsheet.session import session_builder
from callsheet.sinks.csv import export_lists, write_csv
from callsheet.sources.tables import load


def arguments(argv: Sequence[str]) -> argparse.Namespace:
    codes = [code for code, _, _ in PORTFOLIOS]
    parser = argparse.ArgumentParser(prog="callsheet")
    commands = parser.add_subparsers(dest="command", required=True)

    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--source", required=True, help="Parquet folder, catalog:database or jdbc: URL")
    shared.add_argument("--jdbc-options", type=Path, help="JSON file with user, password and driver")
    shared.add_argument("--out", required=True, help="new folder for the files")
    shared.add_argument("--portfolio", type=int, action="append", choices=codes, help="default: all")

    commands.add_parser("summary", parents=[shared], help="accounts per label, and in total")
    make = commands.add_parser("list", parents=[shared], help="write lists as CSV")
    make.add_argument("campaign", choices=["today", "week", *[c.id for c in (*WEEK, *CORE)]])
    make.add_argument("--label", action="append", default=[], help="may be given many times")
    make.add_argument("--phones", type=int, default=PHONE_SLOTS)
    make.add_argument("--min-sum", help="amount such as 50.000,00")
    make.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today())
    make.add_argument("--agreements-since", type=dt.date.fromisoformat)
    make.add_argument("--contact-days", type=int, help="days without contact, 30 if not given")
    make.add_argument("--recent-months", type=int, help="months of the recent base, 2 if not given")
    make.add_argument("--exclude-system-events", action="store_true")
    make.add_argument("--dedupe-sum", action="store_true", help="count an invoice once in the sum")
    make.add_argument("--literal-digit-run", action="store_true", help="a digit and five ones as digit run")
    make.add_argument("--last-contact", action="store_true", help="add the last contact columns")
    make.add_argument("--rows-per-file", type=int)

    parsed = parser.parse_args(argv)
    parsed.portfolio = tuple(parsed.portfolio or codes)
    return parsed


def _amount(spark: SparkSession, text: str | None) -> Decimal | None:
    if text is None:
        return None
    return spark.range(1).select(parse_br_amount(F.lit(text), strict=True)).first()[0]


def run_summary(tables: dict[str, DataFrame], args: argparse.Namespace) -> None:
    """Counts per label and totals, as files."""
    accounts = in_portfolio(tables["cadastros_tb"], args.portfolio)
    write_csv(portfolio_total(accounts, args.portfolio), f"{args.out}/totals", files=1)
    write_csv(portfolio_counts(accounts), f"{args.out}/labels")


def run_list(tables: dict[str, DataFrame], args: argparse.Namespace, spark: SparkSession) -> None:
    names = ("agreements_since", "contact_days", "recent_months")
    options = {n: getattr(args, n) for n in names if getattr(args, n) is not None}
    if args.literal_digit_run:
        options["repeated_digits"] = REPEATED_DIGIT_LITERAL
    params = CampaignParams(
        portfolios=args.portfolio,
        labels=tuple(args.label),
        max_phones=args.phones,
        min_sum=_amount(spark, args.min_sum),
        as_of=args.as_of,
        exclude_system_events=args.exclude_system_events,
        dedupe_sum=args.dedupe_sum,
        **options,
    )
    if args.campaign == "week":
        lists = weekly_lists(tables, params, with_last_contact=args.last_contact)
    else:
        due = [
            c
            for c in (*WEEK, *CORE)
            if c.id == args.campaign
            or (args.campaign == "today" and c.weekday == args.as_of.weekday())
        ]
        if not due:
            raise SystemExit("no list is due on this day")
        lists = campaign_list(tables, due[0], params, args.last_contact, with_keys=True)
    export_lists(lists, args.out, dt.datetime.now(), args.label, args.rows_per_file)


def main(argv: Sequence[str], spark: SparkSession | None = None) -> None:
    args = arguments(argv)
    spark = spark or session_builder().getOrCreate()
    jdbc = json.loads(args.jdbc_options.read_text()) if args.jdbc_options else None
    tables = load(spark, args.source, jdbc)
    if args.command == "summary":
        run_summary(tables, args)
    else:
        run_list(tables, args, spark)


if __name__ == "__main__":
    main(sys.argv[1:])
