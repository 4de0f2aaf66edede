"""Command line: list the queries, run one, print a company's flagged days or a share's revisions, the funnel, or the sources' verdicts."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidemark import plans
from tidemark import unlisted as timeline
from tidemark.operators import market
from tidemark.report import bundle, html, table_text
from tidemark.session import ship, table


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="list the named queries")
    run = sub.add_parser("run", help="run one query and print or write its rows")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out", help="folder for parquet output")
    study = sub.add_parser("analyze", help="a company's event study as JSON or HTML")
    study.add_argument("symbol")
    study.add_argument("--data", required=True)
    study.add_argument("--top", type=int, default=0)
    study.add_argument("--json")
    study.add_argument("--html")
    ingest = sub.add_parser("ingest", help="the funnel of collected items as JSON, and the items that were read")
    ingest.add_argument("--data", required=True)
    ingest.add_argument("--out", help="folder for the items")
    unlisted = sub.add_parser("unlisted", help="a share's price revisions and the news inside its moves")
    unlisted.add_argument("symbol")
    unlisted.add_argument("--data", required=True)
    unlisted.add_argument("--start", default="1900-01-01")
    unlisted.add_argument("--end", default="2999-12-31")
    unlisted.add_argument("--html")
    probe = sub.add_parser("probe", help="what each source lets one expect, and whether prices are there")
    probe.add_argument("--data", required=True)
    a = p.parse_args(argv)
    if a.command == "queries":
        print("\n".join(sorted(plans.queries())))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    if a.command == "run":
        found = plans.queries().get(a.name)
        if found is None:
            print(f"no query {a.name}", file=sys.stderr)
            return 2
        df = found(spark, a.data)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, False)
        return 0
    if a.command == "ingest":
        known = plans.queries()
        print(json.dumps(known["c9_counters"](spark, a.data).first().asDict(), indent=1))
        if a.out:
            known["c8_items"](spark, a.data).write.mode("overwrite").parquet(a.out)
        return 0
    if a.command == "probe":
        known = plans.queries()
        known["s32_verdicts"](spark, a.data).orderBy("source").show(200, False)
        known["s32_prices"](spark, a.data).orderBy("symbol").show(200, False)
        return 0
    if a.command == "unlisted":
        found = timeline.bundle(spark, market.frame(table(spark, a.data, "prices")), table(spark, a.data, "news"), a.symbol, a.start, a.end)
        print("\n".join(timeline.narrative(found)))
        if a.html:
            with open(a.html, "w") as f:
                f.write(timeline.html(found))
        return 0
    result = bundle(spark, a.data, a.symbol, a.top)
    print(table_text(result["incidents"]))
    if a.json:
        with open(a.json, "w") as f:
            json.dump(result, f, indent=1, default=str)
    if a.html:
        with open(a.html, "w") as f:
            f.write(html(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
