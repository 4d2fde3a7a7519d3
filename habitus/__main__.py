"""Command line: the batch steps and the reads."""

from __future__ import annotations

import argparse

from habitus.operators.profile import describe, feature_summary, sample_rows
from habitus.operators.serving import stats, threats, user_timeline
from habitus.plans.rebuild import build_features, load, prepare_serving, run_detection
from habitus.session import build_session
from habitus.sources.tables import lookup, resolve_path, resolve_scores


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="habitus")
    parser.add_argument("--out", default="outputs", help="folder of the stage tables")
    steps = parser.add_subparsers(dest="step", required=True)
    steps.add_parser("load").add_argument("--data", default="data")
    for name in ("features", "detect", "stats"):
        steps.add_parser(name)
    steps.add_parser("serving").add_argument("--buckets", type=int, help="folders by actor")
    page = steps.add_parser("threats")
    page.add_argument("--min-severity", default="Low")
    page.add_argument("--include-drift", action="store_true")
    page.add_argument("--user")
    page.add_argument("--regex", action="store_true", help="--user is a pattern")
    page.add_argument("--department")
    page.add_argument("--limit", type=int, default=500)
    page.add_argument("--offset", type=int, default=0)
    history = steps.add_parser("timeline")
    history.add_argument("user")
    history.add_argument("--buckets", type=int, help="as given to serving")
    history.add_argument("--save", help="write the days to this folder (CSV) instead")
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = build_session()
    if args.step == "load":
        for name, summary in load(spark, args.data, args.out).items():
            print(name)
            summary.show(truncate=False)
    elif args.step == "features":
        days = build_features(spark, args.out)
        for table in (feature_summary(days), sample_rows(days), describe(days)):
            table.show(truncate=False)
    elif args.step == "detect":
        run_detection(spark, args.out).show()
    elif args.step == "serving":
        prepare_serving(spark, args.out, buckets=args.buckets).show()
    elif args.step == "stats":
        stats(resolve_scores(spark, args.out)).show(vertical=True)
    elif args.step == "threats":
        page = threats(
            resolve_scores(spark, args.out),
            args.min_severity,
            args.include_drift,
            args.user,
            args.department,
            args.limit,
            args.offset,
            args.regex,
        )
        page.total_matching.show()
        page.results.show(args.limit, truncate=False)
    else:
        days = lookup(spark, resolve_path(spark, args.out), args.user, buckets=args.buckets)
        timeline = user_timeline(days, args.user)
        timeline.header.show(vertical=True)
        if args.save:
            timeline.days.write.mode("overwrite").option("header", True).csv(args.save)
        else:
            print(*timeline.days.columns, sep="\t")
            for day in timeline.days.toLocalIterator():
                print(*day, sep="\t")


if __name__ == "__main__":
    main()
