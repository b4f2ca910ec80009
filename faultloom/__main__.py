"""Command line: ``python -m faultloom cards|cluster|search ...``; sessions come from spark-submit or are local."""

from __future__ import annotations

import argparse
import json

from .session import get_session


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="faultloom")
    sub = parser.add_subparsers(dest="command", required=True)
    cards = sub.add_parser("cards", help="crash folders to cards, buckets and weights")
    cards.add_argument("--input", required=True)
    cards.add_argument("--out", required=True)
    cards.add_argument("--ground-truth")
    cards.add_argument("--limit-bugs", type=int)
    cards.add_argument("--limit-crashes-per-bug", type=int)
    cards.add_argument("--resume", action="store_true")
    cluster = sub.add_parser("cluster", help="weights and cause cards to a scored clustering")
    cluster.add_argument("--weights", required=True)
    cluster.add_argument("--cause-cards", required=True)
    cluster.add_argument("--out", required=True)
    cluster.add_argument("--dims", type=int, default=64)
    cluster.add_argument("--dry-run", action="store_true")
    search = sub.add_parser("search", help="one operation of the source search")
    search.add_argument("--source", required=True)
    search.add_argument("tool", help="an operation, such as grep, function or struct")
    search.add_argument("arguments", help="its arguments as a JSON object")
    return parser.parse_args()


def main() -> None:
    from .operators import source_search as ss
    from .plans import stages
    from .sources import artifacts as ar

    a = _arguments()
    spark = get_session()
    if a.command == "cards":
        stages.crash_card_stage(spark, a.input, a.out, a.ground_truth, a.limit_bugs, a.limit_crashes_per_bug, a.resume).show(truncate=False)
    elif a.command == "cluster":
        found = stages.clustering_stage(spark, ar.csv_table(spark, a.weights), spark.read.json(a.cause_cards), a.out, dims=a.dims, dry_run=a.dry_run)
        if found is not None:
            found.show(truncate=False)
    else:
        lines = ss.source_lines(ar.source_tree(spark, a.source))
        print(ss.execute_tool(lines, f"code_searcher_{a.tool}", json.loads(a.arguments)))


if __name__ == "__main__":
    main()
