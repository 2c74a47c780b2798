"""python -m treeledger index ROOT [--quiet] | report ROOT [--hours N] [--json] [--diagnostics] | collect ROOT [--dry-run]"""

from __future__ import annotations

import argparse
import json
import sys

from treeledger.api import Ledger
from treeledger.session import build_session, ship_library


def render(report: dict, scope: str) -> str:
    asked = report["cache_hits"] + report["cache_misses"]
    ratio = f"{report['hit_ratio'] * 100:.1f}%" if asked else "n/a"
    lines = [f"Events of {scope}: {report['total_events']:,} ({report['cache_hits']:,} hits, {report['cache_misses']:,} misses, ratio {ratio})", f"Tokens saved: {report['tokens_saved']:,}"]
    lines += [f"  {k}: {n:,}" for k, n in sorted((report["events_by_type"] or {}).items())]
    lines += [f"  {f['n_events']:,} x {f['file_path']} ({f['tokens']:,} tokens)" for f in report["top_files"][:5]]
    lines += [f"  {q['n_missed']:,} x no match for {q['query']!r}" for q in report["top_missed_queries"][:5]]
    if "diagnostics" in report:
        d = report["diagnostics"]
        lines.append(f"Stored files: {d['entries']:,} ({d['stale']:,} stale), {d['bytes'] / 2**20:.1f} MB; " + ", ".join(f"{n:,} of {age}" for age, n in d["ages"].items()))
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="treeledger")
    parser.add_argument("command", choices=("index", "report", "collect"))
    parser.add_argument("root", nargs="?", default=".")
    parser.add_argument("--hours", type=float)
    for flag in ("--json", "--diagnostics", "--quiet", "--dry-run"):
        parser.add_argument(flag, action="store_true")
    args = parser.parse_args(argv)
    if args.hours is not None and not args.hours > 0:
        parser.error("--hours must be a positive number")
    spark = build_session()
    ship_library(spark)
    ledger = Ledger(spark, args.root)
    if args.command != "report":
        counts = ledger.index() if args.command == "index" else ledger.collect_garbage(args.dry_run)
        if not args.quiet:
            print(", ".join(f"{n:,} {k.replace('_', ' ')}" for k, n in counts.items()))
        return 0
    report = ledger.get_token_report(args.hours).first().asDict(recursive=True)
    if args.diagnostics:
        state = ledger.diagnostics()
        report["diagnostics"] = {"entries": state["entries"], "stale": state["stale"].count(), "bytes": state["bytes"], "ages": {r["age"]: r["n_files"] for r in state["ages"].collect()}}
    print(json.dumps(report, indent=2) if args.json else render(report, f"the last {args.hours:g} hours" if args.hours else "all time"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
