"""Command line: generate, run, evaluate, feedback, alerts."""

from __future__ import annotations

import argparse

from .operators import feedback, views
from .plans import batch
from .session import build_session
from .sources import sinks, synth


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ledgermill")
    sub = p.add_subparsers(dest="what", required=True)
    g = sub.add_parser("generate", help="write synthetic transactions and ground truth")
    g.add_argument("folder")
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--scale", type=int, default=1)
    r = sub.add_parser("run", help="analyse transaction files")
    r.add_argument("out")
    r.add_argument("paths", nargs="+")
    r.add_argument("--cidr")
    e = sub.add_parser("evaluate", help="compare a run with ground truth")
    e.add_argument("out")
    e.add_argument("truth")
    f = sub.add_parser("feedback", help="record an analyst's label")
    f.add_argument("out")
    f.add_argument("entity_id")
    f.add_argument("label", choices=["illicit", "benign"])
    f.add_argument("note", nargs="?", default="")
    a = sub.add_parser("alerts", help="show the ranking")
    a.add_argument("out")
    a.add_argument("--min-score", type=float, default=0.6)
    a.add_argument("--typology", action="append")
    args = p.parse_args(argv)
    spark = build_session()
    if args.what == "generate":
        sinks.write_transactions(*synth.generate(spark, args.seed, args.scale), args.folder)
    elif args.what == "run":
        done = batch.run(spark, args.paths, args.out, args.cidr)
        print(sinks.summary(done.ranked))
    elif args.what == "evaluate":
        print(batch.evaluate_run(spark, args.out, args.truth))
    elif args.what == "feedback":
        feedback.record(spark, f"{args.out}/feedback.csv", args.entity_id, args.label == "illicit", args.note)
    else:
        views.alerts(spark.read.parquet(f"{args.out}/ranked.parquet"), args.min_score, args.typology).orderBy("rank").show(50, truncate=False)


if __name__ == "__main__":
    main()
