"""python -m pagelake run | perf | score: the engine from the command line."""

from __future__ import annotations

import argparse
import json


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pagelake", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="documents below a folder -> silver")
    run.add_argument("input")
    run.add_argument("output")
    run.add_argument("--pages", choices=("pdf", "text"), default="pdf")
    run.add_argument("--mode", choices=("overwrite", "merge", "resume"), default="overwrite")
    run.add_argument("--max-cost-usd", type=float)
    perf = commands.add_parser("perf", help="throughput of the OCR step")
    perf.add_argument("--n", type=int, default=20)
    perf.add_argument("--report")
    for p in (run, perf):
        p.add_argument("--backend", default="mock")
        p.add_argument("--model", default="mock-model")
    score = commands.add_parser("score", help="silver against a folder of ground truth")
    score.add_argument("silver")
    score.add_argument("truth")
    a = parser.parse_args(args)

    from pagelake.operators import reports, store
    from pagelake.operators.evaluate import Evaluator
    from pagelake.plans.pipeline import OCRPipeline
    from pagelake.session import get_spark

    spark = get_spark()
    if a.command == "run":
        silver = OCRPipeline(a.backend, a.model, a.input, a.output, pages=a.pages, mode=a.mode, max_cost_usd=a.max_cost_usd).run(spark)
        print(reports.run_summary(silver).first()[0])
    elif a.command == "perf":
        print(json.dumps(reports.run_perf(spark, a.n, a.backend, a.model, a.report)))
    else:
        print(json.dumps(Evaluator(a.truth).score_df(store.read_table(spark, a.silver))))


if __name__ == "__main__":
    main()
