"""python -m codaria STAGE... --root DIR (--dataset NAME | --all): runs stages, `all` for each of them, in order."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from codaria.plans.stages import BOOK, STAGES, Run
from codaria.sources.io import SOURCES


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="codaria", description=__doc__)
    p.add_argument("stages", nargs="+", choices=[*STAGES, "all"])
    p.add_argument("--root", required=True, help="folder of the run's tables")
    p.add_argument("--source", default="", help="folder of the datasets' files")
    p.add_argument("--seed", help="JSON file of abbreviations")
    p.add_argument("--candidates", type=int, default=50)
    p.add_argument("--labels", type=int, default=5)
    p.add_argument("--predicted", type=int, default=5)
    p.add_argument("--scores", type=int, default=100, help="codes with scores of each retrieval prediction")
    p.add_argument("--k1", type=float, default=1.5)
    p.add_argument("--b", type=float, default=0.75)
    p.add_argument("--targets", help="JSONL file of silver targets, for metrics")
    p.add_argument("--aliases", help="JSONL file of aliases in the place of the book's")
    p.add_argument("--rules", help="JSONL file of rules in the place of the book's")
    p.add_argument("--pdf", help="files or address of the code book in the place of its table of pages")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--dataset", choices=list(SOURCES))
    which.add_argument("--all", action="store_true", help="every dataset")
    a = p.parse_args(argv)
    names = [n for n in STAGES if n != "pdf"] if "all" in a.stages else a.stages
    if not (a.dataset or a.all) and any(n not in ("book", "pdf") for n in names):
        p.error("--dataset or --all is needed")
    run = Run(SparkSession.builder.appName("codaria").getOrCreate(), a.root, a.source, a.seed, a.candidates, a.labels, a.predicted, a.scores, a.k1, a.b, a.targets, a.aliases, a.rules, a.pdf)
    for name in names:
        for dataset in [BOOK] if name in ("book", "pdf") else list(SOURCES) if a.all else [a.dataset]:
            STAGES[name](run, dataset)


if __name__ == "__main__":
    main()
