"""python -m evispark all | run --repo ID | init-ground-truth | evaluate   [-c CONFIG]"""

from __future__ import annotations

import argparse
import logging

from evispark.plans import config, run
from evispark.session import local_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evispark", description="Observe code-evidence graphs, measure them and grade the result.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("all", "run every repository"), ("run", "run one repository"), ("init-ground-truth", "seed reviews"), ("evaluate", "report again from finished runs and reviews")):
        command = commands.add_parser(name, help=what)
        command.add_argument("-c", "--config", default="evispark.config.json")
        if name == "run":
            command.add_argument("--repo", required=True)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    settings = config.load(given.config)
    repos = [settings.repository(given.repo)] if given.command == "run" else settings.repositories
    act = {"init-ground-truth": run.init_ground_truth, "evaluate": run.evaluate_existing}.get(given.command, run.run_repository)
    spark = local_session()
    done = [act(spark, repo, settings) for repo in repos]
    return int(given.command in ("all", "run") and not all(done))


if __name__ == "__main__":
    raise SystemExit(main())
