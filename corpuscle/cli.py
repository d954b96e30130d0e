"""python -m corpuscle.cli JOB PATH [--name value ...] --out FOLDER: one job of corpuscle.plans.jobs, written as tab-separated lines."""

from __future__ import annotations

import argparse
import inspect
import json

from . import session
from .plans.jobs import JOBS
from .sources.vectors import write_table


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpuscle", description=__doc__)
    commands = parser.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        command = commands.add_parser(name, help=(job.__doc__ or "").split("\n")[0])
        command.add_argument("path")
        command.add_argument("--out", required=True)
        command.add_argument("--one-file", action="store_true")
        for parameter in list(inspect.signature(job).parameters.values())[2:]:
            needed = parameter.default is inspect.Parameter.empty
            command.add_argument(f"--{parameter.name.replace('_', '-')}", required=needed, default=None if needed else parameter.default, dest=parameter.name)
    given = vars(parser.parse_args(argv))
    job, path, out, one_file = JOBS[given.pop("job")], given.pop("path"), given.pop("out"), given.pop("one_file")

    def value(text):
        try:
            return json.loads(text) if isinstance(text, str) else text
        except ValueError:
            return text

    spark = session.build()
    session.ship(spark)
    write_table(job(spark, path, **{k: value(v) for k, v in given.items()}), out, one_file)


if __name__ == "__main__":
    main()
