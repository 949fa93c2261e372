"""python -m quern run JOB [--plugin MODULE] [--partitions N] [--sample FILE] [--most N] [--single] --output DIR INPUT..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import JobSpec, job_of, run_job
from .plans.plugins import load
from .sources import write_final


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="quern")
    run = top.add_subparsers(required=True).add_parser("run")
    run.add_argument("job", help="wc, ii, iis, srt, or the name of a plugin's module")
    run.add_argument("inputs", nargs="+")
    run.add_argument("--plugin", action="append", default=[], help="a module, by its dotted name or its path, that defines JOB")
    run.add_argument("--partitions", type=int)
    run.add_argument("--sample")
    run.add_argument("--most", type=int, help="rows of a range between the sample's split points that is not cut again")
    run.add_argument("--single", action="store_true")
    run.add_argument("--output", required=True)
    a = top.parse_args(args)
    try:
        for plugin in a.plugin:
            load(plugin)
        job = job_of(a.job)
    except (ImportError, AttributeError, TypeError, ValueError, KeyError) as e:
        run.error(str(e.args[0] if e.args else e))
    spark = SparkSession.builder.appName(f"quern {a.job}").getOrCreate()
    result = run_job(spark, JobSpec(a.job, tuple(a.inputs), a.partitions, a.sample, a.most))
    write_final(result, a.output, job.form, a.single)


if __name__ == "__main__":
    main()
