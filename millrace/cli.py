"""python -m millrace.cli submit -input PATH -output PATH ..., or terasort IN OUT."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from millrace import registry
from millrace.options import JobOptions, parse_list, parse_pairs
from millrace.plans.job import Job
from millrace.plans.terasort import terasort


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    submit = commands.add_parser("submit")
    submit.add_argument("-input", required=True, help="paths, separated by commas")
    submit.add_argument("-output", required=True)
    for role in ("reader", "mapper", "combiner", "partitioner", "reducer", "writer"):
        submit.add_argument(f"-{role}", help="a plug-in's name; JAVA for the identity" if role in ("mapper", "reducer") else "a plug-in's name")
    submit.add_argument("-lib", help="name=module,...")
    submit.add_argument("-inputformat", help="a Spark format that gives columns key and value, instead of a reader")
    submit.add_argument("-outputformat", help="a Spark format, instead of a writer")
    submit.add_argument("-maps", type=int, help="a hint: partitions of the input")
    submit.add_argument("-reduces", type=int)
    submit.add_argument("-jobconf", default="", help="key=value,...")
    submit.add_argument("-D", action="append", default=[], metavar="key=value")
    sort = commands.add_parser("terasort")
    sort.add_argument("source")
    sort.add_argument("target")
    sort.add_argument("-reduces", type=int)
    return top


def job_of(spark: SparkSession, args: argparse.Namespace) -> Job:
    if args.lib:
        registry.load(args.lib)
    options = JobOptions().with_pairs(parse_pairs([*args.D, *parse_list(args.jobconf)]))
    job = Job(spark, options).output(args.output)
    paths = parse_list(args.input)
    if args.inputformat:
        job.input(frame=spark.read.format(args.inputformat).load(paths))
    else:
        job.input(*paths)
    if args.maps:
        job.maps(args.maps)
    for role in ("reader", "mapper", "combiner", "partitioner", "reducer", "writer"):
        if name := getattr(args, role):
            getattr(job, role)({"mapper": "core.identity", "reducer": "core.passive"}[role] if name == "JAVA" and role in ("mapper", "reducer") else name)
    if args.outputformat:
        job.writer(lambda df, path, compression=None: df.write.format(args.outputformat).options(**({"compression": compression} if compression else {})).save(path))
    return job.reduces(args.reduces) if args.reduces is not None else job


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    if args.command == "terasort":
        terasort(spark, args.source, args.target, args.reduces)
    else:
        for name, counts in job_of(spark, args).run().items():
            print(name, *(f"{k}={v}" for k, v in counts.items()), sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
