"""Commands: ``coverage`` reports on a corpus, ``statements`` and ``references`` make task tables and take in answers.

Text models are not called here: a first run writes a table of tasks (task, prompt), and a run with
``--answers``, a table of (task, answer, error), turns the answers into statements or references.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators import coverage, tasks
from cotejo.sources import corpus, sinks, statements, tree
from cotejo.sources.schemas import KEY


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m cotejo", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    report = commands.add_parser("coverage", help="how many references each problem has")
    report.add_argument("--dataset-path", required=True)
    report.add_argument("--output-path", required=True, help="the tree of references")
    report.add_argument("--csv", help="write one row for each problem here")
    report.add_argument("--json", help="write the nested document here")
    report.add_argument("--verbose", action="store_true", help="show problems without references")
    infer = commands.add_parser("statements", help="prompts that infer statements from students' code")
    infer.add_argument("--dataset-path", required=True)
    infer.add_argument("--num-samples", type=int, default=2)
    infer.add_argument("--checkpoint", help="keys of finished problems; they are passed over unless --force")
    infer.add_argument("--force", action="store_true")
    make = commands.add_parser("references", help="prompts that ask for other solutions")
    make.add_argument("--dataset-path", required=True)
    make.add_argument("--enunciados", required=True, help="CSV of statements")
    make.add_argument("--model", default="gpt-4o-mini", choices=[m[0] for m in statements.MODELS])
    make.add_argument("--models", help="names with commas between; takes the place of --model")
    make.add_argument("--versions", type=int, default=3)
    make.add_argument("--limit", type=int)
    for command in (infer, make):
        command.add_argument("--tasks", required=True, help="the task table: written, or read where there are --answers")
        command.add_argument("--answers", help="a table of task, answer and error")
        command.add_argument("--output", help="where statements (CSV) or references (a table) go")
    return parser


def _answered(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return tasks.answered(spark.read.parquet(args.tasks), spark.read.parquet(args.answers).select("task", "answer", "error"))


def _coverage(spark: SparkSession, args: argparse.Namespace) -> None:
    problems = tree.problems_in(tree.read_tree(spark, args.dataset_path, content=False))
    references = corpus.scan_references(spark, args.output_path)
    coverage.totals(problems, references).show()
    coverage.by_group(problems, references).orderBy("grupo").show(1000, truncate=False)
    coverage.references_by_model(references).orderBy("modelo").show(1000, truncate=False)
    if args.verbose:
        coverage.pending(problems, references).select(*KEY).orderBy(*KEY).show(1000, truncate=False)
    if args.csv:
        sinks.write_coverage_csv(coverage.export_rows(problems, references), args.csv)
    if args.json:
        sinks.write_coverage_json(coverage.nested_document(problems, references), args.json)


def _statements(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.answers:
        done = tasks.statements_of(_answered(spark, args))
        sinks.append_statements(done, args.output)
        if args.checkpoint:
            sinks.append_completed(done, args.checkpoint)
        return
    found = tree.read_tree(spark, args.dataset_path)
    files, problems = tree.files_in(found), tree.problems_in(found.drop("contenido"))
    if args.checkpoint and not args.force:
        problems = problems.join(statements.read_checkpoint(spark, args.checkpoint).distinct(), KEY, "left_anti")
    tasks.inference_tasks(problems, files, args.num_samples).write.parquet(args.tasks)


def _references(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.answers:
        sinks.append_references(tasks.references_of(_answered(spark, args)), args.output)
        return
    found = tree.read_tree(spark, args.dataset_path)
    wanted = statements.limited(statements.last_wins(statements.read_statements(spark, args.enunciados), KEY), args.limit)
    names = [m.strip() for m in (args.models or args.model).split(",") if m.strip()]
    known, unknown = tasks.known_models(spark.createDataFrame([(n,) for n in names], "nombre string"), statements.model_catalogue(spark))
    for row in unknown.collect():  # names of the command line
        print(f"model {row.nombre} is unknown and passed over", file=sys.stderr)
    skipped = tasks.skip_reasons(wanted, tree.problems_in(found), spark.createDataFrame([], ", ".join(f"{c} string" for c in KEY))).filter("skip_reason is not null")
    for row in skipped.groupBy("skip_reason").count().orderBy("skip_reason").collect():
        print(f"{row['count']} statements passed over: {row.skip_reason}", file=sys.stderr)
    originals = tasks.seeded_choice(tree.files_in(found)).select(*KEY, "contenido")
    tasks.generation_tasks(wanted.select(*KEY, "enunciado"), originals, known.select("nombre"), args.versions).write.parquet(args.tasks)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    {"coverage": _coverage, "statements": _statements, "references": _references}[args.command](spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
