"""Command line: generate, validate, fit, scan, init, explain, ingest.

Exit codes: 0 success, 1 violations or an invalid result, 2 bad input.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from tabloom.plans.spec import MetadataError, Plan, dump, load


def _session() -> SparkSession:
    return SparkSession.builder.appName("tabloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _save(plan: Plan, path: str) -> None:
    if path.endswith(".json"):
        Path(path).write_text(json.dumps(dump(plan), indent=2))
        return
    import yaml

    Path(path).write_text(yaml.safe_dump(dump(plan), sort_keys=False, allow_unicode=True))


def _generate(a: argparse.Namespace) -> int:
    from tabloom.operators.generate import generate
    from tabloom.sources.documents import write_documents
    from tabloom.sources.files import read_tables, write_tables

    plan, spark = load(a.plan), _session()
    write_tables(plan, generate(spark, plan, a.seed, a.partitions), a.out)
    written = read_tables(spark, plan, a.out)
    for n, df in written.items():
        print(f"{n}: {df.count()} rows")
    for path in write_documents(plan, written, a.out):
        print(path)
    return 0


def _validate(a: argparse.Namespace) -> int:
    from tabloom.operators.validate import violations
    from tabloom.sources.checks import document_violations
    from tabloom.sources.files import read_tables

    plan, spark = load(a.plan), _session()
    frames = read_tables(spark, plan, a.out)
    found = violations(plan, frames) + document_violations(plan, frames, a.out)
    print("\n".join(found) or "OK")
    return int(bool(found))


def _fit(a: argparse.Namespace) -> int:
    from tabloom.operators.fit import fit
    from tabloom.sources.files import load as load_tables

    plan = load(a.plan)
    _save(fit(load_tables(_session(), a.data), plan, a.epsilon, a.dp_seed), a.out)
    return 0


def _scan(a: argparse.Namespace) -> int:
    from tabloom.operators.scan import render, scan, to_dict
    from tabloom.sources.files import load as load_tables

    report = scan(load_tables(_session(), a.data, a.rows))
    print(json.dumps(to_dict(report), indent=2, default=str) if a.json else render(report), end="")
    return 0


def _init(a: argparse.Namespace) -> int:
    from tabloom.operators.infer import infer
    from tabloom.plans.wizard import Wizard
    from tabloom.sources.files import load as load_tables

    sources = [tuple(s.split("=", 1)) for s in a.source or ()]
    if a.data and a.yes:
        plan, warnings = infer(load_tables(_session(), a.data), a.seed, sources)
        for w in warnings:
            print(f"warning: {w}", file=sys.stderr)
        _save(plan, a.out)
        return 0
    return Wizard(a.out, a.seed, frames=load_tables(_session(), a.data) if a.data else None, assume_yes=a.yes).run()


def _explain(a: argparse.Namespace) -> int:
    from tabloom.plans.explain import explain

    text = explain(load(a.plan))
    Path(a.out).write_text(text) if a.out else print(text)
    return 0


def _ingest(a: argparse.Namespace) -> int:
    from tabloom.sources.xml import ingest

    print(f"{ingest(_session(), a.data, a.out, not a.strings).count()} records")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tabloom", description="Synthetic relational data on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable[[argparse.Namespace], int], text: str, *args: tuple) -> None:
        p = commands.add_parser(name, help=text)
        p.set_defaults(run=run)
        for names, options in args:
            p.add_argument(*names, **options)

    arg = lambda *names, **options: (names, options)
    plan, out = arg("plan", help="plan, YAML or JSON"), arg("--out", required=True)
    data = arg("data", help="folder of tables")
    add("generate", _generate, "tables and documents from a plan", plan, out, arg("--seed", type=int), arg("--partitions", type=int))
    add("validate", _validate, "whether tables keep their plan's promises", plan, out)
    add("fit", _fit, "parameters from real tables", plan, data, out, arg("--epsilon", type=float), arg("--dp-seed", type=int, default=0))
    add("scan", _scan, "report on real tables", data, arg("--json", action="store_true"), arg("--rows", type=int, help="rows of each table to look at; all if left out"))
    add("init", _init, "a plan's structure from real tables, or by questions", arg("--data"), out, arg("--seed", type=int, default=42), arg("--source", action="append", metavar="NAME=PATTERN"), arg("--yes", action="store_true"))
    add("explain", _explain, "a plan in words", plan, arg("--out"))
    add("ingest", _ingest, "XML files to Parquet", data, out, arg("--strings", action="store_true", help="leave values untyped"))
    return top


def _text(e: Exception) -> str:
    """An error's first line; a KeyError shows its key's name alone otherwise."""
    text = f"nothing is known of {e.args[0]!r}" if isinstance(e, KeyError) and e.args else str(e)
    return text if isinstance(e, MetadataError) else (text.splitlines() or [type(e).__name__])[0]


def main(argv: list[str] | None = None) -> int:
    from pyspark.errors import AnalysisException
    from yaml import YAMLError

    from tabloom.sources.files import SourceError
    from tabloom.sources.schemas import DocumentError

    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (MetadataError, SourceError, DocumentError, AnalysisException, YAMLError, SyntaxError, OSError, ValueError, LookupError) as e:
        print(f"error: {_text(e)}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
