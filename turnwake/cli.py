"""Steps of a run: load, build, analyse, report, sample.

    python -m turnwake.cli load --folder data --months 12
    python -m turnwake.cli build --flights data/flights --airports airports.csv --tables data/tables
    python -m turnwake.cli analyse --flights data/flights --airports airports.csv --results results
    python -m turnwake.cli report --results results --template page.html --out site/index.html
    python -m turnwake.cli sample --flights data/flights --days 2026-03-07 2026-03-08 --out fixture
    python -m turnwake.cli lineage --flights data/flights --airports airports.csv
"""

from __future__ import annotations

import argparse
from pathlib import Path

from .config import Config
from .plans import analysis, incremental, publish, quality, warehouse
from .session import session
from .sources import airports, flights, sample


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnwake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = top.add_subparsers(dest="step", required=True)

    def step(name: str, **options) -> None:
        s = steps.add_parser(name)
        for flag, spec in options.items():
            s.add_argument(f"--{flag}", **spec)

    path = {"required": True}
    step("load", folder=path, months={"type": int, "default": 12})
    capped = {"memory": {}, "cores": {"type": int}}
    step("build", flights=path, airports=path, tables=path, **capped)
    step("append", flights=path, tables=path, **capped)
    step("analyse", flights=path, airports=path, results=path, **capped)
    step("report", results=path, template={"default": str(publish.PAGE)}, out=path)
    step("sample", flights=path, days={"nargs": "+", "required": True}, out=path)
    step("lineage", flights=path, airports=path)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.step == "report":
        tables, summary = publish.read(a.results)
        Path(a.out).write_text(publish.page(Path(a.template).read_text(), tables, summary))
        return
    spark = session(memory=getattr(a, "memory", None), cores=getattr(a, "cores", None))
    if a.step == "load":
        flights.load(spark, Path(a.folder), a.months)
        return
    raw = flights.read(spark, a.flights if a.flights.endswith((".csv", ".zip")) else f"{a.flights}/*")
    if a.step == "sample":
        sample.write_csv(sample.whole_tails(raw, a.days), a.out)
        return
    if a.step == "append":
        for name in quality.check(spark, incremental.add_months(spark, raw, a.tables).tables):
            print(f"warning: {name}")
        return
    built = warehouse.build(raw, airports.load(spark, a.airports))
    if a.step == "build":
        done = warehouse.write(built, a.tables)
        for name in quality.check(spark, done.tables, done.counted):
            print(f"warning: {name}")
    elif a.step == "lineage":
        for name, df in built.tables.items():
            print(f"== {name}")
            df.explain("formatted")
    else:
        tables, summary = analysis.run(built, Config())
        publish.write(tables, summary, a.results)


if __name__ == "__main__":
    main()
