"""``python -m tessera generate``: makes a corpus with a provider and keeps it in a folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .runlog import recording
from .sources import external, scenario, synthetic  # noqa: F401  they make their providers known
from .sources.registry import Provider, provide


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    make = top.add_subparsers(dest="what", required=True).add_parser("generate", help="make a corpus")
    make.add_argument("--provider", default="synthetic")
    make.add_argument("--source", help="folder or file that the provider reads")
    make.add_argument("--name", required=True, help="folder that the corpus is kept in")
    make.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a setting of the provider")
    make.add_argument("--logs", help="folder for the record of this run")
    return top


def _value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def main(args: list[str] | None = None) -> int:
    a = arguments().parse_args(args)
    if a.provider not in Provider.kinds:
        print(f"no provider {a.provider!r}; there are: {', '.join(sorted(Provider.kinds))}", file=sys.stderr)
        return 2
    settings = {k: _value(v) for k, _, v in (x.partition("=") for x in a.set)} | {"out_dir": a.name}
    if a.source:
        settings["source"] = settings["path"] = a.source
        if a.provider == "external":
            del settings["path"]
    with recording(a.logs) as say:
        spark = SparkSession.builder.appName("tessera").getOrCreate()
        made = provide(spark, a.provider, settings)
        say(f"{a.provider}: {made.events.count()} events, {made.queries.count()} queries, {made.selections.count()} selections in {a.name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
