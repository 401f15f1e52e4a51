"""Command line: watch a folder, make one pass, or forget what was learned.

``python -m bindery watch|once|reset --ingest ... --output ... --backups ... --state ...
--catalogue_a FOLDER --catalogue_b FOLDER [--services FILE] [--options FILE] [--dry-run] [--yes]``;
the catalogues are folders of Parquet tables (request, status, body, error), or live: the
services file is TOML with a table for each of ``catalogue_a``, ``catalogue_b``, ``choose``,
``map_genre`` and ``covers`` that there is, whose entries are those of ``live.Service``.
"""

from __future__ import annotations

import argparse
import dataclasses
import signal
import tomllib

from pyspark.sql import SparkSession

from bindery.options import load
from bindery.plans.correction import Catalogues
from bindery.plans.relay import Relay
from bindery.sources import live, requests


def services(path: str | None) -> dict[str, live.Service]:
    """The live services that a file names; unknown ones and unknown entries are refused."""
    if path is None:
        return {}
    with open(path, "rb") as file:
        told = tomllib.load(file)
    if odd := set(told) - {*requests.DIALECTS, "choose", "map_genre", "covers"}:
        raise ValueError(f"no such services: {sorted(odd)}")
    known = {f.name for f in dataclasses.fields(live.Service)}
    if odd := {e for entries in told.values() for e in entries} - known:
        raise ValueError(f"no such entries of a service: {sorted(odd)}")
    return {name: live.Service(**entries) for name, entries in told.items()}


def relay_of(spark: SparkSession, given: argparse.Namespace) -> Relay:
    options = load(given.options)
    if given.dry_run:
        options = dataclasses.replace(options, dry_run=True)
    recorded = {n: spark.read.schema(requests.RECORDED).parquet(folder) for n in options.sources if (folder := getattr(given, n, None))}
    served = services(given.services)
    asked = {n: recorded[n] if n in recorded else live.transport(served[n]) for n in options.sources if n in recorded or n in served}
    models = {n: live.model(served[n]) for n in ("choose", "map_genre") if n in served}
    covers = live.images(served["covers"]) if "covers" in served else None
    by = Catalogues(*requests.lookups(asked), **models, covers=covers)
    return Relay(spark, given.ingest, given.output, given.backups, given.state, by, options)


def parser() -> argparse.ArgumentParser:
    told = argparse.ArgumentParser(prog="bindery", description="Corrects books from catalogues, folder to folder.")
    told.add_argument("command", choices=("watch", "once", "reset"))
    for name in ("ingest", "output", "backups", "state"):
        told.add_argument(f"--{name}", required=True)
    for name in requests.DIALECTS:
        told.add_argument(f"--{name}")
    told.add_argument("--options")
    told.add_argument("--services")
    told.add_argument("--dry-run", action="store_true")
    told.add_argument("--yes", action="store_true", help="confirms a reset")
    return told


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("bindery").getOrCreate()
    relay = relay_of(spark, given)
    if given.command == "reset":
        relay.reset(given.yes)
    else:
        for number in (signal.SIGINT, signal.SIGTERM):
            signal.signal(number, lambda *_: relay.stop.set())
        relay.poll(1) if given.command == "once" else relay.watch()


if __name__ == "__main__":
    main()
