"""Commands: spec, check, discover, sync, clear-destination."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tributary.catalog import Catalog, difference, merge, new_catalog
from tributary.sources import files, jdbc, messages, tables  # noqa: F401  they register themselves
from tributary.sources.base import REGISTRY
from tributary.state import State
from tributary.sinks.table import probe
from tributary.sync import Sync


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tributary")
    p.add_argument("command", choices=["spec", "check", "discover", "sync", "clear-destination"])
    p.add_argument("--source", help="kind of source, for spec")
    p.add_argument("--config", help="JSON file: {kind, ...}")
    p.add_argument("--destination", help="folder of the tables")
    p.add_argument("--catalog")
    p.add_argument("--state", default="state.json")
    p.add_argument("--difference", help="with discover: an older catalog to compare the catalog with")
    a = p.parse_args(argv)
    if a.command == "spec":
        print(json.dumps(REGISTRY[a.source].spec(), indent=1))
        return 0
    if a.command == "discover" and a.difference:
        print(difference(Catalog.from_json(Path(a.difference).read_text()), Catalog.from_json(Path(a.catalog).read_text())).to_json())
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = json.loads(Path(a.config).read_text())
    try:
        source = REGISTRY[config["kind"]](spark, config)
        if a.command == "check":
            source.check()
            print("the source can be read")
            if a.destination:
                probe(spark, a.destination)
                print("the destination can be written")
            return 0
        if a.command == "discover":
            found = new_catalog(source.discover())
            old = Path(a.catalog) if a.catalog else None
            if old and old.exists():
                found = merge(Catalog.from_json(old.read_text()), found)
            if old:
                old.write_text(found.to_json())
            print(found.to_json())
            return 0
        sync = Sync(spark, source, a.destination, State.load(a.state))
        catalog = Catalog.from_json(Path(a.catalog).read_text())
        if a.command == "clear-destination":
            sync.clear(catalog)
        else:
            for stream, why in sync.run(catalog).items():
                print(f"left out {stream}: {why}", file=sys.stderr)
        return 0
    except Exception as e:
        print(f"{a.command} failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
