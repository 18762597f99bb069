"""``python -m plumbline list`` and ``python -m plumbline run NAME FOLDER OUT``: queries by name, their rows written as Parquet."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame

from plumbline.plans import catalog
from plumbline.session import get_session


def main(arguments: list[str] | None = None, queries: dict[str, Callable[..., DataFrame]] = catalog.QUERIES) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names all queries")
    run = commands.add_parser("run", help="runs one query")
    run.add_argument("name")
    run.add_argument("folder", help="of the Parquet tables")
    run.add_argument("out", help="a folder that must not exist")
    run.add_argument("--master", default="local[*]")
    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(queries))
        return 0
    if given.name not in queries:
        parser.error(f"no query is named {given.name}")
    queries[given.name](get_session(given.master), given.folder).write.mode("errorifexists").parquet(given.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
