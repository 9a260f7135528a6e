"""python -m docweave QUERY ROOT [--out DIR] [--format parquet|json|csv]: run a registered query over a folder of tables."""

import argparse
import importlib

from .plans import registry
from .session import get_spark
from .sources.artifacts import write_table


def all_queries() -> dict:
    found = registry.queries()
    try:
        found |= importlib.import_module("__spark_entry__").queries()
    except ImportError:
        pass
    return found


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="docweave", description=__doc__)
    p.add_argument("query", help="name, or 'list'")
    p.add_argument("root", nargs="?", help="folder of parquet tables")
    p.add_argument("--out", help="folder for the result; without it, 20 rows are shown")
    p.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    a = p.parse_args(argv)
    found = all_queries()
    if a.query == "list":
        print("\n".join(sorted(found)))
        return
    if a.query not in found or not a.root:
        p.error(f"no query {a.query!r}" if a.query not in found else "the folder of tables is missing")
    df = found[a.query](get_spark(), a.root)
    write_table(df, a.out, a.format) if a.out else df.show(20, truncate=80)


if __name__ == "__main__":
    main()
