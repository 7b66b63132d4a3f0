"""python -m marlstone inspect|verify|health|export FOLDER: exit 0 if all is well, 1 if the collection is damaged, 2 for wrong use."""

from __future__ import annotations

import argparse
import json
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marlstone")
    parser.add_argument("command", choices=["inspect", "verify", "health", "export"])
    parser.add_argument("path")
    parser.add_argument("--format", choices=["jsonl", "csv"], default="jsonl")
    parser.add_argument("--out")
    parser.add_argument("--no-vectors", action="store_true")
    parser.add_argument("--limit", type=int, default=0)
    try:
        a = parser.parse_args(args)
        if a.command == "export" and not a.out:
            parser.error("export needs --out")
    except SystemExit as e:
        return 2 if e.code else 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from marlstone.sources.files import FormatError, export_csv, export_json
    from marlstone.sources.store import Store

    store = Store(SparkSession.builder.appName("marlstone").getOrCreate(), a.path)
    try:
        if a.command == "inspect":
            print(json.dumps(store.identify()))
        elif a.command == "verify":
            store.verify()
            print("ok")
        elif a.command == "health":
            rows = store.load()
            print(json.dumps(store.identify() | {"rows": 0 if rows is None else rows.count()}))
        else:
            rows = store.load()
            if rows is not None:
                if "indices" in rows.columns:
                    rows = rows.withColumn("sparse", F.when(F.col("indices").isNotNull(), F.struct("indices", "values"))).drop("indices", "values")
                rows = rows.withColumnsRenamed({"_key": "key", "_expires_at": "expires_at"})
                (export_csv if a.format == "csv" else export_json)(rows, a.out, not a.no_vectors, a.limit)
    except FormatError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
