"""Commands over a store.

python -m tickstrata dump-index PATH             records of older index files
python -m tickstrata files ROOT                  the live files with their bounds
python -m tickstrata size ROOT                   KiB of all that is below the root
python -m tickstrata scan ROOT DID START END     rows of a device (--named: by register)
python -m tickstrata sweep ROOT DID [--now NS]   rows and milliseconds of each of the last 53 windows of seven days
python -m tickstrata compact ROOT | vacuum ROOT
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from tickstrata.model import SHARD_NS
from tickstrata.session import local_session
from tickstrata.sources.legacy import read_index
from tickstrata.sources.store import Store


def _print(df: DataFrame) -> None:
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join(str(x) for x in row))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tickstrata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("dump-index").add_argument("path")
    for name in ("files", "size", "scan", "sweep", "compact", "vacuum"):
        command = commands.add_parser(name)
        command.add_argument("root")
        if name in ("scan", "sweep"):
            command.add_argument("did", type=int)
        if name == "scan":
            command.add_argument("start", type=int)
            command.add_argument("end", type=int)
            command.add_argument("--named", action="store_true")
        if name == "sweep":
            command.add_argument("--now", type=int, default=None)
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.getActiveSession() or local_session()
    if given.command == "dump-index":
        return _print(read_index(spark, given.path))
    store = Store(spark, given.root)
    if given.command == "files":
        _print(store.catalog())
    elif given.command == "size":
        print(store.size() // 1024)
    elif given.command == "scan":
        _print(store.scan(given.did, given.start, given.end, named=given.named))
    elif given.command == "sweep":
        end = given.now if given.now is not None else time.time_ns()
        print("start\tend\trows\tms")
        for k in range(53):
            began = time.perf_counter()
            window = end - (k + 1) * SHARD_NS, end - k * SHARD_NS
            print(*window, store.scan(given.did, *window).count(), round(1000 * (time.perf_counter() - began)), sep="\t")
    else:
        print(getattr(store, given.command)())
    return None


if __name__ == "__main__":
    main()
