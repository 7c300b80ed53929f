"""Run all (or the named) queries against their SQL twins: ``python tests/run_oracle.py [-d folder] [names]``."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from matchspark.session import local_session  # noqa: E402


def main(args: list[str]) -> int:
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        folder, args = args[1], args[2:]
    spark = local_session()
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args and name not in args and not any(a.endswith("*") and name.startswith(a[:-1]) for a in args):
            continue
        start = time.time()
        try:
            timing = {}
            found = differences(spark, con, folder, fn, sql[name], timing) if name in sql else []
            rows = fn(spark, folder).count() if name not in sql else None
            state = "ok" if not found else "FAIL " + " | ".join(found)[:1500]
            if rows is not None:
                state = f"rows only: {rows}"
        except Exception as e:  # noqa: BLE001
            state = "ERROR " + str(e)[:900]
        bad += not state.startswith(("ok", "rows"))
        print(f"{name:28s} {timing.get('spark', time.time() - start):6.1f}s of {time.time() - start:5.1f}s {state}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
