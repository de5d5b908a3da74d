"""Run queries against their SQL: ``python -m tests.check_queries [prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

from leaguelens.catalog import ORACLE, QUERIES
from leaguelens.session import local_session
from tests.oracle import connect, compare


def main() -> None:
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in ORACLE:
                problems = compare(df, con, ORACLE[name])
                note = "ok"
            else:
                problems, note = [], f"rows-only {df.count()}"
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problems)
        print(f"{name:34s} {time.time() - start:6.2f}s {'; '.join(problems) or note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
