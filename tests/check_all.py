"""Run registered queries against their SQL and print times: ``python tests/check_all.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from compare import database, differences  # noqa: E402

from lumbre.plans.registry import all_queries, all_sql  # noqa: E402
from lumbre.session import local_session  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session(8)
    con = database(sf_dir)
    queries, sql = all_queries(), all_sql()
    failed = 0
    for name in names or queries:
        begin = time.perf_counter()
        try:
            if name in sql:
                problems = differences(queries[name](spark, sf_dir), con, sql[name])
                verdict = "; ".join(problems) or "same"
                failed += bool(problems)
            else:
                verdict = f"{len(queries[name](spark, sf_dir).collect())} rows, no SQL"
        except Exception:
            verdict, failed = traceback.format_exc(limit=3)[:1800], failed + 1
        print(f"{name:28s} {time.perf_counter() - begin:6.2f}s  {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
