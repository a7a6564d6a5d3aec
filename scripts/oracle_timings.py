"""Time the DuckDB reference SQL of every query (single process, for context only).

Usage: python scripts/oracle_timings.py [sf_dir]; prints one JSON line of medians (seconds).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.oracle import oracle_sql  # noqa: E402
from tests.oracle_compare import duck  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duck(sf_dir)
    out = {}
    for name, sql in oracle_sql().items():
        runs = []
        for _ in range(4):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            runs.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "queries": out}))


if __name__ == "__main__":
    main()
