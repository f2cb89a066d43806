"""Time every oracle SQL on DuckDB (single node, all cores), materialising the
full result into a temp table. Prints one JSON line {name: seconds}."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    import duckdb

    from sparqa.plans.queries import oracle_sql
    from sparqa.sources.tables import DRIVER_TABLES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    skip = set(sys.argv[2:])
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    out = {}
    for name, sql in oracle_sql().items():
        if name in skip:
            continue
        t0 = time.perf_counter()
        con.execute(f"CREATE OR REPLACE TEMP TABLE __r AS {sql}")
        out[name] = round(time.perf_counter() - t0, 3)
        print(f"{name:24s} {out[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
