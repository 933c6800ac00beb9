"""Compare registered queries with their SQL: ``python tests/check.py [sf] [name-part ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from lumbre.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.01")
    parts = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problem = difference(df, oracles[name], con) if name in oracles else f"(rows only: {df.count()})"
        except Exception as error:  # noqa: BLE001
            problem = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        ok = problem is None or problem.startswith("(rows")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
