"""Run queries against their SQL twins: check.py SF [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle import compare, connect  # noqa: E402

from wattframe.plans.catalog import catalog  # noqa: E402
from wattframe.session import build_session  # noqa: E402


def main() -> int:
    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, q in catalog().items():
        if prefixes and not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            df = q.run(spark, sf_dir)
            sql = q.full_sql()
            if sql is None:
                n = df.count()
                verdict = None if n else "no rows"
                tag = f"rows-only {n}"
            else:
                verdict = compare(df, con, sql)
                tag = ""
        except Exception as e:  # noqa: BLE001
            verdict, tag = f"{type(e).__name__}: {str(e)[:600]}", ""
        took = time.time() - began
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {took:.1f}s {tag} {verdict or ''}", flush=True)
        failed += verdict is not None
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
