"""Command line: run queries against their SQL checks. Usage: run_checks.py SF [NAME...]"""

from __future__ import annotations

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from ledgerline.queries import catalog  # noqa: E402
from ledgerline.session import local_session  # noqa: E402
from tests.compare import TESTDATA, connect, difference  # noqa: E402


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{TESTDATA}/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            actual = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            problem = difference(actual, con.execute(oracles[name]).df()) if name in oracles else None
            if len(actual) == 0:
                problem = problem or "empty result"
        except Exception as e:  # noqa: BLE001
            took = time.time() - start
            text = str(e) if not isinstance(e, KeyError) else traceback.format_exc()
            problem = f"{type(e).__name__}: {text[:700]}"
            if not problem.strip():
                traceback.print_exc()
            actual = []
        bad += problem is not None
        kind = "S" if name in oracles else "R"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {took:6.2f}s {len(actual):7d} {name}" + (f"\n    {problem}" if problem else ""), flush=True)
    print(f"{bad} bad of {len(names or queries)}")


if __name__ == "__main__":
    main()
