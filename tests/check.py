"""Run registered queries against their SQL: python tests/check.py sf0.01 [name ...]"""
import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from oracle import compare, connect  # noqa: E402

from passagework.registry import ORACLE, QUERIES  # noqa: E402
from passagework.session import build_session  # noqa: E402


def main() -> None:
    folder = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    if len(names) == 1 and names[0].startswith("registry."):
        module = f"passagework.{names[0]}"
        names = [n for n, f in QUERIES.items() if f.__module__ == module]
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names:
        start = time.time()
        try:
            if name in ORACLE:
                problems = compare(spark, name, folder, QUERIES, ORACLE, con)
                verdict = "ok" if not problems else "DIFF " + "; ".join(problems)
            else:
                verdict = f"rows {QUERIES[name](spark, folder).count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"== {name} {time.time() - start:.1f}s {verdict}", flush=True)


main()
