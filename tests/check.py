"""python tests/check.py [name ...]: run queries and their twins, print what differs."""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)
import __spark_entry__ as entry
import oracle
from perdura.session import local_session

SF = "/root/testdata/sf0.01"

if __name__ == "__main__":
    spark = local_session("check")
    spark.sparkContext.setLogLevel("OFF")
    con = oracle.connect(SF)
    twins = entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, SF)
            if name in twins:
                diff = oracle.compare(df, con, twins[name])
            else:
                rows = df.collect()
                diff = None if rows else "no rows"
                if wanted:
                    for r in rows[:3]:
                        print("   ", str(r)[:300])
        except Exception as error:  # report and go on
            diff = f"{type(error).__name__}: {str(error)[:300]}"
        bad += diff is not None
        kind = "S" if name in twins else "R"
        print(f"{'ok ' if diff is None else 'BAD'} {kind} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("bad:", bad)
