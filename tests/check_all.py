"""Run every named query against its SQL twin: python tests/check_all.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.compare import TEST_DATA, difference  # noqa: E402

if __name__ == "__main__":
    folder = f"{TEST_DATA}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles, bad = oracle_sql(), 0
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.perf_counter()
        try:
            if name in oracles:
                problem = difference(spark, build, oracles[name], folder)
            else:
                problem = None if build(spark, folder).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.perf_counter() - begin:6.2f}s {name}"
              f"{'' if name in oracles else ' (rows only)'}", problem or "", flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))
