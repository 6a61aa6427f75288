"""Times the query suite on the driver tables repeated until there are as many posts as asked for.

    python tools/scale_bench.py [posts] [cpus]

Copies get keys of their own, so joins and groups keep their shape. The data goes to a scratch folder.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadloom import standins  # noqa: E402
from threadloom.plans.suite import DOCUMENT_SUITE, SQL_SUITE  # noqa: E402
from threadloom.session import build_session  # noqa: E402

BASE = "/root/testdata/sf0.1"
KEYS = ("id", "name", "author_fullname", "subreddit_id", "link_id", "parent_id")


def main() -> None:
    wanted = int(sys.argv[1]) if len(sys.argv) > 1 else 20_000_000
    cpus = sys.argv[2] if len(sys.argv) > 2 else "8"
    spark = build_session(
        "scale", f"local[{cpus}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=str(4 * int(cpus)), spark__sql__adaptive__coalescePartitions__initialPartitionNum=str(4 * int(cpus)),
        spark__driver__memory="20g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="run-scale-")
    tables = {}
    for name, df in standins.archive(spark, BASE).items():
        if name == "wiki":
            continue
        copies = wanted // 150_000 if name != "comment" else wanted // 600_000
        spread = df.repartition(int(cpus)).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        keyed = {k: F.concat_ws("_", k, "_copy") for k in KEYS if k in df.columns}
        keyed = {k: F.when(F.col(k).isNotNull(), v) for k, v in keyed.items()}
        spread.withColumns(keyed).drop("_copy").write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    print({n: t.count() for n, t in tables.items()}, flush=True)
    seconds = {}
    for label, suite in (("", SQL_SUITE), ("_document", DOCUMENT_SUITE)):
        for name, query in suite.items():
            if not set(query.inputs) <= set(tables):
                continue
            best = float("inf")
            for _ in range(2):
                start = time.perf_counter()
                query.build(tables).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - start)
            seconds[name + label] = round(best, 2)
            print(name + label, seconds[name + label], flush=True)
    print(json.dumps(seconds))


if __name__ == "__main__":
    main()
