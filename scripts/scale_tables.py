"""Write an N-times copy of the driver tables (keys shifted per copy) for
scaling experiments: python scripts/scale_tables.py SRC_DIR DST_DIR N

Copy k adds k * (row count) to every key, so joins stay within a copy and
every table grows N times; names that embed a key are rebuilt from it.
"""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from pyspark.sql import functions as F  # noqa: E402

from catalytics.session import get_session  # noqa: E402

KEYS = {  # table -> {column: key family}
    "part": {"p_partkey": "part"},
    "supplier": {"s_suppkey": "supp"},
    "customer": {"c_custkey": "cust"},
    "orders": {"o_orderkey": "order", "o_custkey": "cust"},
    "lineitem": {"l_orderkey": "order", "l_partkey": "part", "l_suppkey": "supp"},
    "events": {"event_id": "event"},
}
FAMILY_TABLE = {"part": ("part", "p_partkey"), "supp": ("supplier", "s_suppkey"),
                "cust": ("customer", "c_custkey"), "order": ("orders", "o_orderkey"),
                "event": ("events", "event_id")}


def main():
    src, dst, n = sys.argv[1], sys.argv[2], int(sys.argv[3])
    spark = get_session("local[8]", 16)
    span = {f: spark.read.parquet(f"{src}/{t}.parquet").agg(F.max(k) + 1).first()[0]
            for f, (t, k) in FAMILY_TABLE.items()}
    for t in ("region", "nation", "part", "supplier", "customer", "orders", "lineitem", "events"):
        df = spark.read.parquet(f"{src}/{t}.parquet")
        if t in KEYS:
            df = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            for c, fam in KEYS[t].items():
                df = df.withColumn(c, F.col(c) + F.col("_copy") * span[fam])
            if t == "customer":
                df = df.withColumn("c_name", F.format_string("Customer#%09d", F.col("c_custkey")))
            if t == "supplier":
                df = df.withColumn("s_name", F.format_string("Supplier#%09d", F.col("s_suppkey")))
            df = df.drop("_copy")
        df.write.mode("overwrite").parquet(f"{dst}/{t}.parquet")
        print(t, spark.read.parquet(f"{dst}/{t}.parquet").count(), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
