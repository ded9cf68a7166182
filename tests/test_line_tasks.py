"""The joins of the raw lines: partitions by the files' bytes, and the rows of plain joins."""

import datetime as dt
import os

from svcops.sources import fixtures as FX

DAY = dt.datetime(1999, 5, 1)
TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "EUROPE")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "UK", 0), (14, "FRANCE", 0)]),
    "customer": ("c_custkey bigint, c_nationkey int", [(c, 14 * (c % 2)) for c in range(1, 30)] + [(None, 0)]),
    "part": ("p_partkey bigint, p_name string, p_retailprice double",
             [(p, f"part {p}", 1.5 * p) for p in range(1, 40)] + [(3, "part 3 again", 9.0), (None, "none", 1.0)]),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
               [(o, 1 + o % 29, "POF"[o % 3], DAY) for o in range(1, 400)] + [(7, 2, "O", DAY), (None, 1, "F", DAY), (500, None, "F", DAY)]),
    # two thirds of the lines are of one part
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double",
                 [(1 + i % 410, 5 if i % 3 else 1 + i % 45, i % 7, float(i % 50)) for i in range(3000)] + [(None, 1, 1, 1.0), (1, None, 1, 1.0)]),
}


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(f"lt_{name}")
    size = sum(os.path.getsize(f"{tmp_path}/{t}.parquet/{f}") for t in ("lineitem", "orders", "part")
               for f in os.listdir(f"{tmp_path}/{t}.parquet") if f.startswith("part-"))
    monkeypatch.setattr(FX, "TASK_BYTES", 500, raising=False)
    got = FX.transactions_raw(spark, str(tmp_path))
    parts = got.rdd.glom().map(len).collect()
    assert len(parts) >= size / 500 > 20
    assert max(parts) < sum(parts) / 2  # the commonest part's lines are dealt too
    want = spark.sql("""SELECT l_partkey, p_name, o_custkey, l_quantity FROM lt_lineitem JOIN lt_orders ON l_orderkey = o_orderkey
        JOIN lt_customer ON o_custkey = c_custkey JOIN lt_nation ON c_nationkey = n_nationkey JOIN lt_part ON l_partkey = p_partkey""")
    assert sorted((r["l_partkey"], r["p_name"], int(r["l_quantity"])) for r in want.collect()) == sorted(
        (int(r["stock_code"]), r["description"] or "part 7", abs(r["quantity"])) for r in got.collect())
