import random

import duckdb
import pyarrow.parquet as pq

from rinkframe.operators import pixels


def test_rotate_mask_returns_every_position(spark, tmp_path):
    pick = random.Random(2)
    rows = [(i, [pick.uniform(-1, 1) if i % 2 else -pick.random() for _ in range(64)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for r in df.collect():
        turned = all(x <= 0 for x in r.embedding[1:4])
        for at, x in enumerate(r.embedding[::-1] if turned else r.embedding):
            want[r.vec_id, at] = (turned, 1.0 if at < 4 or at >= 60 else x)
    got = pixels.q_rotate_mask(spark, str(tmp_path))
    assert {(r.vec_id, r["at"]): (r.turned, r.pixel) for r in got.collect()} == want and got.count() == 12 * 64
    embeddings = pq.read_table(f"{tmp_path}/embeddings.parquet")  # noqa: F841
    sql = duckdb.sql(pixels.ORACLE_SQL["rotate_mask"]).fetchall()
    assert sql and all(want[i, at] == (turned, x) for i, turned, at, x in sql)
