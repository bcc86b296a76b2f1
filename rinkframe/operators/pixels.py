"""Pixels as arrays, and the suppression of overlapping boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkframe.session import table


def suppress(boxes: DataFrame, image: str, iou: float = 0.3, conf: float = 0.5) -> DataFrame:
    """In each image the surest box stays, and those that overlap it by more than `iou` go, and so on; boxes under `conf` go first.

    boxes: image, conf, x1, y1, x2, y2. A group is one image's boxes, which a detector bounds.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["conf", "x1", "y1", "x2", "y2"], ascending=[False, True, True, True, True])
        b, keep = rows[["x1", "y1", "x2", "y2"]].to_numpy(), []
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        for i in range(len(b)):
            both = np.clip(np.minimum(b[i, 2:], b[keep, 2:]) - np.maximum(b[i, :2], b[keep, :2]), 0, None).prod(1)
            if not (both > iou * (area[i] + area[keep] - both)).any():
                keep.append(i)
        return rows.iloc[keep]

    return boxes.where(F.col("conf") >= conf).groupBy(image).applyInPandas(one, boxes.schema)


def q_pixel_counts(spark, d):
    """Inverted if dark pixels outnumber bright ones."""
    bright = F.size(F.filter("embedding", lambda x: x > 0))
    rows = table(spark, d, "embeddings").select("vec_id", bright.cast("long").alias("bright"), (F.size("embedding") - bright).cast("long").alias("dark"))
    return rows.withColumn("inverted", F.col("dark") > F.col("bright"))


def q_rotate_mask(spark, d):
    """Turned round if a strip is empty; then all but the middle is white."""
    empty = F.forall(F.slice("embedding", 2, 3), lambda x: x <= 0)
    turned = F.when(empty, F.reverse("embedding")).otherwise(F.col("embedding"))
    masked = F.transform(turned, lambda x, i: F.when((i < 4) | (i >= F.size("embedding") - 4), F.lit(1.0).cast("float")).otherwise(x))
    return table(spark, d, "embeddings").select("vec_id", empty.alias("turned"), F.posexplode(masked).alias("at", "pixel"))


def q_box_suppression(spark, d):
    at = lambda i: F.get("embedding", i).cast("double")
    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).alias("image"), (F.abs(at(0)) % 1).alias("conf"), at(1).alias("x1"), at(2).alias("y1"))
    boxes = e.withColumn("conf", F.col("conf") / 2 + 0.5).withColumn("x2", F.col("x1") + 0.2).withColumn("y2", F.col("y1") + 0.2)
    return suppress(boxes, "image")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLE_SQL = {
    "pixel_counts": "SELECT vec_id, CAST(b AS BIGINT) AS bright, CAST(n - b AS BIGINT) AS dark, n - b > b AS inverted FROM (SELECT vec_id, len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0)) AS b FROM embeddings)",
    "rotate_mask": """WITH t AS (SELECT vec_id, embedding[2] <= 0 AND embedding[3] <= 0 AND embedding[4] <= 0 AS turned, embedding AS e, len(embedding) AS n FROM embeddings), i AS (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM t)
SELECT vec_id, turned, CAST(k AS INT) AS at, CASE WHEN k < 4 OR k >= n - 4 THEN CAST(1 AS FLOAT) WHEN turned THEN e[n - k] ELSE e[k + 1] END AS pixel FROM i""",
    # the suppression itself: in the order of confidence, a box stays if no box that has stayed overlaps it
    "box_suppression": """WITH RECURSIVE b AS (SELECT vec_id, vec_id // 16 AS image, abs(CAST(embedding[1] AS DOUBLE)) % 1 / 2 + 0.5 AS conf, CAST(embedding[2] AS DOUBLE) AS x1, CAST(embedding[3] AS DOUBLE) AS y1 FROM embeddings),
c AS (SELECT vec_id, CAST(image AS BIGINT) AS image, conf, x1, y1, x1 + 0.2 AS x2, y1 + 0.2 AS y2, row_number() OVER (PARTITION BY image ORDER BY conf DESC, x1, y1, x1 + 0.2, y1 + 0.2) AS n FROM b),
o AS (SELECT p.image, p.n AS p, q.n AS q FROM c p JOIN c q ON p.image = q.image AND p.n < q.n WHERE greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0)
 > 0.3 * ((p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0))),
s AS (SELECT image, 0 AS n, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image FROM c)
 UNION ALL SELECT s.image, s.n + 1, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.image = s.image AND o.q = s.n + 1 AND list_contains(s.kept, o.p)) THEN s.kept ELSE list_append(s.kept, s.n + 1) END FROM s WHERE s.n < (SELECT max(n) FROM c WHERE c.image = s.image))
SELECT vec_id, c.image, conf, x1, y1, x2, y2 FROM c JOIN (SELECT image, arg_max(kept, n) AS kept FROM s GROUP BY image) k ON k.image = c.image AND list_contains(kept, c.n)""",
}
