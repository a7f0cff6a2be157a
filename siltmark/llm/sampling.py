"""A bounded sample of labelled rows for fitting, so many of each class however many rows there are."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def hash_bound(n: int, most: int) -> int:
    """The signed 64-bit value below which about `most` of n evenly spread 64-bit hashes lie; all but the largest if n is not more than that."""
    return 2**63 - 1 if n <= most else -(2**63) + (most << 64) // n


#: Characters of all sampled texts together, and the least of a row for which a sample is worth taking.
MOST_CHARS, LEAST_CHARS = 1 << 26, 1 << 10


def by_class(
    rows: DataFrame, most: Callable[[object, float, int], int], sample_bytes: int, id_col: str, text_col: str, class_col: str, labels: DataFrame | None = None, most_chars: int = MOST_CHARS
) -> pd.DataFrame:
    """(text, label) of about most(class, its share of the rows, number of classes) rows of each class at the driver, in a fixed order.

    The class is a column of the rows, or of `labels` (id, class; one row an id) by their id; then hashes of the rows go to the labels, not their texts.
    Rows are chosen by a 64-bit hash of id and text among all rows with a label and a text that is not empty; of rows that are equal in both, one. Of a text of more than
    sample_bytes characters, so many from a place that the hash decides, and fewer where all rows together would have more than `most_chars`. Every class is sampled: where that would leave
    less than LEAST_CHARS characters of a row, or there are more classes than such rows, it is an error.
    """
    text = F.col(text_col).alias("text")
    whole = rows.select(F.col(id_col).alias("id"), text, *([] if labels is not None else [F.col(class_col).alias("label")])).filter(F.octet_length("text") > 0).withColumn("h", F.xxhash64("id", "text", F.lit(5)))
    if labels is None:
        known = whole.filter(F.col("label").isNotNull()).select("h", "label")
    else:
        given = labels.select(F.col(id_col).alias("id"), F.col(class_col).alias("label")).filter(F.col("label").isNotNull())
        known = checkpointed(whole.select("id", "h").join(given, "id").select("h", "label"))
    counts = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_chars // LEAST_CHARS + 1).collect()
    if not counts:
        return pd.DataFrame({"text": [], "label": []})
    n = sum(r["count"] for r in counts)
    wanted = {r["label"]: min(r["count"], most(r["label"], r["count"] / n, len(counts))) for r in counts}
    per_row = min(sample_bytes, most_chars // max(1, sum(wanted.values())))
    if per_row < min(sample_bytes, LEAST_CHARS):
        raise ValueError(f"{sum(wanted.values())} rows of {len(counts)} classes or more do not fit {most_chars} characters")
    bounds = rows.sparkSession.createDataFrame([(r["label"], hash_bound(r["count"], wanted[r["label"]])) for r in counts], known.select("label", F.lit(0).cast("long").alias("bound")).schema)
    # a bound for each class, and a few rows for each bound
    if labels is None:
        chosen = whole.join(F.broadcast(bounds), "label").filter(F.col("h") <= F.col("bound"))
    else:
        picked = known.join(F.broadcast(bounds), "label").filter(F.col("h") <= F.col("bound")).groupBy("h").agg(F.min("label").alias("label"))
        chosen = whole.join(F.broadcast(picked), "h")
    spare = F.length("text") - per_row
    part = F.when(spare > 0, F.substring("text", F.pmod("h", spare + 1).cast("int") + 1, F.lit(per_row))).otherwise(F.col("text"))
    return chosen.select("label", "h", part.alias("text")).dropDuplicates(["h"]).select("text", "label").toPandas().sort_values(["label", "text"], kind="stable", ignore_index=True)
