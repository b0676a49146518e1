"""Access to the driver's parquet tables.

Only the columns a query needs are selected, so the parquet scan's
``ReadSchema`` stays narrow; filters written after ``read`` are pushed into the
scan by Catalyst.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df
