"""Article and point tables stored by key, so that jobs meet them where they lie."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.corpus import KEYS


def store_buckets(df: DataFrame, path: str, buckets: int | None = None, keys=KEYS,
                  table: str | None = None) -> DataFrame:
    """``df`` written to ``path`` as a table bucketed and sorted by ``keys``, and read back.

    One shuffle when it is written spares one in every merge, look-up and comparison by these keys:
    their plans move the other side only. Law and article together are the key, so a law with
    many articles is spread over all buckets. ``buckets`` is by default the session's number of
    shuffle partitions; with fewer than those a later job would shuffle the table for the sake
    of more tasks. The table is external: dropping it leaves the files,
    and an existing one of that name is an error.
    """
    table = table or f"buckets_{uuid.uuid4().hex}"
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *keys)
    dealt.write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)
