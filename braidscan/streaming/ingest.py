"""Incremental ingestion: vectors arriving as a stream go to bucket tables, queries join them statically."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidscan.functions import hashes


def bucket_rows(vectors: DataFrame, seeds=(1, 2, 3), bits: int = 8, dim: int = 64) -> DataFrame:
    """(hash_name, bucket_key, id, v) of vectors (id, v); stateless, so it runs on streams and tables alike."""
    each = F.explode(F.array(*[F.struct(F.lit(f"h{s}").alias("hash_name"), hashes.binary_key(F.col("v"), hashes.normals(s, bits, dim)).alias("bucket_key")) for s in seeds]))
    return vectors.select("id", "v", each.alias("k")).select("k.hash_name", "k.bucket_key", "id", "v")


def store_stream(vectors: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append a stream's bucket rows, partitioned by hash; available data only, then it ends."""
    rows = bucket_rows(vectors, **options)
    return rows.writeStream.format("parquet").partitionBy("hash_name").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
