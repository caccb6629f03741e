"""Bounded collections of the most frequent entries of a count table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def frequent(counts: DataFrame, n: Column, most: int) -> list[Row]:
    """At most `most` rows, all those above some count, largest first; no partition sends more than its share.

    Counts fall into buckets an eighth of an octave wide; buckets are taken from the top while they fit.
    """
    bucket = F.floor(F.log2(n.cast("double")) * 8).cast("int")
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect()
    least, room = None, most
    for r in sorted(sizes, key=lambda r: -(r["b"] if r["b"] is not None else -1)):
        if r["b"] is None or r["k"] > room:
            break
        least, room = r["b"], room - r["k"]
    if least is None:
        return counts.orderBy(n.desc(), counts.columns[0]).limit(min(most, 4096)).collect()
    return sorted(counts.withColumn("_n", n).filter(bucket >= least).collect(), key=lambda r: (-r["_n"], r[0]))
