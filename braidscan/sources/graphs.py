"""Readers and writers of graph text files, as transforms over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_END = r'"?([^"\s;]+)"?'


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(value, file): the lines of every file under path whose name fits the glob."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def parse_dot(lines: DataFrame) -> DataFrame:
    """(src, dst) of each `a -> b` line; node lines fall away."""
    pattern = rf"^\s*{_END}\s*->\s*{_END}"
    e = lines.select(F.regexp_extract("value", pattern, 1).alias("src"), F.regexp_extract("value", pattern, 2).alias("dst"))
    return e.filter((F.col("src") != "") & (F.col("dst") != ""))


def parse_dot_labels(lines: DataFrame) -> DataFrame:
    r"""Edges of a DOT file with numeric ids, by the nodes' label="name\l"."""
    node = r'^\s*"?(\d+)"?\s*\[.*?label\s*=\s*"(.*?)(?:\\l)?"'
    n = lines.filter(~F.col("value").contains("->")).select(F.regexp_extract("value", node, 1).alias("id"), F.regexp_extract("value", node, 2).alias("name")).filter("id <> ''")
    return _named(parse_dot(lines), n)


def parse_gdl(lines: DataFrame) -> DataFrame:
    """Edges of a GDL file, by the nodes' labels."""
    node = r'node:\s*\{\s*title:\s*"([^"]*)"\s*label:\s*"([^"]*)"'
    edge = r'edge:\s*\{\s*sourcename:\s*"([^"]*)"\s*targetname:\s*"([^"]*)"'
    n = lines.select(F.regexp_extract("value", node, 1).alias("id"), F.regexp_extract("value", node, 2).alias("name")).filter("id <> ''")
    e = lines.select(F.regexp_extract("value", edge, 1).alias("src"), F.regexp_extract("value", edge, 2).alias("dst")).filter("src <> ''")
    return _named(e, n)


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("src"), F.col("name").alias("s")), nodes.select(F.col("id").alias("dst"), F.col("name").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def parse_truth(lines: DataFrame, longest: int = 4, gap: int = 2) -> DataFrame:
    """(addr1, addr2) of `[a, b][c, d]` lines; long or uneven lists fall away."""
    part = F.regexp_extract_all("value", F.lit(r"\[([^\]]*)\]"), 1)
    num = lambda i: F.transform(F.split(F.get(part, F.lit(i)), r"\s*,\s*"), lambda x: x.cast("long"))
    x = lines.select(num(0).alias("a"), num(1).alias("b")).filter((F.size("a") <= longest) & (F.size("b") <= longest) & (F.abs(F.size("a") - F.size("b")) <= gap))
    return x.select(F.explode("a").alias("addr1"), "b").select("addr1", F.explode("b").alias("addr2"))


def dot_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit('"'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";')).alias("line"))


def write_dot(edges: DataFrame, path: str) -> None:
    dot_lines(edges).withColumnRenamed("line", "value").write.mode("overwrite").text(path)


def write_signed_edges(edges: DataFrame, path: str) -> None:
    edges.select("i", "j", "sign").write.mode("overwrite").option("sep", "\t").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)
