"""Line model of a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the line ends of the text model; one empty piece after the last end is no line.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def line_array(text):
    """Lines of a text column as an array; null and empty text have none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line): lines numbered from 1."""
    return docs.select(key, F.posexplode(line_array(F.col(text))).alias("pos", "line")).select(
        key, (F.col("pos") + 1).alias("n"), "line")
