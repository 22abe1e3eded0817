"""Sources and sinks: tables of texts, files of words parted by spaces, and JSON rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.training import gold_words, line_samples

_FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".csv": "csv", ".orc": "orc"}


def read_texts(spark: SparkSession, path: str, text: str = "text", id_col: str = "doc_id", fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """A table with ``text`` and ``id_col`` from a Parquet, ORC, JSON or CSV file or folder, or one row for each line of a text file.

    Where there is no id column, rows are numbered in no special order.
    """
    fmt = fmt or _FORMATS.get(Path(path).suffix, "text")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema:
        reader = reader.schema(schema)
    df = reader.load(path)
    if fmt == "text":
        df = df.withColumnRenamed("value", text)
    if id_col not in df.columns:
        df = df.withColumn(id_col, F.monotonically_increasing_id())
    if text not in df.columns:
        raise ValueError(f"there is no column {text!r}")
    return df


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object for each row."""
    df.write.json(path)


def expand_paths(paths: list[str]) -> list[str]:
    """Files as they are; of folders their ``*.txt`` files, in order, not those of folders below."""
    out: list[str] = []
    for p in map(Path, paths):
        if p.is_dir():
            found = sorted(map(str, p.glob("*.txt")))
            if not found:
                raise ValueError(f"{p} has no .txt files")
            out += found
        elif p.exists():
            out.append(str(p))
        else:
            raise FileNotFoundError(str(p))
    return out


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line_no, line) of files of words parted by spaces; comments and blank lines are left out.

    The number is a pair of the file's and the line's place in it.  A file that doesn't
    end in a line break doesn't run into the next.
    """
    files = expand_paths(paths)
    parts = [
        spark.read.text(f).withColumn("line_no", F.struct(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("at"))).select("line_no", F.trim(F.col("value")).alias("line"))
        for i, f in enumerate(files)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.where("line <> '' AND NOT startswith(line, '#')")


def gold(lines: DataFrame) -> DataFrame:
    """(line_no, words)."""
    return lines.select("line_no", F.filter(F.split(F.trim("line"), " "), lambda w: w != "").alias("words"))


def load_corpus(text: str) -> list[dict]:
    """Training samples of a text of lines, in the driver."""
    return [s for line in text.splitlines() for s in line_samples(line)]


__all__ = ["expand_paths", "gold", "gold_words", "load_corpus", "read_lines", "read_texts", "write_json"]
