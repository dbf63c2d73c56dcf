"""Sinks: replace by key, playlists, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions of the keys in ``df``; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def clean(text: Column) -> Column:
    """Without control characters, which would break a line of text output."""
    return F.regexp_replace(text, "[\\x00-\\x1F\\x7F]", " ")


def playlist_lines(df: DataFrame, group: str, step: str, title: str, path: str, seconds: str) -> DataFrame:
    """``group, body``: an extended M3U text per group; entries without a path are left out and counted."""
    entry = F.concat(F.lit("#EXTINF:"), F.floor(seconds).cast("string"), F.lit(","), clean(F.col(title)), F.lit("\n"), clean(F.col(path)))
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.when(F.col(path).isNotNull(), F.struct(F.col(step).alias("s"), entry.alias("e"))))).alias("r"), F.count_if(F.col(path).isNull()).alias("skipped"))
    return rows.select(group, F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform("r", lambda x: x["e"]), "\n")).alias("body"), "skipped")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of already aggregated rows."""
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([r.get(c, "") for c in columns]) for r in rows]])


def snapshot(df: DataFrame, path: str) -> None:
    """A copy of a table at this moment; an existing one is never overwritten."""
    df.write.mode("error").parquet(path)
