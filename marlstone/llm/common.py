"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = "\\x20\\x09-\\x0D"


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` serves where the text holds nothing but ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def plain_words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case; null for null."""
    return F.array_remove(F.split(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def row_key(*columns: str) -> list[Column]:
    """128 bits that stand for a row's id and text, never null, so that null and repeated ids join safely."""
    return [F.xxhash64(*columns).alias("__k1"), F.xxhash64(F.lit(5), *reversed(columns)).alias("__k2")]


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Apply ``fn(*columns)``, which takes a batch's columns as lists, to Arrow batches.

    ``fn`` returns one list of values (or Arrow array) per output column. A batch with a huge
    text is cut into slices of about 16 MB, so the memory of a worker stays bounded.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * 16e6 / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = fn(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(made, out)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.select(*columns).mapInArrow(run, schema)
