"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps A-Z to a-z and leaves every other character as it is (for ``str.translate``).
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def batches(it: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[dict[str, list]]:
    """Arrow batches cut into slices of at most ``rows``, as columns of Python values."""
    for batch in it:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows).to_pydict()


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 256) -> DataFrame:
    """Apply ``fn`` to slices of rows; memory in a task is bounded by the slice, not the partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in batches(it, rows):
            out = fn(columns)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, column: str, keep: Callable[[list], list[bool]], rows: int = 64) -> DataFrame:
    """The rows for whose value of ``column`` ``keep`` is true; all columns pass through unread."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield part.filter(pa.array(keep(part.column(column).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def arrow_replace(df: DataFrame, column: str, fn: Callable[[list], list], rows: int = 64) -> DataFrame:
    """All rows and columns, with the values of one column replaced."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                at = part.schema.get_field_index(column)
                yield part.set_column(at, part.schema.field(at), pa.array(fn(part.column(at).to_pylist()), type=part.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def fit_sample(df: DataFrame, id_col: str, rows: int, *also: str) -> DataFrame:
    """About ``rows`` rows, chosen by the hash of their id, for fitting a classifier.

    The columns ``also`` are hashed with the id, so that rows without an id, or with the same one, do not go together.

    A row is taken if its hash falls below rows / count, so every task keeps its share only and the
    sample stays spread over the tasks; a table of up to ``rows`` rows is taken whole.
    """
    share = rows / max(1, df.count())
    if share >= 1:
        return df
    steps = 1 << 40
    return df.filter(F.pmod(F.xxhash64(id_col, *also), F.lit(steps)) < int(share * steps))


def finite(vector: str) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def floored(vector: str, scale: int) -> Column:
    """Each component as the integer floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def of_one_length(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector has the commonest length, of several the shortest."""
    first = vectors.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return vectors.filter(F.size(vector_col) == (first.n if first else 0))
