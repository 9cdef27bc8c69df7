"""Reading, storing and the shapes of rows shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.session import materialize as stored  # noqa: F401  a table in the shared folder, read back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as (id, text), a null text being empty; other columns are left behind, so their names can't clash."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    """(id, text) of every row of the Arrow batches of keyed()."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows gathered to Arrow batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_type(df: DataFrame, name: str = "id") -> str:
    """DDL name of a column's type."""
    return df.schema[name].dataType.simpleString()


def spread_join(big: DataFrame, small: DataFrame, on: list[str], piece: Column) -> DataFrame:
    """Left join of `big` with `small`, which has each key at most once.

    A key's rows in `big` are cut into pieces, and each piece asks `small`
    once.  So many tasks join a key of many rows, and the pieces of a key grow
    with it.
    """
    big = big.withColumn("_piece", piece)
    asked = big.select(*on, "_piece").distinct().join(small, on, "left")
    return big.join(asked, [*on, "_piece"], "left").drop("_piece")
