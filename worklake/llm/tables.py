"""Small things the operators share: plain ids, scratch tables, checked broadcasts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.operators.ordered import checkpoint_dir, materialize

__all__ = ["NO_ID", "broadcast_if_small", "checkpoint_dir", "let", "materialize", "plain_id", "repeated_ids", "shared_rows", "small_batches"]

#: Stands for a null id inside the operators; comes before all other ids.
NO_ID = -(1 << 63)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: texts and sets may be of any length, so a number of rows is no bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def plain_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Asks for a broadcast of a written table of up to `rows` rows; beyond, Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose long `key` another row has too, and perhaps the first and last row of each partition.

    Rows are dealt by ranges of all their columns, so a key that many rows have spreads over tasks, and
    each row is compared with its neighbors. What lies beyond a partition is taken for equal.
    """

    def mark(batches):
        held = None  # the last row so far: its batch, and whether the row before it has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(key).to_numpy()
            same = k[1:] == k[:-1]
            before = np.r_[held is None or held[1] == k[0], same]
            if held is not None and (held[2] or held[1] == k[0]):
                yield held[0]
            keep = before[:-1] | same
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep, pa.bool_()))
            held = (batch.slice(batch.num_rows - 1), k[-1], bool(before[-1]))
        if held is not None:
            yield held[0]

    order = [key, *[c for c in rows.columns if c != key]]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(mark, rows.schema)


def repeated_ids(ids: DataFrame) -> bool:
    """Whether some value of the one column `d` occurs more than once."""
    return not ids.groupBy("d").count().filter("count > 1").limit(1).isEmpty()
