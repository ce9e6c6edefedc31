"""Running totals along an order within keys, for keys of any size.

A window function sorts all rows of a key in one task. Here rows are sorted by
ranges, each task totals what it has, and only one row per task (its last key and
that key's totals) is passed on, so that a key with a third of all rows runs in
as many tasks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scratch import stored
from ..functions.ship import ship

#: Ways to total longs: how arrays, and two numbers, are combined.
FOLDS = {"sum": (np.cumsum, lambda a, b: a + b), "xor": (np.bitwise_xor.accumulate, lambda a, b: a ^ b), "max": (np.maximum.accumulate, max)}


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Which rows but the first differ from the one before in a key; nulls are equal."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in keys:
        c = batch.column(batch.schema.get_field_index(k))
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.if_else(pc.and_(a.is_null(), b.is_null()), True, pc.fill_null(pc.equal(a, b), False))
        out |= ~same.to_numpy(zero_copy_only=False)
    return out


def scanned(df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, str]) -> DataFrame:
    """df with a column `<value>_run` for each long column in values ("sum", "xor" or "max"): its total over the row and those before it in the order, within equal keys.

    Rows that tie in the order come in any order, but one for all values. Null
    keys are a key; null values count as 0. The result is a table in the shared
    folder; to the driver comes one row per task.
    """
    spark = df.sparkSession
    ship(spark)
    names, folds = list(values), [FOLDS[v] for v in values.values()]
    own = [*((f"{v}_run", T.LongType()) for v in names), ("__part", T.IntegerType()), ("__row", T.LongType()), ("__first", T.BooleanType())]
    fields = T.StructType([*df.schema.fields, *(T.StructField(n, kind) for n, kind in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, first, last, carried = TaskContext.get().partitionId(), 0, True, None, [0] * len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = [batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys]
            new = np.r_[last is not None and key != last, _changes(batch, keys)]
            heads = np.unique(np.r_[0, np.flatnonzero(new)])
            tops = np.maximum.accumulate(np.where(np.isin(np.arange(n), heads), np.arange(n), 0))
            out = []
            for i, (v, (fold, join)) in enumerate(zip(names, folds, strict=True)):
                x = batch.column(batch.schema.get_field_index(v)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).copy()
                if not new[0]:
                    x[0] = join(int(x[0]), carried[i]) if last is not None else x[0]
                total = _by_run(x, heads, tops, fold)
                carried[i] = int(total[-1])
                out.append(pa.array(total))
            opening = (np.cumsum(new) == 0) if first else np.zeros(n, bool)
            first = first and not new.any()
            last = [batch.column(batch.schema.get_field_index(k))[n - 1].as_py() for k in keys]
            where = [pa.array(np.full(n, part, np.int32)), pa.array(row + np.arange(n)), pa.array(opening)]
            row += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, *where], fields.names)

    columns = [c if isinstance(c, Column) else F.col(c) for c in [*keys, *order]]
    local = stored(df.repartitionByRange(*columns).sortWithinPartitions(*columns).mapInArrow(run, fields), "scan")
    runs = [f"{v}_run" for v in names]
    facts = F.struct(*keys, *runs, F.col("__first").alias("whole"))
    tails = local.groupBy("__part").agg(F.max_by(facts, "__row").alias("tail"), F.min_by(F.struct(*keys), "__row").alias("head")).orderBy("__part").collect()
    before, carried, last = [], [0] * len(names), None
    for r in tails:
        same = last is not None and tuple(r.head) == last
        start = carried if same else [0] * len(names)
        before.append((r["__part"], *start))
        ends = [r.tail[c] for c in runs]
        carried = [join(a, b) for (_, join), a, b in zip(folds, start, ends, strict=True)] if r.tail["whole"] and same else ends
        last = tuple(r.tail[k] for k in keys)
    starts = spark.createDataFrame(before, ", ".join(["__part int", *(f"`__{v}` long" for v in names)]))
    whole = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b), "max": F.greatest}
    out = [F.when(F.col("__first"), whole[how](F.col(f"{v}_run"), F.col(f"__{v}"))).otherwise(F.col(f"{v}_run")).alias(f"{v}_run") for v, how in values.items()]
    return local.join(F.broadcast(starts), "__part").select(*df.columns, *out)


def _by_run(x: np.ndarray, heads: np.ndarray, tops: np.ndarray, fold) -> np.ndarray:
    """The fold's running values, anew from each head on."""
    if len(heads) == 1:
        return fold(x)
    total = fold(x) if fold is not np.maximum.accumulate else x
    if fold is np.cumsum:
        return total - np.where(tops > 0, total[tops - 1], 0)
    if fold is np.bitwise_xor.accumulate:
        return total ^ np.where(tops > 0, total[tops - 1], 0)
    return np.concatenate([fold(part) for part in np.split(x, heads[1:])])
