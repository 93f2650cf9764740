"""Functions of the user's own over groups of a table, as further forms of free analysis.

Three forms, by what the function needs to see:

* ``ordered``: the rows of a group in order, one after the other (a table function with a
  partition and an order); its state is what it keeps itself;
* ``per_group``: the rows of a group in any order, as a stream of pandas frames of bounded
  size, so that a group needs not fit in memory;
* ``aggregated``: rows of a group in parts. The parts of each task become states first, and
  the states of a group are merged, so that a group that holds a third of the table is
  shared out and a few states per task reach the exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered(df: DataFrame, handler: type, schema: str, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What a table function's class yields for each partition.

    ``handler`` has ``eval(row)`` for each row and may have ``terminate()`` for the end of a
    partition; each partition has an instance of its own. Rows with null keys are a
    partition like any other.
    """
    function = F.udtf(handler, returnType=schema)
    return function(df.asTable().partitionBy(*partition).orderBy(*order))


def per_group(df: DataFrame, keys: Sequence[str], function: Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``function(key, frames)`` yields for each group; the frames have all columns of some rows."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in function(tuple(k.as_py() for k in key), (b.to_pandas() for b in batches)):
            yield pa.RecordBatch.from_pandas(found, out, preserve_index=False)

    return df.groupBy(*keys).applyInArrow(run, schema)


def aggregated(
    df: DataFrame,
    keys: Sequence[str],
    fold: Callable[[pd.DataFrame], dict],
    merge: Callable[[pd.DataFrame], dict],
    state: str,
    finish: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """The keys and the merged state of each group, or what ``finish`` makes of frames of them.

    ``fold`` makes a state, a dict of the fields of ``state``, of some rows of a group;
    ``merge`` makes one of a frame of states. ``finish`` maps frames of keys and states to
    ones of ``schema``, row by row or not, as it likes.
    """
    key_fields = [df.schema[k] for k in keys]
    kinds = T.StructType([*key_fields, *T.StructType.fromDDL(state).fields])
    names, out = list(keys), to_arrow_schema(kinds)

    def states(table: pa.Table, make: Callable[[pd.DataFrame], dict]) -> pa.RecordBatch:
        # keys keep their types, and null is a key
        number = table.select(names).to_pandas(types_mapper=pd.ArrowDtype).groupby(names, dropna=False, sort=False).ngroup().to_numpy()
        frame, rows = table.to_pandas(), []
        for at in pd.Series(range(len(number))).groupby(number).indices.values():
            rows.append(table.select(names).slice(int(at[0]), 1).to_pylist()[0] | make(frame.iloc[at]))
        return pa.RecordBatch.from_pylist(rows, out)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(states(pa.Table.from_batches([batch]), fold))
                rows += held[-1].num_rows
            if rows > STATES:
                held = [states(pa.Table.from_batches(held), merge)]
                yield from held
                held, rows = [], 0
        if held:
            yield states(pa.Table.from_batches(held), merge)

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: pa.RecordBatch | None = None
        for batch in batches:
            both = [batch] if so_far is None else [so_far, batch]
            so_far = states(pa.Table.from_batches(both), merge)
        if so_far is not None:
            yield so_far

    found = df.mapInArrow(folded, kinds).groupBy(*keys).applyInArrow(merged, kinds)
    if finish is None:
        return found

    def finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(finish, frames)

    return found.mapInPandas(finished, schema)


STATES = 50_000  # that a task holds before it passes them on
