"""Where users plug in their own models and steps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.session import cut, tasks


def _any_place(df: DataFrame) -> Column:
    """A number per row that spreads the rows of one key over ranges."""
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    return F.xxhash64(*plain)


def apply_model(
    df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str
) -> DataFrame:
    """Run a model over batches; ``load`` builds it once per partition.

    Filter to the rows that are due before calling this: an expensive model
    must not see rows it has nothing to do for.
    """

    def run(batches):
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def isolated(df: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], key: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(results, status): run a step on the rows of each key; a failure stops that key and no other.

    The step gets rows of one key, as many as come together, and gives rows of ``schema``. Rows are dealt by ranges
    of (key, hash), so that those of a key come together and a hot one still fills several tasks; a hot key is
    never gathered, so a step must not need all rows of its key at once. A key is ``ok`` or ``failed``
    as a whole: once a part fails, none of its results are returned, and its status tells the
    error. What the step gave is written to the shared folder while the plan is built, so that
    results and status come from one run of it.
    """
    kind = df.schema[key].dataType
    result = T._parse_datatype_string(schema)
    names = result.fieldNames()

    def run(batches):
        for batch in batches:
            rows = []
            for value, part in batch.groupby(key, sort=False, dropna=False):
                own = None if pd.isna(value) else value
                try:
                    found = step(part)[names].to_dict("records")
                    rows += [(own, None, row) for row in found] or [(own, None, None)]
                except Exception as error:  # a bad source must not stop the others
                    rows.append((own, f"{type(error).__name__}: {error}", None))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "error", "result"])

    out = T.StructType([T.StructField("key", kind), T.StructField("error", T.StringType()), T.StructField("result", result)])
    dealt = df.repartitionByRange(tasks(df.sparkSession), key, _any_place(df)).sortWithinPartitions(key)
    ran = cut(dealt.mapInPandas(run, out))
    told = F.min("error").alias("error")
    status = ran.groupBy("key").agg(told).select(
        F.col("key").alias(key), F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error"
    )
    failed = ran.filter("error is not null").select(F.col("key").alias("_failed")).distinct()
    good = ran.filter("result is not null").join(failed, F.col("key").eqNullSafe(F.col("_failed")), "left_anti")
    return good.select(F.col("key").alias(f"{key}"), *[F.col("result")[n].alias(n) for n in names if n != key]), status


def read_by(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, *, reading: str = "reading") -> DataFrame:
    """``df`` with a struct (is_available, error, result): a reader whose failures are data.

    ``load`` builds the reader once per partition and may fail, which makes it unavailable for the rows
    of that partition. A reader that fails on some rows is asked for halves of them down to single rows, so only the
    rows at fault carry its error; such rows have no result. How many rows are asked for at once
    follows the share at fault so far. Rows are dealt to all tasks, as a reader is the work.
    """
    result = T._parse_datatype_string(schema)
    names = result.fieldNames()
    struct = T.StructType(
        [T.StructField("is_available", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("result", result)]
    )

    def reason(error: Exception) -> str:
        return f"{type(error).__name__}: {error}"

    def ask(reader, batch, at_fault=False):
        """Readings of a batch; one that is known to be at fault is asked for in halves right away."""
        if not at_fault or len(batch) == 1:
            try:
                found = reader(batch)[names]
                columns = [found[n].tolist() for n in names]
                return [(True, None, row) for row in zip(*columns, strict=True)]
            except Exception as error:
                if len(batch) == 1:
                    return [(True, reason(error), None)]
        half = len(batch) // 2
        first = ask(reader, batch.iloc[:half])
        return first + ask(reader, batch.iloc[half:], at_fault=all(x[2] is not None for x in first))

    def ask_all(reader, batch, seen):
        out = []
        while len(out) < len(batch):
            rows, faults = seen
            # with a share p at fault, groups of ln 2 / p take the fewest calls
            size = min(len(batch), max(1, round(0.69 * (rows + 1) / faults))) if faults else len(batch)
            found = ask(reader, batch.iloc[len(out) : len(out) + size])
            out += found
            seen[0] += size
            seen[1] += sum(1 for x in found if x[2] is None)
        return out

    def run(batches):
        try:
            reader, missing = load(), None
        except Exception as error:
            reader, missing = None, (False, reason(error), None)
        seen = [0, 0]
        for batch in batches:
            yield batch.assign(**{reading: [missing] * len(batch) if reader is None else ask_all(reader, batch, seen)})

    return df.repartition(tasks(df.sparkSession)).mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(reading, struct)]))
