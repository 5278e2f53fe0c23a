"""Ordered computations over a key that may hold a large part of all rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Here every
key is cut into chunks of a fixed span of its clock, so that a task never gets
more than one chunk:

* what looks back a bounded distance gets a *halo*: the last rows of a chunk
  are also sent to the next one;
* what looks back without a bound is computed inside the chunk and completed
  with one value *carried* from the earlier chunks. The carried values come
  from one row per chunk, which is pre-aggregated before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
GHOST = "_ghost"
DEFAULT_SPAN = 65_536


def chunk_of(position: str | Column, span: float) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(span)).cast("bigint")


def with_halo(
    df: DataFrame, position: str, *, span: float = DEFAULT_SPAN, before: float = 0, after: float = 0
) -> DataFrame:
    """Assign rows to chunks and copy chunk edges to the neighbouring chunks.

    Copies carry ``_ghost = true``; drop them after the window with
    :func:`drop_ghosts`.
    """
    if max(before, after) > span:
        raise ValueError("a halo must not be wider than the chunk span")
    own = chunk_of(position, span)
    offset = F.col(position) - own * F.lit(span)
    homes = [F.struct(own.alias(CHUNK), F.lit(False).alias(GHOST))]
    if before:
        homes.append(
            F.when(
                offset >= F.lit(span - before),
                F.struct((own + 1).alias(CHUNK), F.lit(True).alias(GHOST)),
            )
        )
    if after:
        homes.append(
            F.when(
                offset < F.lit(after),
                F.struct((own - 1).alias(CHUNK), F.lit(True).alias(GHOST)),
            )
        )
    if len(homes) == 1:
        return df.select("*", own.alias(CHUNK), F.lit(False).alias(GHOST))
    return df.select("*", F.inline(F.array_compact(F.array(*homes))))


def drop_ghosts(df: DataFrame, keep_chunk: bool = False) -> DataFrame:
    """Drop the copies. With ``keep_chunk`` a carry over the same clock and span
    that follows finds its rows already in place and needs no shuffle."""
    own = df.filter(~F.col(GHOST))
    return own.drop(GHOST) if keep_chunk else own.drop(CHUNK, GHOST)


def _in_chunks(df: DataFrame, position: str, span: float, values: dict[str, Column]) -> DataFrame:
    """Add the values, and the chunk of every row unless it is already there."""
    if CHUNK not in df.columns:
        df = df.withColumn(CHUNK, chunk_of(position, span))
    return df.withColumns(values)


def chunk_window(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _descending(order: Sequence[str]) -> list[Column]:
    return [F.col(name).desc() for name in order]


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    *,
    span: float = DEFAULT_SPAN,
    include_current: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Last non-null value at (or strictly before) each row of its key.

    ``order[0]`` must be the numeric clock of the key. With ``reverse`` the
    next non-null value is taken instead.
    """
    keys, order = list(keys), list(order)
    raw = {name: f"_raw_{name}" for name in values}
    chunked = _in_chunks(df, order[0], span, {raw[n]: v for n, v in values.items()})
    kept = [c for c in df.columns if c != CHUNK]
    direction = _descending(order) if reverse else [F.col(name) for name in order]
    rows = chunk_window(keys, *direction).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1
    )
    local = chunked.withColumns(
        {f"_in_{n}": F.last(raw[n], ignorenulls=True).over(rows) for n in values}
    )
    pick = F.min_by if reverse else F.max_by
    moment = F.struct(*order)
    edges = chunked.groupBy(*keys, CHUNK).agg(
        *[
            pick(F.col(raw[n]), F.when(F.col(raw[n]).isNotNull(), moment)).alias(f"_edge_{n}")
            for n in values
        ]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(F.col(CHUNK).desc() if reverse else F.col(CHUNK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(
        *keys,
        CHUNK,
        *[F.last(f"_edge_{n}", ignorenulls=True).over(earlier).alias(f"_far_{n}") for n in values],
    ).filter(" or ".join(f"`_far_{n}` is not null" for n in values))
    return local.join(carried, [*keys, CHUNK], "left").select(
        *kept,
        *[F.coalesce(f"_in_{n}", f"_far_{n}").alias(n) for n in values],
    )


def carry_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    *,
    span: float = DEFAULT_SPAN,
) -> DataFrame:
    """Running sum of each value over its key, the current row included."""
    keys, order = list(keys), list(order)
    raw = {name: f"_raw_{name}" for name in values}
    chunked = _in_chunks(df, order[0], span, {raw[n]: v for n, v in values.items()})
    kept = [c for c in df.columns if c != CHUNK]
    rows = chunk_window(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumns({f"_in_{n}": F.sum(raw[n]).over(rows) for n in values})
    edges = chunked.groupBy(*keys, CHUNK).agg(
        *[F.sum(raw[n]).alias(f"_edge_{n}") for n in values]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(
        *keys, CHUNK, *[F.sum(f"_edge_{n}").over(earlier).alias(f"_far_{n}") for n in values]
    ).filter(" or ".join(f"`_far_{n}` is not null" for n in values))
    return local.join(carried, [*keys, CHUNK], "left").select(
        *kept,
        *[
            (F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_far_{n}", F.lit(0))).alias(n)
            for n in values
        ],
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    *,
    span: float = DEFAULT_SPAN,
    reverse: bool = False,
) -> DataFrame:
    """Columns of the previous (or next) row of the key, whatever its distance.

    ``columns`` maps new names to existing ones. ``_has_previous`` tells a
    missing row from a row that holds nulls.
    """
    packed = carry_last(
        df,
        keys,
        order,
        {"_previous": F.struct(*[F.col(c).alias(n) for n, c in columns.items()])},
        span=span,
        include_current=False,
        reverse=reverse,
    )
    return packed.withColumns(
        {
            "_has_previous": F.col("_previous").isNotNull(),
            **{n: F.col(f"_previous.{n}") for n in columns},
        }
    ).drop("_previous")


def streaks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    *,
    minimum: int,
    consecutive: bool = False,
    run: str | None = None,
    amount: str | None = None,
    span: float = DEFAULT_SPAN,
) -> DataFrame:
    """Length of the run of equal values at every row, and what was confirmed before.

    For every entry ``name: column`` of ``values`` this adds ``name_streak`` (0
    where the value is null) and ``name_before``: the value of the latest
    earlier row whose streak was exactly ``minimum``. With ``amount`` it adds
    ``name_sum``, the sum of that column over the streak. A run also ends
    where ``order[0]`` is not consecutive or where ``run`` changes.

    All of it takes one summary row per chunk: the run a chunk begins with is
    extended by what the chunk before ended with, and whether that run reaches
    the minimum inside the chunk follows from its two lengths.
    """
    keys, order = list(keys), list(order)
    moment = F.struct(*order)
    w = chunk_window(keys, *order)
    rows = df.withColumn(CHUNK, chunk_of(order[0], span))
    guards = [run] if run is not None else []
    links = {}
    if consecutive:
        links["_gap"] = ~F.coalesce(F.lag(order[0]).over(w) == F.col(order[0]) - 1, F.lit(False))
    if run is not None:
        links["_turn"] = ~F.lag(run).over(w).eqNullSafe(F.col(run))
    rows = rows.withColumns({"_nth": F.row_number().over(w), **links})
    torn = F.lit(False)
    for c in links:
        torn = torn | F.col(c)
    rows = rows.withColumns(
        {
            f"_head_{n}": (F.col("_nth") > 1)
            & (torn | ~F.coalesce(F.lag(v).over(w) == F.col(v), F.lit(False)))
            for n, v in values.items()
        }
    )
    rows = rows.withColumns(
        {f"_seg_{n}": F.sum(F.col(f"_head_{n}").cast("int")).over(w) for n in values}
    )
    for n in values:
        seg = Window.partitionBy(*keys, CHUNK, f"_seg_{n}").orderBy(*order)
        own = {f"_len_{n}": F.row_number().over(seg)}
        if amount is not None:
            own[f"_sum_{n}"] = F.sum(amount).over(seg)
        rows = rows.withColumns(own)

    def edge(column: str, last: bool) -> Column:
        return (F.max_by if last else F.min_by)(column, moment)

    facts = [
        edge(order[0], False).alias("_first_at"),
        edge(order[0], True).alias("_last_at"),
        *[edge(g, False).alias("_first_run") for g in guards],
        *[edge(g, True).alias("_last_run") for g in guards],
    ]
    for n, v in values.items():
        opening, length = F.col(f"_seg_{n}") == 0, F.col(f"_len_{n}")
        facts += [
            edge(v, False).alias(f"_first_{n}"),
            edge(v, True).alias(f"_last_{n}"),
            F.count_if(opening).alias(f"_open_{n}"),
            edge(f"_len_{n}", True).alias(f"_tail_{n}"),
            (F.max(f"_seg_{n}") == 0).alias(f"_whole_{n}"),
            F.max_by(
                v, F.when(~opening & (length == minimum) & F.col(v).isNotNull(), moment)
            ).alias(f"_sure_{n}"),
        ]
        if amount is not None:
            facts += [
                F.sum(F.when(opening, F.col(amount))).alias(f"_osum_{n}"),
                edge(f"_sum_{n}", True).alias(f"_tsum_{n}"),
            ]
    edges = rows.groupBy(*keys, CHUNK).agg(*facts)
    by_key = Window.partitionBy(*keys).orderBy(CHUNK)
    joined = F.lit(True)
    if consecutive:
        joined = joined & (F.lag("_last_at").over(by_key) == F.col("_first_at") - 1)
    if run is not None:
        joined = joined & F.lag("_last_run").over(by_key).eqNullSafe(F.col("_first_run"))
    edges = edges.withColumns(
        {
            f"_on_{n}": F.coalesce(
                joined & (F.lag(f"_last_{n}").over(by_key) == F.col(f"_first_{n}")), F.lit(False)
            )
            for n in values
        }
    )
    edges = edges.withColumns(
        {
            f"_group_{n}": F.sum(
                (~(F.col(f"_whole_{n}") & F.col(f"_on_{n}"))).cast("int")
            ).over(by_key)
            for n in values
        }
    )
    for n in values:
        inside = Window.partitionBy(*keys, f"_group_{n}").orderBy(CHUNK)
        reach = {f"_end_{n}": F.sum(f"_tail_{n}").over(inside)}
        if amount is not None:
            reach[f"_esum_{n}"] = F.sum(f"_tsum_{n}").over(inside)
        edges = edges.withColumns(reach)
        entering = F.when(F.col(f"_on_{n}"), F.lag(f"_end_{n}").over(by_key)).otherwise(0)
        edges = edges.withColumn(f"_in_{n}", entering)
        opened = F.when(
            (F.col(f"_in_{n}") < minimum)
            & (F.col(f"_in_{n}") + F.col(f"_open_{n}") >= minimum)
            & F.col(f"_first_{n}").isNotNull(),
            F.col(f"_first_{n}"),
        )
        edges = edges.withColumn(f"_set_{n}", F.coalesce(f"_sure_{n}", opened))
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys,
        CHUNK,
        *[F.col(f"_in_{n}") for n in values],
        *[F.last(f"_set_{n}", ignorenulls=True).over(before).alias(f"_was_{n}") for n in values],
        *(
            [
                F.when(F.col(f"_on_{n}"), F.lag(f"_esum_{n}").over(by_key)).alias(f"_isum_{n}")
                for n in values
            ]
            if amount is not None
            else []
        ),
    ).filter(" or ".join(f"`_in_{n}` > 0 or `_was_{n}` is not null" for n in values))
    out = rows.join(carried, [*keys, CHUNK], "left")
    added: dict[str, Column] = {}
    for n, v in values.items():
        opening = F.col(f"_seg_{n}") == 0
        extra = F.when(opening, F.coalesce(f"_in_{n}", F.lit(0))).otherwise(0)
        known = F.col(v).isNotNull()
        added[f"{n}_streak"] = F.when(known, F.col(f"_len_{n}") + extra).otherwise(0)
        if amount is not None:
            more = F.when(opening, F.coalesce(f"_isum_{n}", F.lit(0.0))).otherwise(0.0)
            added[f"{n}_sum"] = F.when(known, F.col(f"_sum_{n}") + more)
    out = out.withColumns(added)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        *df.columns,
        *added,
        *[
            F.coalesce(
                F.last(F.when(F.col(f"{n}_streak") == minimum, F.col(v)), ignorenulls=True).over(
                    past
                ),
                F.col(f"_was_{n}"),
            ).alias(f"{n}_before")
            for n, v in values.items()
        ],
    )
