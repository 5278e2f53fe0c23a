"""One-to-one matching of frames within a tolerance, nearest pairs first."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.session import cut, tasks

#: frames of a chunk that one task settles, in the first round
SPAN = 4096
#: open rows that are handed to Python at a time, whole chunks of any keys
PACK = 4096


def settle(
    truth: Iterable[tuple], predicted: Iterable[tuple], low: int, high: int, tolerance: int
) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Pairs and open rows of the frames from ``low`` to ``high``, whatever lies outside.

    Rows are (frame, id). Distances are settled in rising order; at one distance truths choose in the
    order of their ids, each the smallest free prediction. A row that a partner outside may take at
    some distance is open from that distance on, and so is every row that then depends on it. A pair
    of rows that were not open is therefore part of the whole matching. Frames hold lists of ids, so
    no list of candidate pairs is made.
    """
    free_t, free_p, open_t, open_p = (defaultdict(list) for _ in range(4))
    for side, rows in ((free_t, truth), (free_p, predicted)):
        for frame, own in rows:
            side[frame].append(own)
        for ids in side.values():
            ids.sort(reverse=True)  # the smallest is taken from the end
    pairs = []

    def reopen(free, opened, frame):
        if free.get(frame):
            opened[frame] += free.pop(frame)

    for distance in range(tolerance + 1):
        if distance:
            for frame in (low + distance - 1, high - distance + 1):
                reopen(free_t, open_t, frame)
                reopen(free_p, open_p, frame)
        turn = [(own, frame, False) for frame, ids in free_t.items() for own in ids]
        turn += [(own, frame, True) for frame, ids in open_t.items() for own in ids]
        turn = [x for x in turn if any(s.get(f) for s in (free_p, open_p) for f in {x[1] - distance, x[1] + distance})]
        turn.sort(key=lambda x: x[0])
        lowest = {f: min(ids) for f, ids in open_p.items() if ids}
        taken = set()
        newly = []
        for own, frame, opened in turn:
            at = sorted({frame - distance, frame + distance})
            best = min(((free_p[f][-1], f) for f in at if free_p.get(f)), default=None)
            unsure = min((lowest[f] for f in at if f in lowest), default=None)
            if not opened and best and (unsure is None or best[0] < unsure):
                free_p[best[1]].pop()
                taken.add((frame, own))
                pairs.append((own, best[0], frame, best[1], distance))
                continue
            if not opened and best is None and unsure is None:
                continue
            # whether this row is taken is open, so is every prediction it could take
            if not opened:
                newly.append((frame, own))
            for f in at:
                if free_p.get(f):
                    lowest[f] = min([free_p[f][-1], *([lowest[f]] if f in lowest else [])])
                    reopen(free_p, open_p, f)
        gone = taken | set(newly)
        for frame in {f for f, _ in gone}:
            free_t[frame] = [own for own in free_t[frame] if (frame, own) not in gone]
        for frame, own in newly:
            open_t[frame].append(own)
    rest = [[(frame, own) for frame, ids in side.items() for own in ids] for side in (open_t, open_p)]
    return pairs, *rest


def match_within(
    truth: DataFrame,
    predicted: DataFrame,
    *,
    tolerance: int = 30,
    keys: Sequence[str] = ("source_id",),
    truth_frame: str = "truth_frame",
    predicted_frame: str = "predicted_frame",
    truth_id: str = "truth_id",
    predicted_id: str = "predicted_id",
    span: int = SPAN,
) -> DataFrame:
    """One-to-one matches of frames within a tolerance, nearest pairs first.

    Ties go to the smaller truth id, then the smaller prediction id; ids are single values, unique
    within their key. Rows of equal frames are paired by their number first. What is left is settled in
    chunks of ``span`` frames of a key with some frames around them; pairs that hold whatever lies
    outside are final, and only rows that depend on more are taken to the next round, in chunks four times as
    wide and cut elsewhere. One round is usual. A row stays open only along an unbroken row of
    neighbours within the tolerance, each waiting for the one before it. Rounds run as jobs while this
    function runs.
    """
    keys = list(keys)
    kinds = truth.schema[truth_id].dataType, predicted.schema[predicted_id].dataType
    if any(isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) for kind in kinds):
        raise TypeError("ids to match must be single values")
    frame_kinds = truth.schema[truth_frame].dataType, predicted.schema[predicted_frame].dataType
    no_t, no_p = F.lit(None).cast(kinds[0]).alias("_t"), F.lit(None).cast(kinds[1]).alias("_p")
    rows = (
        truth.select(*keys, F.col(truth_frame).cast("bigint").alias("_at"), F.col(truth_id).alias("_t"), no_p)
        .filter("_t is not null")
        .unionByName(
            predicted.select(*keys, F.col(predicted_frame).cast("bigint").alias("_at"), no_t, F.col(predicted_id).alias("_p"))
            .filter("_p is not null")
        )
        .filter("_at is not null")
    )
    # truths come first in a frame; the n-th truth is paired with the n-th prediction
    frame = Window.partitionBy(*keys, "_at")
    is_truth = F.col("_t").isNotNull()
    number = F.row_number().over(frame.orderBy(~is_truth, "_t", "_p"))
    own = number - F.when(is_truth, 0).otherwise(F.count_if(is_truth).over(frame))
    placed = rows.select("*", own.alias("_n")).groupBy(*keys, "_at", "_n").agg(F.max("_t").alias("_t"), F.max("_p").alias("_p"))
    placed = cut(placed.drop("_n"))
    both = F.col("_t").isNotNull() & F.col("_p").isNotNull()
    at = F.col("_at")
    pairs = [placed.filter(both).select(*keys, "_t", "_p", at.alias("_ta"), at.alias("_pa"), F.lit(0).cast("bigint").alias("_d"))]
    rest = placed.filter(~both)

    fields = [placed.schema[k] for k in keys]
    longs = [T.StructField(c, T.LongType()) for c in ("_ta", "_pa", "_d")]
    schema = T.StructType([*fields, T.StructField("_t", kinds[0]), T.StructField("_p", kinds[1]), *longs])
    round_no = 0
    while count := rest.count():
        shift = (span // 2) * (round_no % 2)
        settled = _settled(rest, -(-count // PACK), keys, schema, tolerance, span, shift)
        settled = cut(settled.distinct())
        found = settled.filter(both)
        pairs.append(found)
        # of open rows, those that another chunk could pair are gone
        waiting = settled.filter(~both).select(*keys, F.coalesce("_ta", "_pa").alias("_at"), "_t", "_p")
        for side in ("_t", "_p"):
            held = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(side).alias("_held"))
            same = F.col(side) == F.col("_held")
            for i, k in enumerate(keys):
                same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
            waiting = waiting.join(held, same, "left_anti")
        rest = cut(waiting)
        span, round_no = span * 4, round_no + 1
    matched = pairs[0]
    for more in pairs[1:]:
        matched = matched.unionByName(more)
    return matched.select(
        *keys,
        F.col("_t").alias(truth_id),
        F.col("_p").alias(predicted_id),
        F.col("_ta").cast(frame_kinds[0]).alias(truth_frame),
        F.col("_pa").cast(frame_kinds[1]).alias(predicted_frame),
        F.col("_d").alias("distance"),
    )


def _settled(rest: DataFrame, packs: int, keys: list[str], schema: T.StructType, tolerance: int, span: int, shift: int) -> DataFrame:
    """Final pairs, and open rows (a pair without its other half), of all chunks.

    Most keys have few rows, and handing over a chunk costs more than settling it, so chunks go in packs.
    """
    edge = 8 * (tolerance + 1)
    moved = F.col("_at") + shift
    around = F.sequence(F.floor((moved - edge) / span), F.floor((moved + edge) / span))
    chunks = rest.withColumn("_chunk", F.explode(around))

    def settle_pack(part: pa.Table) -> pa.Table:
        found, rows = {}, []
        for *key, chunk, a, t, p in zip(*(part.column(c).to_pylist() for c in (*keys, "_chunk", "_at", "_t", "_p"))):
            _, _, truth, predicted = found.setdefault((*map(_same, key), chunk), (key, chunk, [], []))
            if t is not None:
                truth.append((a, t))
            if p is not None:
                predicted.append((a, p))
        for key, chunk, truth, predicted in found.values():
            if not truth or not predicted:
                continue  # nor can a pair outside reach a row of the chunk over the rows around it
            low = chunk * span - shift
            high = low + span - 1
            pairs, open_t, open_p = settle(truth, predicted, low - edge, high + edge, tolerance)
            rows += [(*key, *p) for p in pairs if low <= p[2] <= high or low <= p[3] <= high]
            rows += [(*key, t, None, a, None, None) for a, t in open_t if low <= a <= high]
            rows += [(*key, None, p, None, a, None) for a, p in open_p if low <= a <= high]
        types = [part.schema.field(c).type for c in (*keys, "_t", "_p")] + [pa.int64()] * 3
        columns = list(map(list, zip(*rows))) or [[]] * len(types)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    packed = chunks.withColumn("_pack", F.pmod(F.xxhash64(*keys, "_chunk"), F.lit(packs)))
    dealt = packed.repartition(min(packs, tasks(rest.sparkSession)), "_pack")
    return dealt.groupBy("_pack").applyInArrow(settle_pack, schema)


def _same(value):
    """A value of a key as Spark groups it: NaN is one value, structs and arrays go by what they hold."""
    if isinstance(value, (dict, list)):
        return repr(value)
    return "NaN" if value != value else value
