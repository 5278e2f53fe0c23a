"""Benchmark decontamination by shared word windows, with DataFrame functions only.

Every benchmark item gives its windows of ``span`` consecutive words; an item of fewer words is one
window. Training texts are hashed position by position, looked up in the set of window hashes, and
hits are verified word for word before they count.

Edge cases: a null text has no words; an item without words has no window; repeated rows and
repeated items give the same result each time they occur; an empty table on either side is fine;
only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything but digits, ASCII letters and characters beyond ASCII parts words.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: So many window hashes travel in the plan as a set; more are joined as a table.
SET_LIMIT = 50_000


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, PARTING), lambda w: w != "")


def _pairs(left: Column, right: Column, offset: int) -> Column:
    """Hash of left[i] with right[i + offset], as long as right lasts."""
    n = F.greatest(F.size(right) - offset, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + offset), n), lambda a, b: F.xxhash64(a, b))


def window_hashes(df: DataFrame, column: str, spans: list[int]) -> DataFrame:
    """Column h{n} for each n: hashes of all windows of n words of the array ``column``.

    Hashes of 2, 4 and 8 words are built by doubling; any other length joins those, so a window
    of 13 words costs five pair hashes and no string is built.
    """
    df = df.withColumn("h1", F.transform(column, lambda w: F.xxhash64(w)))
    largest = 1
    while largest * 2 <= max(spans, default=1):
        df = df.withColumn(f"h{largest * 2}", _pairs(F.col(f"h{largest}"), F.col(f"h{largest}"), largest))
        largest *= 2
    for n in spans:
        at = largest
        while at > n:
            at //= 2
        total, name = at, f"h{at}"
        while total < n:
            at //= 2
            if total + at <= n:
                total += at
                df = df.withColumn(f"h{total}", _pairs(F.col(name), F.col(f"h{at}"), total - at))
                name = f"h{total}"
    return df


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, span: int) -> DataFrame:
    """(span_words, hash, gram, items): one row per distinct window with the items that hold it."""
    items = benchmark.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("span_words", F.least(F.size("w"), F.lit(span)))
    grams = items.select(
        "item",
        "span_words",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - F.col("span_words") + 1),
                lambda i: F.slice("w", i, F.col("span_words")),
            )
        ).alias("gram"),
    )
    return grams.groupBy("span_words", "gram").agg(F.collect_set(F.col("item").cast("string")).alias("items"))


def hits(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = 13,
    set_limit: int = SET_LIMIT,
) -> DataFrame:
    """Per row of ``documents``: doc_id, hash of the text, n_words, n_hit, n_items, items and hit ranges in words."""
    grams = benchmark_windows(benchmark, item_id, item_text, span)
    # At most `span` lengths, whatever the size of the benchmark.
    spans = sorted(r[0] for r in grams.select("span_words").distinct().collect())
    hashed = window_hashes(grams, "gram", spans or [span])
    key = F.lit(None).cast("bigint")
    for n in spans:
        key = F.when(F.col("span_words") == n, F.col(f"h{n}")[0]).otherwise(key)
    grams = hashed.select("span_words", "gram", "items", key.alias("hash"))

    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("body"))
    rows = rows.withColumn("mark", F.xxhash64("body")).withColumn("w", words(F.col("body")))
    n_words = F.size("w").alias("n_words")
    hashed = window_hashes(rows, "w", spans or [span])

    found = grams.select("span_words", "hash").limit(set_limit + 1).collect()
    if len(found) <= set_limit:
        # The set is part of the expression: lookups cost a probe, and no window leaves its row.
        per_span = []
        for n in spans:
            known = [r["hash"] for r in found if r["span_words"] == n]
            per_span.append(_known_positions(f"h{n}", n, known))
        at = F.concat(*per_span) if per_span else F.array().cast("array<struct<at:int,n:int,gram:array<string>>>")
        spots = hashed.select("doc", "mark", n_words, at.alias("spots"))
        spots = spots.select("doc", "mark", "n_words", F.posexplode_outer("spots").alias("k", "spot"))
        spots = spots.select("doc", "mark", "n_words", "k", "spot.at", "spot.n", "spot.gram")
        # At most set_limit windows of at most `span` words: their number was checked above.
        known = F.broadcast(grams.select(F.col("span_words").alias("n"), "gram", "items"))
        matched = spots.join(known, ["n", "gram"], "left")
    else:
        # A benchmark beyond the limit: all windows are dealt out by hash and joined.
        every = F.concat(*[_all_positions(f"h{n}", n) for n in spans])
        spots = hashed.select("doc", "mark", n_words, F.posexplode_outer(every).alias("k", "spot"))
        spread = F.coalesce("spot.hash", F.xxhash64("doc", "mark")).alias("hash")  # rows without a window match nothing, wherever they go
        spots = spots.select("doc", "mark", "n_words", "k", "spot.at", "spot.n", "spot.gram", spread)
        known = grams.select(F.col("span_words").alias("n"), "hash", "gram", "items")
        matched = spots.join(known, ["n", "hash", "gram"], "left")

    # Rows that repeat fall into one group, which says how often they occurred.
    spot = F.when(F.col("items").isNotNull(), F.struct("at", "n"))
    grouped = matched.groupBy("doc", "mark", "n_words").agg(
        F.collect_set(spot).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"),
    )
    covered = F.aggregate(
        F.array_sort("ranges"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, r: F.struct(
            F.greatest(a["end"], r["at"] + r["n"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), r["at"] + r["n"] - F.greatest(a["end"], r["at"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return grouped.select(
        F.col("doc").alias(doc_id),
        F.col("mark").alias("text_hash"),
        F.col("n_words").cast("bigint").alias("n_words"),
        covered.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        F.array_sort("ranges").alias("ranges"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _spot(at: Column, n: int, h: Column | None = None) -> Column:
    parts = [at.cast("int").alias("at"), F.lit(n).alias("n"), F.slice("w", at + 1, F.lit(n)).alias("gram")]
    return F.struct(*parts, *([] if h is None else [h.alias("hash")]))


def _known_positions(column: str, n: int, known: list[int]) -> Column:
    at = F.array_compact(F.transform(column, lambda h, i: F.when(h.isin(known), i)))
    return F.transform(at, lambda i: _spot(i, n))


def _all_positions(column: str, n: int) -> Column:
    return F.transform(column, lambda h, i: _spot(i, n, h))


def report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``hits`` with the digest of the item ids and the verdict: at least a twentieth of the words is hit."""
    found = hits(documents, benchmark, **options)
    doc_id = found.columns[0]
    return found.select(
        doc_id,
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``documents`` whose id and text are not contaminated; columns stay as they are.

    Only the contaminated rows are gathered; a row leaves when its id and the hash of its text do.
    """
    found = hits(documents, benchmark, doc_id=doc_id, text=text, **options)
    gone = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    gone = gone.select(F.col(doc_id).alias("__gone"), F.col("text_hash").alias("__mark")).distinct()
    rows = documents.withColumn("__row", F.xxhash64(F.col(text).cast("string")))
    return rows.join(gone, rows["__row"].eqNullSafe(gone["__mark"]) & rows[doc_id].eqNullSafe(gone["__gone"]), "left_anti").drop("__row")


def without_spans(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, text): the words of each text that no benchmark window covers, lower-cased, by spaces."""
    found = hits(documents, benchmark, doc_id=doc_id, text=text, **options).where("n_hit > 0")
    found = found.select(F.col(doc_id).alias("__id"), F.col("text_hash").alias("__mark"), "ranges").dropDuplicates(["__id", "__mark"])
    rows = documents.select(doc_id, F.col(text).alias("__text")).withColumn("__row", F.xxhash64(F.col("__text").cast("string")))
    rows = rows.join(found, rows["__row"].eqNullSafe(found["__mark"]) & rows[doc_id].eqNullSafe(found["__id"]), "left")
    rows = rows.withColumn("w", words(F.col("__text")))
    kept = F.filter(
        F.transform("w", lambda x, i: F.when(~F.exists("ranges", lambda r: (r["at"] <= i) & (i < r["at"] + r["n"])), x)),
        lambda x: x.isNotNull(),
    )
    return rows.select(doc_id, F.when(F.col("ranges").isNull(), F.col("__text")).otherwise(F.array_join(kept, " ")).alias(text))
