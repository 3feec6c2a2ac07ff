"""Document fingerprints: threshold-scaled sketches of word shingles, in native column expressions.

A sketch keeps every 64-bit shingle hash below a fixed fraction of the hash
range, so the sketch of a union follows from the sketches and the containment of
a short text in a very long one can be estimated. Where no hash is below it, the
smallest one stands for the text, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import common

WORDS = 5
#: One hash of so many is kept.
SCALE = 8
#: Neighbouring documents that share a window bucket; quantiles of the ids that cut the table before that.
BUCKET_DOCS, CELLS = 64, 1024

_LOWEST = -(2**63)


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """Distinct hashes of all ``size``-word shingles; a shorter text is one shingle, no words are none.

    ``words`` must be a plain column: an expression would be evaluated for each shingle.
    """
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.array_distinct(F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>")))


def scaled(hashes: Column, scale: int = SCALE) -> Column:
    """The hashes below the fraction, sorted; where none is, the smallest one alone."""
    limit = _LOWEST + 2**64 // scale
    below = F.sort_array(F.filter(hashes, lambda h: h < F.lit(limit)))
    return F.when((F.size(below) > 0) | (F.size(hashes) == 0), below).otherwise(F.array(F.array_min(hashes)))


def with_sketch(df: DataFrame, text: str, sketch: str, size: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Add ``sketch``: array<long>, see ``scaled``. Null text, no words: empty."""
    kept = [c for c in df.columns if c.lower() != sketch.lower()]
    # The row as one column, so that its columns may have any name.
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), common.words_of(F.lower(F.col(f"`{text}`"))).alias("words"))
    out = out.select("row", shingle_hashes(F.col("words"), size).alias("hashes")).select("row", scaled(F.col("hashes"), scale).alias("sketch"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("sketch").alias(sketch))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1. Two sketches of no shingles: 1.

    Two sketches without a hash below the fraction are compared by their smallest
    hashes, which agree with a probability equal to the similarity.
    """
    shared = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(1.0))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 for an empty ``a``, null where ``a`` has no hash below the fraction."""
    limit = _LOWEST + 2**64 // scale
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.array_min(a) < limit, F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two texts' shingles, exactly the one that a text with all of them would have."""
    return scaled(F.array_union(a, b), scale)


def as_string(sketch: Column, scale: int = SCALE) -> Column:
    """A printable form: the fraction, then the hashes in hexadecimal."""
    return F.concat(F.lit(f"1/{scale}:"), F.array_join(F.transform(sketch, lambda h: F.hex(h)), ","))


def _cells(docs: DataFrame, ids: str, h: str) -> Column:
    """An order-keeping bucket of (id, h): about BUCKET_DOCS rows, however unevenly the ids lie.

    Quantiles cut the ids into cells of about 1 / CELLS of the rows, and each cell
    is cut evenly. One id in more than two quantiles' rows (or null ids as many)
    is dealt further by the first 10 of the 63 bits of h.
    """
    cuts, count, named = docs.agg(F.percentile_approx(ids, [k / CELLS for k in range(CELLS + 1)], 20 * CELLS), F.count(F.lit(1)), F.count(ids)).first()
    cuts = cuts or [0, 0]
    hot = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    cuts = sorted(set(cuts))
    per = max(1, count // (BUCKET_DOCS * max(1, len(cuts) - 1)))
    # The last cut that isn't above the id, by halving steps.
    steps = F.array(*[F.lit(2**k) for k in reversed(range(max(1, (len(cuts) - 1).bit_length())))])
    longs = lambda values: F.expr(f"array({', '.join(f"bigint('{x}')" for x in values)})")
    low, top = longs(cuts), len(cuts) - 1
    cell = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= top) & (F.coalesce(F.get(low, at + step), F.lit(2**63 - 1)) <= F.col(ids)), at + step).otherwise(at))
    # Even parts of a cell; one that spans more than half the range of a long counts as that half.
    width = longs(max(1, -(-(min(b - a, 2**62) + 1) // per)) for a, b in zip(cuts, [*cuts[1:], cuts[-1]], strict=True))
    inside = F.least(F.floor((F.col(ids).cast("decimal(20,0)") - F.get(low, cell)) / F.get(width, cell)), F.lit(2**38)).cast("long")
    none, first = F.lit(0).cast("long"), F.shiftright(h, 53)
    among = F.when(F.col(ids).isin(hot), first).otherwise(none) if hot else none
    return F.when(F.col(ids).isNull(), (first if count - named > count // CELLS else none) - 1024).otherwise(F.shiftleft(cell.cast("long"), 50) + F.shiftleft(inside, 10) + among)


def _next_of(keys: DataFrame, key: str) -> DataFrame:
    """(key, next): each distinct bucket with the next larger one, the largest with the smallest.

    Windows run over the buckets of a cell; only one row for each cell meets in one task.
    """
    keys = keys.select(F.col(key).alias("key")).distinct().withColumn("group", F.shiftright("key", 50))
    within = keys.withColumn("next", F.lead("key").over(Window.partitionBy("group").orderBy("key")))
    heads = keys.groupBy("group").agg(F.min("key").alias("head"))
    order = Window.orderBy("group")
    heads = heads.select("group", F.coalesce(F.lead("head").over(order), F.min("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return within.join(heads, "group").select("key", F.coalesce("next", "after").alias("next"))


def fingerprint_edits(docs: DataFrame, size: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprint every text, and the text whose second half the next document's beginning replaces.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A null text is empty; repeated ids follow one
    another in the order of their texts' hashes; null ids come first; a table of
    one document is its own next; an empty table gives no rows. Columns besides
    doc_id and text are not read. The texts cross one shuffle, keyed by ranges of
    neighbouring ids; only the first document of each range is sent once more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.shiftright(F.xxhash64("text"), 1) + F.lit(2**62))
    # Known not to be null: else the join below makes Spark filter one copy of the table for that, and shuffle the texts twice.
    bucket = F.coalesce(_cells(docs, "doc_id", "h"), F.lit(0).cast("long"))
    base = with_sketch(docs, "text", "sketch", size, scale)
    base = base.withColumn("bucket", bucket)
    order = Window.partitionBy("bucket").orderBy("doc_id", "h", "text")
    # Both uses below need the same columns of ``base``, so Spark computes and shuffles it once.
    inner = base.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order), "before": F.lag("bucket").over(order)})
    heads = inner.filter(F.col("before").isNull()).select(F.col("bucket").alias("next"), F.col("text").alias("head_text"), F.col("sketch").alias("head_sketch"))
    after = _next_of(docs.select(bucket.alias("bucket")), "bucket").withColumnRenamed("key", "bucket")
    heads = heads.join(after, "next").select("bucket", "head_text", "head_sketch")
    pairs = inner.join(heads, "bucket", "left").select("doc_id", "text", "sketch", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_sketch", "head_sketch").alias("next_sketch"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    pairs = with_sketch(pairs, "edited", "edited_sketch", size, scale)
    own, new = F.col("sketch"), F.col("edited_sketch")
    return pairs.select(
        "doc_id", "n_chars", common.sha256_hex(F.col("edited")).alias("edited_sha256"),
        as_string(own, scale).alias("fingerprint"), as_string(new, scale).alias("edited_fingerprint"),
        likeness(own, new, scale).alias("near_edited"), likeness(own, F.col("next_sketch"), scale).alias("near_next"),
    )
