"""Benchmark decontamination by winnowing, in native column expressions.

Every window of consecutive k-grams keeps its smallest k-gram hash. A span of
``span`` shared words holds ``span - k + 1`` k-grams, one whole window, so both
sides keep the same hash of it: joining the kept hashes finds every shared span.
Each hit is then extended to the word windows around it, which are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
GRAM = 5


def item_words(text: Column) -> Column:
    return common.words_of(common.lower_ascii(text), SEPARATORS)


def _grams(words: Column, n: Column, k: int) -> Column:
    """The hash of each k-gram by its position; ``words`` must be a plain column."""
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def _kept(df: DataFrame, keep: list[str], words: str, span: int, k: int) -> DataFrame:
    """``keep`` and ``kept``: the distinct minima over windows of span - k + 1 k-gram hashes."""
    window = span - k + 1
    n = F.size(words)
    df = df.select(*keep, F.when(n >= span, _grams(F.col(words), n, k)).alias("m"))
    # Minima over 2, 4, ... neighbours; the last step laps two of them to the window's length.
    length = 1
    while length < window:
        step = min(length, window - length)
        rest = F.size("m") - step
        pair = F.zip_with(F.slice("m", F.lit(1), rest), F.slice("m", F.lit(step + 1), rest), lambda a, b: F.least(a, b))
        df = df.select(*keep, pair.alias("m"))
        length += step
    return df.select(*keep, F.coalesce(F.array_distinct("m"), F.array().cast("array<bigint>")).alias("kept"))


def _windows(bench: DataFrame, span: int) -> DataFrame:
    """(item_id, gram): the word windows of each item, joined by blanks; a shorter item is one window."""
    items = bench.select("item_id", item_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - span, F.lit(0)) + 1)
    return items.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.array_join(F.slice("words", F.col("at"), span), " ").alias("gram")).distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """One row per distinct contaminated text: key (MD5 of the text), n_hit, n_items, items (sorted as strings), see ``keyed``.

    Null and empty texts have no words and never appear; texts of any length are
    read whole. Items without words are left out; a repeated item id counts once;
    all items with a null id count as one and are no part of ``items``. Items
    shorter than ``span`` words are one window of their own length, found by the
    hashes of all runs of that length. Only ``text``, ``item_id`` are read, so
    other columns may have any name. Equal texts are compared once.
    """
    return _contaminated(keyed(docs, span, k), docs, bench, span, k)


def keyed(docs: DataFrame, span: int, k: int) -> DataFrame:
    """Each document's key, n_words and kept hashes, written to the shared folder: texts are cut into words once."""
    df = docs.select("doc_id", _key(F.col("text")).alias("key"), item_words(F.col("text")).alias("words"))
    df = df.select("doc_id", "key", "words", F.size("words").cast("long").alias("n_words"))
    return common.materialize(_kept(df, ["doc_id", "key", "n_words"], "words", span, k), "winnowed")


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _short(bench: DataFrame, span: int) -> list[int]:
    """The lengths below ``span`` that items have: at most span - 1 numbers."""
    n = F.size(item_words(F.col("text")))
    return sorted(r[0] for r in bench.select(n.alias("n")).filter((F.col("n") > 0) & (F.col("n") < span)).distinct().collect())


def _contaminated(prints: DataFrame, docs: DataFrame, bench: DataFrame, span: int, k: int) -> DataFrame:
    short = _short(bench, span)
    windows = common.materialize(_windows(bench, span), "windows")
    items = bench.select(item_words(F.col("text")).alias("words"))
    # As a table: exploding the expression itself has Spark filter on its size first, which computes it anew for each k-gram.
    wanted = common.materialize(_kept(items, [], "words", span, k), "benchmark-kept").select(F.explode("kept").alias("hash"))
    wanted = common.maybe_broadcast(common.materialize(wanted.distinct(), "benchmark-hashes"))
    hits = prints.select("key", F.explode("kept").alias("hash")).join(wanted, "hash", "left_semi").select("key")
    sought = [(k, span, wanted)]
    if short:
        # Runs as long as the short items are looked up as they are made; only the texts with a hit are stored.
        runs = lambda n: _grams(F.col("words"), F.size("words"), n)
        few = None
        for n in short:
            own = items.filter(F.size("words") == n).select(F.explode(runs(n)).alias("hash"))
            few = own if few is None else few.union(own)
        few = common.maybe_broadcast(common.materialize(few.distinct(), "short-hashes"))
        words = docs.select(_key(F.col("text")).alias("key"), item_words(F.col("text")).alias("words"))
        made = words.select("key", F.explode_outer(F.concat(*[runs(n) for n in short])).alias("hash"))
        hits = hits.union(made.join(few, "hash", "left_semi").select("key"))
        sought += [(n, n, few) for n in short]
    hits = hits.distinct()
    hits = common.materialize(hits, "hits")
    texts = docs.select(_key(F.col("text")).alias("key"), "text").join(common.maybe_broadcast(hits), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.min("text").alias("text")).select("key", item_words(F.col("text")).alias("words"))
    texts = common.materialize(texts, "hit-texts")
    # Where the shared hashes stand in the texts that have any, and from there the windows around them.
    sized = texts.select("key", "words", F.size("words").alias("n"))
    found = None
    for run, length, some in sought:
        own = sized.filter(F.col("n") >= length).select("key", "n", F.posexplode(_grams(F.col("words"), F.col("n"), run)).alias("at", "hash")).join(some, "hash", "left_semi")
        around = F.sequence(F.greatest(F.col("at") - (length - run), F.lit(0)), F.least("at", F.col("n") - length))
        own = own.select("key", F.explode(around).alias("at"), F.lit(length).alias("length"))
        found = own if found is None else found.unionByName(own)
    starts = found.groupBy("key").agg(F.collect_set(F.struct("at", "length")).alias("starts"))
    spans = texts.join(starts, "key").select("key", "words", F.explode("starts").alias("s")).select("key", "s", F.array_join(F.slice("words", F.col("s.at") + 1, F.col("s.length")), " ").alias("gram"))
    grams = common.materialize(windows.select("gram").distinct(), "grams")
    spans = common.materialize(spans.join(common.maybe_broadcast(grams), "gram", "left_semi"), "spans")

    cover = F.aggregate(
        F.sort_array(F.collect_list("s")), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["length"]).alias("end"), (a["n"] + F.greatest(s["at"] + s["length"] - F.greatest(a["end"], s["at"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    covered = spans.groupBy("key").agg(cover.alias("n_hit"))
    occurring = spans.select("key", "gram").distinct().join(windows, "gram").select("key", "item_id").distinct()
    occurring = occurring.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    return covered.join(occurring, "key")


def report(docs: DataFrame, bench: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Repeated rows and null ids each get a row; see ``decontaminate``."""
    prints = keyed(docs, span, k)
    found = common.materialize(_contaminated(prints, docs, bench, span, k), "contaminated")
    out = prints.select("doc_id", "key", "n_words").join(common.maybe_broadcast(found), "key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        common.sha256_hex(F.array_join(items, ",")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """The documents that share no window with any item, with all their columns."""
    found = common.materialize(decontaminate(docs, bench, span, k).select("key"), "contaminated")
    return docs.join(common.maybe_broadcast(found), _key(docs["text"]) == found["key"], "left_anti")
