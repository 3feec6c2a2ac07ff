"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence matrix.

1. Documents with equal shingle sets form a class; classes are joined, copies are not.
2. Blocking. Two linked sets of sizes in neighbouring size bands differ in at
   most D elements. Hash values are cut into m > D parts; of c non-empty parts of
   a set, c - D at least are equal in any linked one. Their hashes are keys. Sets
   with too many empty parts (c <= D) add single elements as keys, see ``_keys``. A
   class that meets others in fewer keys than c - D has no link, and a pair that
   shares fewer isn't one. No linked pair is lost.
3. Within a key the classes meet a leader; rows of the incidence matrix are
   multiplied block by block, overlap counts accumulate over column blocks, and
   pairs under the bound that their sizes imply are discarded. Only then do
   classes of one key that are still in different components meet one another.
   In keys of very many classes, those outside the cluster's largest component
   meet the others in products of block pairs, which return a few links for each
   pair of blocks and never a list of pairs.
4. Components of links, spread back over the copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import bytewords, common, components

WORDS = 4
#: A link: SHARE * union <= 100 * intersection.
SHARE = 85
#: Keys of more classes are joined by products of block pairs.
HOT = 64
#: One more part than needed for so many that may differ: links then share several keys, chance meetings don't.
SLACK = 6
#: Passes over the keys that drop classes which meet others in too few keys for a link.
PEELS = 2
#: Rows of a block, and matrix entries that it may hold.
BLOCK_ROWS = 256
BLOCK_ENTRIES = 400_000
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text; a shorter text is one shingle, no words are none."""
    for at, block in bytewords.blocks(texts, lower=True):
        runs = block.runs(words)
        for i in range(len(block.first) - 1):
            a, b = block.first[i], block.first[i + 1]
            if b - a >= words:
                yield at + i, np.unique(runs[a : b - words + 1])
            else:
                yield at + i, np.array([block.whole(i)] if b > a else [], np.uint64)


def _digest(own: np.ndarray, clash: frozenset[int] = frozenset()) -> tuple[int, int]:
    """(class, check) of a set: two independent sums of its hashes; ``clash`` holds classes that several sets share, which get another name."""
    one = bytewords.mix(own).sum(dtype=np.uint64) + np.uint64(len(own))
    two = bytewords.mix(own ^ bytewords._PLACE[2]).sum(dtype=np.uint64)
    name = int(one.astype(np.int64))
    if name in clash:
        name = int(bytewords.mix(np.array([one]) * bytewords._PLACE[3] + two)[0].astype(np.int64))
    return name, int(two.astype(np.int64))


def _band(n: int, share: int) -> int:
    return int(math.log(n) / math.log(100 / share) + 1e-9)


def _keys(own: np.ndarray, share: int) -> tuple[np.ndarray, list[int]]:
    """The blocking keys of a set for its size band and the next one, and how many of each a linked set shares at least.

    A key's lowest bit is the parity of its band, which tells the two bands apart.
    """
    n, out, least = len(own), [], []
    low = _band(n, share)
    for band in (low, low + 1):
        top = math.ceil((100 / share) ** (band + 1))
        most = int((100 - share) * 2 * top / (100 + share))  # elements in which a linked pair of this band may differ
        least.append(1)
        if most == 0:  # linked sets of this size are equal, and so one class
            continue
        parts = most + 1 + max(1, most // SLACK)
        salt = bytewords.mix(np.array([band], np.uint64))[0]
        part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
        sums = np.add.reduceat(bytewords.mix(own ^ salt), cuts)
        keys = [bytewords.mix(sums + part[cuts] * bytewords._PLACE[0] + salt)]
        if len(cuts) <= most:  # too many empty parts: single elements as keys, the prefix of a set in hash order
            keys.append(bytewords.mix((own[: most + 1] ^ salt) * bytewords._PLACE[1] + salt))
        else:
            least[-1] = len(cuts) - most
        out += [(k & ~np.uint64(1)) | np.uint64(band & 1) for k in keys]
    if low & 1:
        least.reverse()
    return np.concatenate(out) if out else np.zeros(0, np.uint64), least


def _classes(docs: DataFrame, words: int, share: int, clash: frozenset[int] = frozenset()) -> DataFrame:
    """(doc_id, digest, n_shingles, class, check, even, odd): class is a hash of the shingle set, null for an empty one.

    digest: a hash of the text; check: another one of the set. even, odd: how many
    keys of an even or odd band a linked set shares at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, least = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64), np.ones((batch.num_rows, 2), np.int32)
            for i, own in shingle_sets(batch.column(1), words):
                if len(own):
                    n[i], names[i], least[i] = len(own), _digest(own, clash), _keys(own, share)[1]
            columns = [pa.array(n), pa.array(names[:, 0], mask=n == 0), pa.array(names[:, 1], mask=n == 0), pa.array(least[:, 0]), pa.array(least[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "digest", "n_shingles", "class", "check", "even", "odd"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, digest long, n_shingles long, class long, check long, even int, odd int")
    return common.materialize(rows, "classes")


def _groups(classes: DataFrame) -> DataFrame:
    """One row per class: its smallest id, how many keys a link needs, and the range of its checks."""
    least = [F.min("doc_id").alias("id"), F.min("even").alias("even"), F.min("odd").alias("odd"), F.min("check").alias("low"), F.max("check").alias("high")]
    return common.materialize(classes.filter("class IS NOT NULL").groupBy("class").agg(*least), "groups")


def _key_rows(docs: DataFrame, words: int, share: int, clash: frozenset[int]) -> DataFrame:
    """(key, class): the keys of each class, once for each task that meets it, so copies add little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            every = np.concatenate(keys).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.repeat(np.array(owners, np.int64), [len(k) for k in keys]))], ["key", "class"])

        met: set[int] = set()
        for batch in batches:
            keys, owners, held = [], [], 0
            for _, own in shingle_sets(batch.column(0), words):
                if len(own) and (name := _digest(own, clash)[0]) not in met:
                    met.add(name)
                    keys.append(_keys(own, share)[0])
                    owners.append(name)
                    held += len(keys[-1])
                if held > 500_000:
                    yield flush()
                    keys, owners, held = [], [], 0
            if keys:
                yield flush()

    return docs.select("text").mapInArrow(run, "key long, class long")


def _met(docs: DataFrame, needs: DataFrame, words: int, share: int, clash: frozenset[int]) -> DataFrame:
    """(key, class, leader, size, least): keys of several classes, for classes that may have a link.

    A class that meets others in fewer keys than any link needs has none: it
    goes, and so do keys that are left to one class, in PEELS passes.
    """
    # Most keys are of one class. A window tells them apart in one shuffle of 16 bytes for each key of a class; summing
    # them up first, and joining the shared ones back, was measured to take four times the disk. Each pass is two more
    # windows over what is left: no table between them, and no join whose tables cross the shuffle once they are large.
    met = _crowded(_key_rows(docs, words, share, clash)).select("key", "class").distinct()
    met = met.join(needs.select("class", "even", "odd"), "class").withColumn("odd_band", F.pmod("key", F.lit(2)) == 1)
    met = met.select("key", "class", "odd_band", F.when(F.col("odd_band"), F.col("odd")).otherwise(F.col("even")).alias("least"))
    for _ in range(PEELS):
        held = F.count(F.lit(1)).over(Window.partitionBy("class", "odd_band"))
        met = _crowded(met.withColumn("held", held).filter(F.col("held") >= F.col("least")).select("key", "class", "odd_band", "least"))
    return met.select("key", "class", "least", F.col("low").alias("leader"), "size")


def _crowded(rows: DataFrame) -> DataFrame:
    """The rows of keys that hold several classes, with low, high (the smallest and largest class) and size (rows of the key)."""
    window = Window.partitionBy("key")
    return rows.withColumns({"low": F.min("class").over(window), "high": F.max("class").over(window), "size": F.count(F.lit(1)).over(window)}).filter("low < high")


def _several(rows: DataFrame, of: str = "class") -> DataFrame:
    """The rows of keys that hold several values of ``of``, from a stored table.

    Keys are summed up within tasks first, and the few that stay are joined back; so
    no task gathers the rows of a key that very many texts have.
    """
    keys = rows.groupBy("key").agg(F.min(of).alias("low"), F.max(of).alias("high")).filter("low < high").select("key")
    return rows.join(common.maybe_broadcast(common.materialize(keys, "shared-keys")), "key", "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, clash: frozenset[int]) -> DataFrame:
    """(class, n, hashes) of the wanted classes, from texts that hold them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own.astype(np.int64) for _, own in shingle_sets(batch.column(0), words)]
            ids = pa.array([_digest(x.astype(np.uint64), clash)[0] for x in found], pa.int64())
            hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in found], pa.int64()), hashes], ["class", "n", "hashes"])

    found = docs.select("text").mapInArrow(run, "class long, n long, hashes array<long>")
    return found.join(wanted, "class", "left_semi").dropDuplicates(["class"])


def overlaps(rows: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Shared n-grams of each row with each other row: the sparse incidence product, over blocks of columns.

    Columns that only one row has add nothing and are left out first.
    """
    both = rows if others is None else [*rows, *others]
    counts = np.zeros((len(rows), len(both) - (0 if others is None else len(rows))), np.float32)
    lengths = np.array([len(x) for x in both])
    at = np.repeat(np.arange(len(both)), lengths)
    grams, column, held = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    keep = held > 1
    place = np.cumsum(keep) - 1
    mask = keep[column]
    at, column = at[mask], place[column[mask]]
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    for low in range(0, int(keep.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        x = np.zeros((len(both), COLUMNS), np.float32)
        x[at[a:b], column[a:b] - low] = 1
        counts += x @ x.T if others is None else x[: len(rows)] @ x[len(rows) :].T
    return counts


def _linked(counts: np.ndarray, n: np.ndarray, m: np.ndarray, share: int) -> np.ndarray:
    union = n[:, None] + m[None, :] - counts
    return 100 * counts.astype(np.float64) >= share * union.astype(np.float64)


def _near_size(a: str, b: str, share: int) -> F.Column:
    """Sizes that allow a link: the smaller set is SHARE % of the larger at least."""
    return (F.col(a) * 100 >= F.col(b) * share) & (F.col(b) * 100 >= F.col(a) * share)


def _verify(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The linked ones of distinct pairs (a, b): a's row times the rows of its partners, a block at a time."""
    sizes = sets.select("class", "n")
    pairs = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").filter(_near_size("n_a", "n_b", share))
    pairs = common.materialize(pairs, "near-sizes")
    # Only rows with more partners than a block holds are dealt; there are few of them, and one may have very many partners.
    load = pairs.groupBy("a").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n_b") / BLOCK_ENTRIES)).alias("blocks")).filter("blocks > 1")
    load = common.maybe_broadcast(common.materialize(load, "loads"))
    pairs = pairs.join(load, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).alias("block"))
    pairs = common.materialize(pairs, "pairs")
    members = pairs.join(sets.withColumnRenamed("class", "b"), "b").select("a", "block", "b", "n", "hashes")
    heads = pairs.select("a", "block").distinct().join(sets.withColumnRenamed("class", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "n", "hashes")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        head, rest = frame[frame.b.isna()].iloc[0], frame[frame.b.notna()]
        counts = overlaps([head.hashes], list(rest.hashes))
        yes = _linked(counts, np.array([head.n]), rest.n.to_numpy(), share)[0]
        return pd.DataFrame({"a": np.full(yes.sum(), key[0], np.int64), "b": rest.b[yes].astype("int64")})

    # Ids stay exact: as strings through pandas, whose nullable columns would turn them into floats.
    text = members.unionByName(heads).withColumn("b", F.col("b").cast("string"))
    return text.groupBy("a", "block").applyInPandas(run, "a long, b long")


def _hot_links(hot: DataFrame, known: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links within clusters of hot keys, enough to connect what is connected.

    hot: (key, class, leader); known: (class, component) by the links found so
    far. Classes that meet through hot keys form a cluster. Its largest component
    and the rest are dealt into blocks; a task multiplies a block of the rest
    with another one of either kind and returns a spanning forest of the links
    between their rows. The largest component is never multiplied with itself.
    """
    edges = hot.filter(F.col("class") != F.col("leader")).select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()
    cluster = components.connected(edges).toDF("class", "cluster")
    rows = cluster.join(known, "class", "left").withColumn("component", F.coalesce("component", "class")).join(sets.select("class", "n"), "class")
    rows = common.materialize(rows, "clustered")
    held = rows.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("held"))
    most = held.groupBy("cluster").agg(F.max(F.struct("held", "component"))["component"].alias("most"))
    rows = rows.join(common.materialize(most, "most"), "cluster").withColumn("rest", F.col("component") != F.col("most"))
    blocks = lambda own: F.coalesce(F.ceil(F.greatest(F.count(F.when(own, 1)) / BLOCK_ROWS, F.sum(F.when(own, F.col("n"))) / BLOCK_ENTRIES)), F.lit(0)).cast("int")
    size = rows.groupBy("cluster").agg(blocks(F.col("rest")).alias("few"), blocks(~F.col("rest")).alias("many")).filter("few > 0")
    rows = rows.join(common.materialize(size, "cluster-sizes"), "cluster")
    dealt = lambda n: F.pmod(F.xxhash64("class"), F.greatest(n, F.lit(1))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("rest"), dealt(F.col("few"))).otherwise(F.col("few") + dealt(F.col("many"))))
    others = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    rows = rows.select("class", "cluster", "block", F.explode(others).alias("other"))
    rows = rows.select("class", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).join(sets, "class")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left = frame[frame.block == key[1]] if key[1] != key[2] else frame
        right = frame[frame.block == key[2]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        counts = overlaps(list(left.hashes), None if key[1] == key[2] else list(right.hashes))
        ids, jds = left["class"].to_numpy(), right["class"].to_numpy()
        yes = _linked(counts, left.n.to_numpy(), right.n.to_numpy(), share)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(yes), strict=True):
            a, b = find(int(ids[i])), find(int(jds[j]))
            if a != b:
                root[a] = b
                out.append((int(ids[i]), int(jds[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("cluster", "low", "high").applyInPandas(run, "a long, b long")


def _grouped(docs: DataFrame, words: int, share: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, groups, known): a row for each document, one for each class, and (class, component) of the classes with links."""
    classes, clash = _classes(docs, words, share), frozenset()
    groups = _groups(classes)
    # Different sets under one 64-bit name, a handful in 10^10 sets: named anew.
    if same := [r["class"] for r in groups.filter("low <> high").select("class").collect()]:
        clash = frozenset(same)
        classes = _classes(docs, words, share, clash)
        groups = _groups(classes)
    met = common.materialize(_met(docs, groups, words, share, clash), "keys")
    wanted = common.materialize(met.select("class").distinct(), "wanted")
    few = common.maybe_broadcast(wanted)
    first = common.materialize(groups.join(few, "class", "left_semi").select("id"), "firsts")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(common.maybe_broadcast(first), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = common.materialize(_sets(texts, few, words, clash), "sets")

    mild, hot = met.filter(F.col("size") <= HOT), met.filter(F.col("size") > HOT)
    star = met.filter(F.col("class") != F.col("leader")).groupBy(F.col("leader").alias("a"), F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"))
    links = common.materialize(_verify(star.filter(F.col("n") >= F.col("least")).select("a", "b"), sets, share).distinct(), "links")
    known = components.connected(links).toDF("class", "component")
    if not hot.isEmpty():
        links = common.materialize(links.unionByName(_hot_links(hot, known, sets, share)).distinct(), "links")
        known = components.connected(links).toDF("class", "component")

    # Keys whose classes are still in several components: those meet one another.
    left = mild.join(known, "class", "left").withColumn("component", F.coalesce("component", "class")).join(sets.select("class", "n"), "class")
    left = common.materialize(left.select("key", "class", "component", "n", "least"), "mild")
    left = common.materialize(_several(left, "component"), "open")
    one, two = left.toDF("key", "a", "c_a", "n_a", "least_a"), left.toDF("key", "b", "c_b", "n_b", "least_b")
    rest = one.join(two, "key").filter((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _near_size("n_a", "n_b", share))
    # Two classes of different components share only keys that are open or hot; the hot ones have compared them.
    rest = rest.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.greatest("least_a", "least_b")).alias("least")).filter(F.col("n") >= F.col("least"))
    more = common.materialize(_verify(rest.select("a", "b"), sets, share), "links")
    return classes, groups, known if more.isEmpty() else components.connected(links.unionByName(more)).toDF("class", "component")


def join(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Words lie between ASCII blanks, A-Z lower-cased. Null, empty and blank texts
    have no shingles, link with nothing and are their own component. Rows with
    equal texts are linked; a row with a null id gets its component's smallest
    id, null if there is none. Only doc_id and text are read, texts whole. Sets
    are compared by 64-bit hashes of shingles.
    """
    classes, groups, known = _grouped(docs, words, share)
    # Smallest ids by class, then by component: what goes back to the documents has a row for each class, however many copies it has.
    linked = common.materialize(groups.join(known, "class").select("class", "component", "id"), "linked")
    least = common.materialize(linked.groupBy("component").agg(F.min("id").alias("least")), "least")
    linked = linked.join(common.maybe_broadcast(least), "component").select("class", "least")
    copied = classes.filter("class IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class")
    copied = groups.join(copied, "class").join(known, "class", "left_anti").select("class", F.col("id").alias("least"))
    ids = common.maybe_broadcast(common.materialize(linked.unionByName(copied), "component-ids"))
    return classes.select("doc_id", "n_shingles", "class").join(ids, "class", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns.

    Rows go by id and text, so other texts under the same id stay. Of rows with
    equal ids one text stays, and of equal rows any one. Rows without an id keep
    one of their own in each component. Rows without words all stay.
    """
    classes, _, known = _grouped(docs, words, share)
    found = classes.filter(F.col("class").isNotNull()).groupBy("doc_id", "digest", "class").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(common.maybe_broadcast(common.materialize(known, "known")), "class", "left").withColumn("component", F.coalesce("component", "class"))
    found = common.materialize(found.withColumn("named", F.col("doc_id").isNotNull()).drop("class"), "components")
    stays = found.groupBy("component", "named").agg(F.min(F.struct("doc_id", "digest")).alias("stays"), F.sum("n").alias("rows"))
    stays = common.materialize(stays.filter("rows > 1").drop("rows"), "stays")
    once = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("digest") == F.col("stays.digest"))
    marks = found.join(common.maybe_broadcast(stays), ["component", "named"]).withColumn("once", once).filter(~F.col("once") | (F.col("n") > 1))
    marks = common.materialize(marks.select(F.col("doc_id").alias("id"), "digest", "once"), "marks")
    repeats = common.materialize(marks.filter("once").drop("once"), "repeats")
    # The row as one column, so that its columns may have any name.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_text"))
    on = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_text") == F.col("digest"))
    kept = keyed.join(common.maybe_broadcast(marks.drop("once")), on, "left_anti").select("row")
    if not repeats.isEmpty():
        again = keyed.join(common.maybe_broadcast(repeats), on, "left_semi")
        # Any one of equal rows; partial aggregation keeps a hot row's copies out of one task.
        kept = kept.unionByName(again.groupBy("own_id", "own_text").agg(F.first("row").alias("row")).select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
