"""Trie, packing and periodic runs against brute force, with nulls, ties, repeats, empty tables and odd columns."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import common, packing, periodic, queries, tokenbin, trie, wordids
from tests.llm import brute
from tests.llm.conftest import frame

TURNS = "conv_id long, turn long, role string, text string"


# --- 11 -----------------------------------------------------------------------


def trie_rows(convs: dict[int, list[tuple[str, str]]]) -> dict[tuple[int, int], tuple]:
    """(smallest member, depth) -> the other columns, from rebuilt conversations."""
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out, totals = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        own = (len(members[node]) - 1) * (len(brute.WORD.findall(node[-1][1])) if node else 0)
        totals[node] = (sum(totals[k][0] for k in below) or 1, own + sum(totals[k][1] for k in below))
    for node, own in members.items():
        up = min(members[node[:-1]]) if node else None
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out[min(own), len(node)] = (up, len(own), len(kids.get(node, [])), *totals[node], brute.sha(ends))
    return out


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    import hashlib

    convs: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t[2] for t in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % trie.MOST
        base = c - int(math.fmod(c, trie.GROUP))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def as_rows(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def test_trie_of_odd_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(-25, 70), 2**40]:
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(["a b", "a", "c d e", "", None])))
    rows += [(200, None, "user", "no turn"), (200, None, "user", "none either"), (200, 0, "bot", "x"), (200, 0, "bot", "x"), (None, 0, "user", "lost"), (221, 0, "user", "one")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit("p"), "depth": F.lit(1), "words": F.lit(2), "length": F.lit(3)}).repartition(5)
    got = as_rows(trie.report(df))
    assert got == trie_rows(rebuilt(rows))


def test_trie_of_a_single_and_of_no_conversation(spark):
    assert trie.report(spark.createDataFrame([], TURNS)).count() == 0
    got = as_rows(trie.report(spark.createDataFrame([(1, 0, "user", "a")], TURNS)))
    assert got == trie_rows(rebuilt([(1, 0, "user", "a")]))


@pytest.mark.parametrize("plain", [0, 1, 6])
def test_deep_tries_are_shortened(spark, plain, monkeypatch):
    """Copies of a long conversation, with others that leave it at every turn, in blocks of 8 turns."""
    monkeypatch.setattr(trie, "BLOCK", 8)
    spine = [("user", f"turn {i} of many") for i in range(40)]
    convs = {0: spine, 1: list(spine), 2: spine[:20], 3: []}
    for i in range(6, 30):
        convs[10 + i] = spine[:i] + [("bot", f"leaves at {i}")] * (1 + i % 2)
        convs[100 + i] = list(convs[10 + i])
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    numbered = trie.numbered(spark.createDataFrame(rows, TURNS))
    lengths = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id long, length long")
    nodes, ends = trie.prefix_trie(numbered, lengths, plain)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in nodes.collect()}
    assert got == {k: v[:5] for k, v in trie_rows(convs).items()}
    assert ends.count() == len(convs)


def test_ends_of_a_crowded_node(spark):
    rows = [(2 * i, 0, "user", "the same") for i in range(25_000)]
    ends = spark.createDataFrame(rows, TURNS).select(F.lit(1).cast("long").alias("depth"), F.lit(2).cast("long").alias("a"), F.lit(3).cast("long").alias("b"), "conv_id")
    assert [r.ends_sha256 for r in trie.ends_digest(ends).collect()] == [brute.sha(",".join(str(2 * i) for i in range(25_000)))]


# --- 12 -----------------------------------------------------------------------


def plain_pieces(texts: list[tuple]) -> list[tuple]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    out = []
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        for k in range(0, len(ids), packing.CAPACITY):
            part = np.array(ids[k : k + packing.CAPACITY], "<u4")
            out.append((doc_id, k // packing.CAPACITY, k, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check_packed(rows: list, texts: list[tuple]) -> int:
    """Asserts that the rows are the texts' pieces, laid side by side; returns the number of sequences."""
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == plain_pieces(texts)
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(held)


def test_packing_is_whole_and_tight(spark, corpus):
    odd = [(300, "It's a<|endoftext|>b  ΣΑΣ ﬁ é  nbsp sep \x1c x"), (301, "word " * 4095), (302, "word " * 4096), (303, "word " * 9000), (None, "no id"), (None, None), (5, "again"), (5, "again")]
    texts = corpus + odd
    rows = packing.pack(frame(spark, texts).withColumns({"uid": F.lit(1), "piece": F.lit("p"), "block": F.lit(0)})).collect()
    least = math.ceil(sum(r.length for r in rows) / packing.CAPACITY)
    assert check_packed(rows, texts) <= least + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_in_several_blocks(spark, monkeypatch):
    """Small blocks, several rounds of dealing: hardly more sequences than the tokens need."""
    monkeypatch.setattr(packing, "BLOCK", 40)
    rng = random.Random(2)
    texts = [(i, "word " * int(rng.lognormvariate(6.3, 0.9))) for i in range(300)]
    rows = packing.pack(frame(spark, texts)).collect()
    assert check_packed(rows, texts) <= math.ceil(sum(r.length for r in rows) / packing.CAPACITY) * 1.02 + 1
    # No two of these fit together: nothing to win, and it ends.
    assert check_packed(packing.pack(frame(spark, [(i, "word " * 2100) for i in range(90)])).collect(), [(i, "word " * 2100) for i in range(90)]) == 90


def test_genetic_steps_keep_every_item_and_improve():
    rng = np.random.default_rng(4)
    lengths = rng.integers(900, 2200, 120).astype(np.int64)
    first = packing.first_solution(lengths)
    population = packing.evolve(lengths, [first], 1, 40, 12)
    for x in population:
        assert len(x) == len(lengths)
        assert packing.fills_of(lengths, x).max() <= packing.CAPACITY
        assert packing.fills_of(lengths, x).min() > 0
    assert packing.rating(lengths, population[0]) < packing.rating(lengths, first)


@pytest.mark.parametrize("byte_level", [True, False])
def test_ids_of_odd_texts_and_a_small_memory(byte_level):
    import pyarrow as pa

    path = tokenbin.tokenizer_path() if byte_level else packing.tokenizer_path()
    encoder = wordids.TextIds(path, byte_level, cache=10)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "\na b", "a b\n", "it's, ok. it's 'S", "a <|endoftext|>b", "<|endoftext|>", None, "x\u00a0 y", "x\u00a0y z", "\x1c q", "é è 12,5 %", "word...next (and) [so]--on", "É, Été. \u2026. x\u2014.y e\u0301, E\u0301.", "ΣΑΣ, İi. ŉ", "a,b;c d.e\n.f", "don't,we'll", "日本,語。ok.", "$5.00 a1b2 x_y", "a\tb , c", "🙂ok 🙂,ok"]
    rng = random.Random(1)
    for k in range(40):
        some = [*texts, *(f"w{i} w{i + k}, w{k}" for i in range(30)), *("".join(rng.choice("ab .,'é\u0301\n\u00a01<|>Σ-") for _ in range(rng.randint(0, 25))) for _ in range(40))]
        for x, own in zip(some, encoder.encode(pa.array(some, pa.string())), strict=True):
            assert own.tolist() == encoder.tokenizer.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_token_blocks_deal_hot_ids(spark):
    path = common.scratch_path(spark, "hot-tokens")
    rows = [(None, f"none {i}") for i in range(3000)] + [(5, "the same")] * 3000 + [(i, "x") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenbin.write(frame(spark, rows), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 0.4 * len(rows)
    assert len(tokenbin.read_ids(spark, path, 5)) == 3001


# --- 13 -----------------------------------------------------------------------


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period), by trying every period everywhere."""
    n, found = len(words), {}
    for p in range(1, n // periodic.TIMES + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(periodic.LEAST, periodic.TIMES * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_agree_with_brute_force():
    rng = random.Random(8)
    some = 0
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 6])) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(len(w) + 1)
            w[a:a] = w[a : a + rng.randint(1, 6)] * rng.randint(1, 9)
        if rng.random() < 0.3:
            w = w + w[: rng.randint(0, len(w))] + w
        expected = plain_runs(w)
        assert [tuple(r) for r in periodic.runs_of(np.array(w, np.uint64)).tolist()] == expected
        some += len(expected)
    assert some > 2000
    assert periodic.runs_of(np.zeros(5000, np.uint64)).tolist() == [[0, 5000, 1]]
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(9, np.uint64), times=3)


def test_periodic_documents(spark, corpus):
    texts = corpus + [(400 + i, " ".join(f"w{k}" for k in range(i * 7))) for i in range(60)] + [(None, "a " * 10), (None, None), (3, "é " * 9), (3, "é " * 9)]
    docs = frame(spark, texts).withColumns({"runs": F.lit(1), "collapsed": F.lit("c"), "start": F.lit(2)})
    got = sorted((tuple(r) for r in periodic.report(docs).collect()), key=str)
    expected = []
    for doc_id, text in texts:
        words = brute.WORD.findall(text or "")
        if (places := periodic.echo(doc_id, len(words))) is not None:
            words = [words[k] for k in places]
        runs = plain_runs(words)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        expected.append((doc_id, len(runs), *best, milli, brute.sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), brute.sha(kept)))
    assert got == sorted(expected, key=str)
    assert sum(r[1] for r in got) > 10
    assert periodic.report(frame(spark, [])).count() == 0
    found = {r.doc_id: r for r in periodic.detect(frame(spark, [(1, "x y x y x y x y z")])).collect()}[1]
    assert [tuple(r) for r in found.runs] == [(0, 8, 2)] and found.collapsed == "x y z"


def test_the_new_queries_are_registered():
    assert {"op11_conversation_trie", "op12_best_fit_packing", "op13_periodic_runs"} <= set(queries.QUERIES)


# --- 1 ------------------------------------------------------------------------


def test_fingerprints_shuffle_texts_once_and_keep_odd_columns(spark, corpus):
    from netloom.llm import fingerprint

    out = fingerprint.fingerprint_edits(frame(spark, corpus))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    odd = frame(spark, corpus[:5]).withColumns({c: F.lit(c) for c in ("__words", "__all", "row", "words", "hashes")})
    sketched = fingerprint.with_sketch(odd, "text", "s")
    assert sketched.columns == [*odd.columns, "s"]
    assert [r["__words"] for r in sketched.collect()] == ["__words"] * 5


# --- 3, 5, 8: short items and hot keys ------------------------------------------


def test_short_items_store_no_runs(spark, tmp_path):
    """Items of one to nine words: what is kept of the documents stays below the texts' own size."""
    import os

    from netloom.llm import decontaminate

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = [(i, " ".join(word() for _ in range(300))) for i in range(200)]
    items = [(n, " ".join(brute.WORD.findall(docs[7 * n][1])[5 : 5 + n])) for n in range(1, 10)] + [(20, docs[3][1])]
    shared = common.shared_folder(spark)
    held = lambda: {p for top, _, names in os.walk(f"{shared}/netloom") for p in (f"{top}/{n}" for n in names)}
    before = held()
    out = decontaminate.report(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()}
    assert got == brute.contamination(docs, items)
    assert sum(os.path.getsize(p) for p in held() - before) < sum(len(t) for _, t in docs)


def test_no_task_gathers_a_hot_key(spark):
    """A passage in 3,000 different texts: no plan step orders or windows the rows of one key."""
    from netloom.llm import ngram_join, substring

    passage = " ".join(f"p{i}" for i in range(60))
    texts = [(i, f"{passage} own{i} tail{i}") for i in range(3000)]
    docs = frame(spark, texts)
    removed = {r.doc_id: r.n_removed for r in substring.report(docs).collect()}
    assert removed[0] == 0 and {removed[i] for i in range(1, 3000)} == {60}
    assert {r.component_id for r in ngram_join.join(docs).collect()} == {0}
    rows = spark.createDataFrame([(7, i) for i in range(20_000)] + [(i, i) for i in range(100, 200)], "key long, class long").repartition(8)
    stored = common.materialize(rows, "hot-keys")
    some = ngram_join._several(stored)
    assert some.count() == 20_000 and "Window" not in some._jdf.queryExecution().executedPlan().toString()


def test_substring_keys_and_windows_cross_one_shuffle(spark, corpus, monkeypatch):
    """No table holds a row for each key or window, and no join sends them a second time."""
    from netloom.llm import substring

    stored, store = {}, common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: stored.setdefault(name, store(df, name)))
    docs = frame(spark, corpus)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(docs).collect()}
    assert got == brute.without_repeats(corpus, 50)
    assert {name: n for name, df in stored.items() if (n := df.count()) > len(corpus)} == {}
    found = substring._shared(substring._key_rows(docs, 50, frozenset()))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("stretch", [0, 20, 500_000])
def test_crowded_substring_keys_are_compared_before_the_shuffle(spark, corpus, monkeypatch, stretch):
    from netloom.llm import substring

    monkeypatch.setattr(substring, "STRETCH", stretch)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(frame(spark, corpus)).collect()}
    assert got == brute.without_repeats(corpus, 50)
    passage = " ".join(f"p{i}" for i in range(50))
    docs = frame(spark, [(i, f"{passage} own{i}") for i in range(200)]).coalesce(1)
    rows = substring._key_rows(docs, 50, frozenset()).filter("known IS NULL").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert rows == (2 if stretch == 500_000 else rows)
    removed = {r.doc_id: r.n_removed for r in substring.report(docs).collect()}
    assert removed == {i: 50 if i else 0 for i in range(200)}


def test_join_keys_are_peeled_without_tables(spark, corpus, monkeypatch):
    """The passes over the keys store nothing and send nothing twice, and keep the keys that brute force keeps."""
    from netloom.llm import ngram_join

    docs, none = frame(spark, corpus), frozenset()
    groups = ngram_join._groups(ngram_join._classes(docs, 4, 85))
    need = {r["class"]: (r.even, r.odd) for r in groups.collect()}
    rows = {(r.key, r["class"]) for r in ngram_join._key_rows(docs, 4, 85, none).collect()}

    def several(rows):
        owners = {}
        for key, name in rows:
            owners.setdefault(key, set()).add(name)
        return {(k, c) for k, c in rows if len(owners[k]) > 1}

    rows = several(rows)
    for _ in range(ngram_join.PEELS):
        held = {}
        for key, name in rows:
            held[name, key % 2] = held.get((name, key % 2), 0) + 1
        rows = several({(k, c) for k, c in rows if held[c, k % 2] >= need[c][k % 2]})

    def stored(df, name):
        raise AssertionError(name)

    monkeypatch.setattr(common, "materialize", stored)
    got = ngram_join._met(docs, groups, 4, 85, none).collect()
    assert rows and len(got) == len(rows) and {(r.key, r["class"]) for r in got} == rows
    assert all(r.leader == min(c for k, c in rows if k == r.key) and r.size == sum(k == r.key for k, _ in rows) and r.least == need[r["class"]][r.key % 2] for r in got)
