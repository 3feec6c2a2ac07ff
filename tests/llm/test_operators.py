"""Operators against brute force, SQL and exact round trips, with nulls, empty tables, ties and odd columns."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import common, components, decontaminate, fingerprint, license, linefreq, mixing, ngram_join, queries, sharding, substring, tokenbin, toxicity
from tests.llm import brute
from tests.llm.conftest import frame
from tests.oracle import assert_same


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_agree_with_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLE[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_give_a_row_per_document(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    out = out.filter("piece = 0") if "piece" in out.columns else out
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_empty_tables(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert fingerprint.fingerprint_edits(docs).count() == 0
    assert toxicity.report(docs, labels).count() == 0
    assert decontaminate.report(docs, bench).count() == 0
    assert tokenbin.round_trip(docs).count() == 0
    assert ngram_join.join(docs).count() == 0
    assert linefreq.drop_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert sharding.assign_shards(docs).count() == 0
    assert substring.report(docs).count() == 0
    assert mixing.report(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert license.scan(license.document_paths(docs)).count() == 0


# --- 1 ------------------------------------------------------------------------


def printed(sketch):
    return "1/8:" + ",".join(f"{h % 2**64:X}" for h in sketch)


def test_fingerprints(spark, corpus):
    out = fingerprint.fingerprint_edits(frame(spark, corpus).withColumn("sketch", F.lit(1)).withColumn("bucket", F.lit("b")))
    rows, texts, new = {r.doc_id: r for r in out.collect()}, dict(corpus), brute.edited(corpus)
    assert len(rows) == len(corpus)
    order = sorted(texts)
    for k, i in enumerate(order):
        r, after = rows[i], texts[order[(k + 1) % len(order)]]
        assert r.n_chars == len(texts[i] or "")
        assert r.edited_sha256 == brute.sha(new[i])
        own, edit = brute.sketch(texts[i]), brute.sketch(new[i])
        assert r.fingerprint == printed(own)
        assert r.edited_fingerprint == printed(edit)
        assert r.near_edited == pytest.approx(brute.likeness(own, edit))
        assert r.near_next == pytest.approx(brute.likeness(own, brute.sketch(after)))
    big = [r for i, r in rows.items() if len(texts[i] or "") > 20_000]
    assert all(abs(r.near_edited - 0.5) < 0.25 for r in big)


def test_fingerprints_of_one_and_of_repeated_rows(spark):
    assert fingerprint.fingerprint_edits(frame(spark, [(7, "abcd")])).first().edited_sha256 == brute.sha("abab")
    out = fingerprint.fingerprint_edits(frame(spark, [(1, "aa"), (1, "aa"), (None, "b"), (2**40, None)])).collect()
    assert len(out) == 4


def test_fingerprints_of_odd_ids(spark):
    """A far id, negative ids and one id with half of all rows: neighbours are right, and no bucket takes most of the table."""
    rows = [(i, f"t{i} " * 4) for i in range(-700, 700)] + [(2**62, "far"), (-(2**62), "low")]
    got = by_id(fingerprint.fingerprint_edits(frame(spark, rows)))
    new = brute.edited(rows)
    assert {i: r[1] for i, r in got.items()} == {i: brute.sha(t) for i, t in new.items()}
    hot = [*rows, *[(5, f"hot {k}") for k in range(1500)], *[(None, f"none {k}") for k in range(1500)]]
    docs = frame(spark, hot).withColumn("h", F.shiftright(F.xxhash64("text"), 1) + F.lit(2**62))
    sizes = docs.groupBy(fingerprint._cells(docs, "doc_id", "h").alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    assert fingerprint.fingerprint_edits(frame(spark, hot)).count() == len(hot)


def test_sketches_merge_and_contain(spark):
    words = [f"w{i}" for i in range(4000)]
    cases = [(words, words[1000:1400]), (words[:50], words[46:100]), (words[:5], words[7:12]), (words[:5], []), ([], []), (words[:3], words[:3])]
    rows = [(" ".join(a), " ".join(b)) for a, b in cases]
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "x"), "b", "y")
    got = df.select("a", "b", "x", "y", fingerprint.containment(F.col("y"), F.col("x")).alias("c"), fingerprint.merge(F.col("x"), F.col("y")).alias("m")).collect()
    assert got[0].c == 1.0
    for r in got:
        both = sorted({*brute.sketch(r.a, scale=1), *brute.sketch(r.b, scale=1)})  # all hashes of both
        assert r.m == ([h for h in both if h < -(2**63) + 2**61] or both[:1])


# --- 2 ------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    out = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    yes, no = [out[i].score for i in held if truth[i]], [out[i].score for i in held if not truth[i]]
    assert np.mean([a > b for a in yes for b in no]) > 0.85
    assert np.mean([s < 0.5 for s in no]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_toxicity_learns_and_handles_odd_texts(spark):
    rng = np.random.default_rng(0)
    say = lambda bad: " ".join(["fool" if bad and k % 9 == 4 else f"w{rng.integers(200)}" for k in range(80)])
    y = np.arange(200) % 2
    model = toxicity.train([say(b) for b in y], y, np.ones(200))
    odd = ["", " \n", "fool", "w1 " * 3000 + "fool " * 8 + "w2 " * 3000, "w1 " * 3000]
    s = model.scores(pa.array([say(1), say(0), *odd, None]))
    assert s[0] > 0.5 > s[1]
    assert s[5] > 0.5 > s[6]
    assert s[2] == s[3] == s[7]
    assert toxicity.train(["a", "b"], np.array([0, 0]), np.ones(2)) is None


def sample(rng, n=6):
    """Texts with known and unknown words, and a model that was never trained."""
    texts = [" ".join(f"{'ab'[rng.integers(2)]}{rng.integers(40)}" for _ in range(rng.integers(0, 150))) for _ in range(n)]
    size = 1 << toxicity.BITS
    return texts, toxicity.Model(rng.standard_normal(size).astype("f"), rng.standard_normal(size).astype("f"), toxicity._start(rng), 1.5, -0.2)


def test_toxicity_scores_match_a_loop_over_windows():
    """Every window by itself, word by word and gate by gate."""
    texts, model = sample(np.random.default_rng(3))
    p, out, h = model.network, [], toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for text in texts:
        words, which, _ = toxicity._sample_words([text])
        x, n, logits = model.inputs(words), len(which), []
        for at in range(0, max(1, n - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            own, states = [x[k] for k in which[at : at + toxicity.WINDOW]], []
            for d in "fb":
                s, held = np.zeros(h), []
                for v in own if d == "f" else own[::-1]:
                    a, u = v @ p[d + "x"] + p[d + "b"], s @ p[d + "h"]
                    z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
                    s = s + z * (np.tanh(a[2 * h :] + r * u[2 * h :]) - s)
                    held.append(s)
                states.append(held if d == "f" else held[::-1])
            if own:
                both = [np.concatenate(y) for y in zip(*states, strict=True)]
                e = np.exp([np.tanh(y @ p["a"] + p["ab"]) @ p["v"] for y in both])
                logits.append(sum(w * y for w, y in zip(e / e.sum(), both, strict=True)) @ p["w"] + p["c"][0])
            else:
                logits.append(p["c"][0])
        out.append(sigmoid(model.scale * max(logits) + model.shift))
    again = toxicity.Model.from_bytes(model.to_bytes())
    assert again.scores(pa.array(texts)) == pytest.approx(out, abs=1e-4)
    # What a task remembers of earlier texts changes nothing.
    scorer = toxicity.Scorer(again)
    assert [scorer.scores(pa.array([t]))[0] for t in texts] == pytest.approx(out, abs=1e-4)


def test_toxicity_gradient():
    """Slopes of all weights and embeddings against differences, in double precision."""
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in toxicity._start(rng).items()}
    words, which, first = toxicity._sample_words(["a0 bb a1 cc dd", "x y", "a0 zz"])
    _, at, length = toxicity._windows(first)
    place, mask = toxicity._places(which, at, length)
    odds, slope, mask = rng.standard_normal((len(words.row), toxicity.ODDS)), rng.standard_normal(3), mask.astype(np.float64)

    def run(q, keep=False):
        x = np.hstack([odds, toxicity._embedded(q, words)])[place]
        own = toxicity._projected(q, x.reshape(-1, toxicity.INPUTS))
        return x, toxicity._forward(q, own, np.arange(place.size).reshape(place.shape), mask, keep)

    x, state = run(p, keep=True)
    gradient, d_x = toxicity._backward(p, x, state, slope)
    d_words = toxicity._summed(place.ravel(), d_x[:, :, toxicity.ODDS :].reshape(-1, 2 * toxicity.DIM), len(words.row))
    gradient |= toxicity._embedded_back(p, words, d_words)
    shift = toxicity.BITS - toxicity.EMBED_BITS
    for k in p:
        where = tuple(rng.integers(0, s) for s in p[k].shape)
        where = (int(words.row[1] >> shift), 2) if k == "words" else (int(words.grams[3] >> shift), 1) if k == "grams" else where
        numeric = []
        for step in (1e-4, -1e-4):
            q = {n: v.copy() for n, v in p.items()}
            q[k][where] += step
            numeric.append(run(q)[1][0] @ slope)
        assert np.asarray(gradient[k])[where] == pytest.approx((numeric[0] - numeric[1]) / 2e-4, abs=1e-6), k


def test_toxicity_keeps_columns_and_handles_null_ids(spark):
    rows = [(i, "you fool " * 3 if i % 4 == 3 else "a kind word", "s") for i in range(40)] + [(None, None, "s"), (None, "fool fool", "s"), (3, "you fool " * 3, "s")]
    docs = frame(spark, rows).withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(7)).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 3)) for i in range(40)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    left = toxicity.remove_toxic(docs, labels)
    assert left.columns == docs.columns
    kept = left.collect()
    assert {r.text for r in kept} == {"a kind word", None}
    assert len(kept) == 31
    assert {(r.score, r.predicted, r.row) for r in kept} == {("mine", 7, 1)}
    out = toxicity.report(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(r.held_out for r in out if r.doc_id is None)


def test_toxic_passages_at_any_offset(spark):
    """A passage of 48 words lies whole in a window wherever it begins."""
    rng = np.random.default_rng(0)
    say = lambda n: [f"w{rng.integers(200)}" for _ in range(n)]
    bad = lambda: ["fool" if k % 6 == 4 else w for k, w in enumerate(say(48))]
    y = np.arange(300) % 2
    model = toxicity.train([" ".join(say(100) + (bad() if b else say(48)) + say(60)) for b in y], y, np.ones(300))
    planted = model.scores(pa.array([" ".join(say(at) + bad() + say(400 - at)) for at in range(0, 130)]))
    clean = model.scores(pa.array([" ".join(say(448)) for _ in range(130)]))
    assert np.mean(planted >= 0.5) > 0.95
    assert np.mean(clean < 0.5) > 0.95


# --- 3 ------------------------------------------------------------------------


def test_decontamination(spark, corpus):
    texts = dict(corpus)
    items = [(1, texts[5]), (2, texts[0][:300]), (3, "One two THREE four"), (4, None), (5, "..."), (6, texts[2]), (7, texts[0][:300]), (8, "word"), (9, texts[107][2000:2400])]
    docs = [*corpus, (300, "say one, TWO three; four five"), (301, "Word wor word's"), (302, texts[107][1500:2500].upper())]
    out = decontaminate.report(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = by_id(out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert got == brute.contamination(docs, items)


def test_decontamination_keeps_columns_and_clean_rows(spark, corpus):
    docs = frame(spark, [(1, "a b c d e f g h i j k"), (2, "x y"), (None, None), (2, "x y")]).withColumn("key", F.lit(1)).withColumn("hash", F.lit(2))
    left = decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 2), (False, 2), (True, 0)]


def test_decontamination_with_null_ids_and_a_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(3000))
    items = spark.createDataFrame([(None, "q1 q2 q3"), (None, passage[:400]), (4, passage)], "item_id long, text string")
    docs = [(1, "x " + passage + " y"), (2, "a q1 q2 q3 b"), (None, passage), (1, None)]
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(frame(spark, docs), items).collect()}
    assert got == {(1, 3002): (3000, 2, brute.sha("4")), (2, 5): (3, 1, brute.sha("")), (None, 3000): (3000, 2, brute.sha("4")), (1, 0): (0, 0, brute.sha(""))}


# --- 4 ------------------------------------------------------------------------


def test_token_blocks(spark, corpus):
    from tokenizers import Tokenizer

    rows = [*corpus, (400, "a  b   c \n d\t\te <|endoftext|> f  g"), (401, " lead"), (402, "trail \n"), (403, "it's we'll 123 4,5 x..."), (404, "日本 語 🙂 ok")]
    reader = Tokenizer.from_file(tokenbin.tokenizer_path())
    path = common.scratch_path(spark, "test-tokens")
    tokenbin.write(frame(spark, rows), path)
    got, start = by_id(tokenbin.read(spark, path)), 0
    assert len(got) == len(rows)
    for i, text in sorted(rows):
        ids = np.array([*reader.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        if i % 40 == 0:
            assert (tokenbin.read_ids(spark, path, i)[0] == ids).all()


def test_token_block_needs_its_dictionary():
    import hashlib

    data = tokenbin.pack([1, None], [b"", b""], 2, hashlib.sha256(b"x").digest())
    with pytest.raises(ValueError, match="dictionary"):
        tokenbin.Block(data, b"y")


def test_token_ids_null_and_repeated(spark):
    got = tokenbin.round_trip(frame(spark, [(None, "x"), (1, "a b"), (1, "a b")]).withColumn("block", F.lit("b")).withColumn("part", F.lit(3))).collect()
    assert sorted((r.doc_id is None, r.start) for r in got)[-1] == (True, 0)
    assert len(got) == 3


# --- 5 ------------------------------------------------------------------------


@pytest.mark.parametrize(("words", "share", "hot"), [(4, 85, 64), (5, 80, 64), (4, 85, 3)])
def test_jaccard_join(spark, corpus, monkeypatch, words, share, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    got = by_id(ngram_join.join(frame(spark, corpus), words, share))
    assert got == brute.components(corpus, words, share)


def test_jaccard_join_at_the_bound(spark):
    base = [f"w{i}" for i in range(203)]  # 200 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:100] + ["x"] + base[101:])), (3, " ".join(base + [f"y{i}" for i in range(35)])), (4, " ".join(base + [f"z{i}" for i in range(36)]))]
    rows += [(10 + i, " ".join(f"t{k}" for k in range(n))) for i, n in enumerate((7, 8, 9, 10, 11, 12, 13))]
    assert by_id(ngram_join.join(frame(spark, rows))) == brute.components(rows)


def test_jaccard_join_nulls_and_repeats(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "A B C D E"), (9, None), (None, None)]
    got = ngram_join.join(frame(spark, rows).withColumn("class", F.lit(1)).withColumn("key", F.lit("k"))).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3), (5, 3), (5, 3), (9, 9)]
    kept = ngram_join.keep_one(frame(spark, rows).withColumn("class", F.lit(1)))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 3, 9]


def test_keep_one_with_repeated_and_missing_ids(spark):
    text, near, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("t", "t", "u"))
    near += " end"
    kept = lambda rows: sorted(((r.doc_id or -1), r.text or "") for r in ngram_join.keep_one(frame(spark, rows)).collect())
    assert kept([(3, text), (3, text)]) == [(3, text)]
    assert kept([(3, text), (3, near), (3, other)]) in ([(3, text), (3, other)], [(3, near), (3, other)])
    assert kept([(3, text), (5, near), (5, other)]) == [(3, text), (5, other)]
    assert len(kept([(None, text), (None, near), (None, text)])) == 1
    assert kept([(None, text), (None, other), (None, None), (None, None)]) == kept([(None, text), (None, text), (None, other), (None, None), (None, None)])


def test_jaccard_join_with_clashing_class_names(spark, corpus, monkeypatch):
    """Sets whose first hashes agree are told apart by their second ones."""
    full = ngram_join._digest

    def weak(own, clash=frozenset()):
        one, two = full(own)
        return (full(own, frozenset([one]))[0] if one % 7 in clash else one % 7), two

    classes = ngram_join._groups(ngram_join._classes(frame(spark, corpus), 4, 85))
    assert classes.filter("low <> high").isEmpty()
    own = [np.unique(np.random.default_rng(i).integers(0, 2**63, 9).astype(np.uint64)) for i in range(50)]
    names = [weak(x)[0] for x in own]
    clash = frozenset(n for n in names if names.count(n) > 1)
    assert len({weak(x, clash)[0] for x in own}) == 50


def test_hot_cluster_of_several_components(spark, monkeypatch):
    """Keys of very many classes whose members are not all linked with the first one."""
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(36):
        w = list(base)
        for k in range(3 * (i % 4)):
            w[10 + 7 * k] = f"x{i % 4}" if i % 3 else f"y{i}"
        w[5] = f"z{i}"
        rows.append((i, " ".join(w)))
    assert by_id(ngram_join.join(frame(spark, rows))) == brute.components(rows)


def test_overlaps_over_column_blocks(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 60, 30)) for _ in range(9)]
    expected = [[len(set(a) & set(b)) for b in rows] for a in rows]
    got = ngram_join.overlaps(rows)
    for i in range(9):
        for j in range(9):
            if i != j:
                assert got[i, j] == expected[i][j]
    assert (ngram_join.overlaps(rows[:4], rows[4:]) == np.array(expected)[:4, 4:]).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (7, 7)], "a long, b long").repartition(4)
    got = by_id(components.connected(edges))
    assert {got[i][0] for i in range(61)} == {0}
    assert got[100] == (99,)


# --- 6 ------------------------------------------------------------------------


def test_line_frequency(spark):
    pages = [(i, f"http://A.com:80/{i}", f"<p>head\n<b>own {i}\n\n<i>foot") for i in range(6)] + [(10, "http://b.com/", "<p>head\n<b>x"), (11, None, None), (12, "odd", "<p>head")]
    pages += [(20, "http://user:pw@c.com/", "one\r\ntwo 20\r\n"), (21, "https://c.com:8080", "one\ntwo 21"), (22, "http://c.com?x", "one\rtwo 22"), (22, "http://c.com?x", "one\rtwo 22")]
    pages += [(30, "http://[::1]:80/", "long " * 40_000 + "\nsame"), (31, "http://[::1]/", "other\nsame"), (None, "ftp://[::1]", "same")]
    out = linefreq.drop_boilerplate(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lines", F.lit(0)))
    rows = out.collect()
    got = {r.page_id: (r.host, r.n_lines, r.n_dropped, r.kept) for r in rows}
    assert len(rows) == len(pages)
    assert got[3] == ("a.com", 3, 2, "<b>own 3")
    assert got[10] == ("b.com", 2, 0, "<p>head\n<b>x")
    assert got[11] == ("", 0, 0, "")
    assert got[20] == ("c.com", 2, 1, "two 20")
    assert got[21] == ("c.com", 2, 1, "two 21")
    assert got[22] == ("c.com", 2, 2, "")  # on two of four pages: its repeated row is a page of its own
    assert got[30] == ("[::1]", 2, 1, ("long " * 40_000).strip())
    assert got[None] == ("[::1]", 1, 1, "")


# --- 7 ------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [200, 2_000, 10**9])
def test_shards(spark, corpus, limit):
    docs = frame(spark, [*corpus, *[(500, "same")] * 80]).withColumn("depth", F.lit("d")).withColumn("h", F.lit(0))
    out = sharding.assign_shards(docs, limit)
    assert out.columns == [*docs.columns, "n_bytes", "shard", "shard_bytes"]
    rows = out.collect()
    assert len(rows) == docs.count()
    sizes, members = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
        members.setdefault(r.shard, set()).add((r.doc_id, r.text))
    assert all(r.shard_bytes == sizes[r.shard] for r in rows)
    assert all(n <= limit or len(members[s]) == 1 for s, n in sizes.items())
    assert not any(s[:k] in sizes for s in sizes for k in range(len(s)))
    # Only shards that were too large were split: what lies under the parent of any shard is over the limit.
    assert all(sum(n for t, n in sizes.items() if t.startswith(s[:-1])) > limit for s in sizes if s)


# --- 8 ------------------------------------------------------------------------


@pytest.mark.parametrize("span", [50, 5])
def test_substrings(spark, corpus, span):
    assert by_id(substring.report(frame(spark, corpus), span)) == brute.without_repeats(corpus, span)


def test_substrings_nulls_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(60))
    got = substring.report(frame(spark, [(2, long), (2, long), (2, "z " + long), (1, "y " + long), (None, long), (3, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got) == [(-1, 60, 0), (1, 61, 0), (2, 60, 60), (2, 60, 60), (2, 61, 60), (3, 0, 0)]


# --- 9 ------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", None, "Z", "é"][i % 5]) for i in range(400)] + [(900, None, "empty"), (901, "x", "a"), (901, "x", "a")]
    out = mixing.report(frame(spark, rows)).toPandas()
    source = dict((i, s) for i, _, s in [(*r, None)[:3] for r in rows])
    sizes = {s: out[[source[i] == s for i in out.doc_id]] for s in ["a", "b", None, "Z", "é", "empty"]}
    total, left = out["size"].sum(), {s: f["size"].sum() for s, f in sizes.items()}
    order = [s for s in sorted(x for x in left if x is not None)] + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(total)
    while True:
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        full = {s for s in free if share[s] >= 3 * left[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * left[s] for s in full}
        rest -= sum(3.0 * left[s] for s in full)
        free -= full
    for s, f in sizes.items():
        assert (f.source_size == left[s]).all()
        assert f.target.iloc[0] == pytest.approx(target[s])
        p = (target[s] / left[s]) % 1 if left[s] else 0
        assert abs(f.taken.sum() - target[s]) <= 4 * np.sqrt((f["size"] ** 2).sum() * p * (1 - p)) + 1e-6
    assert (out.taken <= 3 * out["size"]).all()
    again = mixing.report(frame(spark, rows)).toPandas()
    assert sorted(again.itertuples(index=False, name=None), key=str) == sorted(out.itertuples(index=False, name=None), key=str)
    docs = frame(spark, rows).withColumn("target", F.lit("t")).withColumn("copies", F.lit(9))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == out.taken.sum()


def test_mixing_of_null_and_repeated_ids(spark):
    """Rows without an id, and copies of one row, toss coins of their own, and each source comes near its target."""
    rows = [(None, f"w{i} x", "a") for i in range(1000)] + [(None, "same text", "b")] * 1000 + [(7, f"y{i} z", "c") for i in range(1000)]
    out = mixing.report(frame(spark, rows).withColumn("key", F.lit(1)).withColumn("number", F.lit(2)))
    sums = {r.target: r.n for r in out.groupBy("target").agg(F.sum("taken").alias("n")).collect()}
    assert sorted(sums) == pytest.approx([750, 1500, 3750])
    assert all(abs(n - target) < 150 for target, n in sums.items())
    other = mixing.report(frame(spark, rows[::-1]).repartition(7))
    assert sorted(map(str, out.collect())) == sorted(map(str, other.collect()))
    assert mixing.mix(frame(spark, rows)).count() * 2 == sum(sums.values())


# --- 10 -----------------------------------------------------------------------


def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print()"), (3, "a/b/COPYING.txt", "text\n\nThis work is licensed under the GNU General Public License, version 3.\n\nmore"),
        (4, "a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (5, "z/x.py", None), (6, None, ""), (7, "a/y.py", "x"), (8, "LICENSE", "no licence at all"), (9, "a/b2/x", "the work is under the tree"),
        (10, "q/" + "w" * 10, "word " * 30_000 + "\nLicensed under CC BY-NC 4.0.\n" + "word " * 30_000),
    ]
    out = license.scan(spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("own", F.lit(1)))
    got = {r.doc_id: (r.license, r.basis, r.inherited_from) for r in out.collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0-only", "inherited", "a/b/COPYING.txt"), 3: ("GPL-3.0-only", "own", None), 4: ("Apache-2.0", "own", None), 5: (None, "none", None),
        6: (None, "none", None), 7: ("MIT", "inherited", "a/LICENSE"), 8: (None, "none", None), 9: ("MIT", "inherited", "a/LICENSE"), 10: ("CC-BY-NC-4.0", "own", None),
    }


def test_license_templates_find_themselves():
    m = license.Matcher()
    for k, (name, text) in enumerate(license.TEMPLATES):
        assert m.match(pa.array(["\n".join(["prose here", text, "more prose"])]), 0.99)[0] == [name], k
    assert m.match(pa.array(["Lorem ipsum dolor under the license of nobody in particular at all"]), 0.75)[0] == [None]


def test_near_versions_are_told_apart():
    """Whole texts laid out over lines, with a copyright line of their own."""
    m, lay = license.Matcher(), lambda t: "\n".join(t[i : i + 70] for i in range(0, len(t), 70))
    for name in ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "ISC", "0BSD", "MIT", "Zlib", "BSL-1.0", "Unlicense"):
        whole = max((t for n, t in license.TEMPLATES if n == name), key=len)
        words = whole.split(" ")
        text = "Copyright (c) 2021 Jane Roe\n" + "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
        assert m.match(pa.array([text]), 0.75)[0] == [name]


def plain_license(text, templates, threshold):
    """TF-IDF cosines of all lines, paragraphs and the text with all templates, by plain sums."""
    import math
    import re
    from collections import Counter

    words = lambda t: Counter(re.findall(r"[0-9a-z\x80-\U0010FFFF]+", t.translate(brute.LOWER)))
    bags = [words(t) for _, t in templates]
    weight = lambda w: math.log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1
    best = (None, 0.0)
    for part in [*text.split("\n"), *re.split(r"\n[^0-9A-Za-z\x80-\U0010FFFF]*\n", text), text]:
        own = words(part)
        for (name, _), bag in zip(templates, bags, strict=True):
            dot = sum(own[w] * bag[w] * weight(w) ** 2 for w in own if w in bag)
            if dot:
                score = dot / math.sqrt(sum((n * weight(w)) ** 2 for w, n in own.items()) * sum((n * weight(w)) ** 2 for w, n in bag.items()))
                if score >= threshold and score > best[1] + 1e-12:
                    best = (name, score)
    return best


def test_license_cosine_matches_plain_sums():
    rng = np.random.default_rng(1)
    vocabulary = sorted({w for _, t in license.TEMPLATES for w in t.split()})
    texts = ["", "\n\n", "é", "the software"]
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 5)):
            words = license.TEMPLATES[rng.integers(len(license.TEMPLATES))][1].split()[: rng.integers(3, 60)]
            for _ in range(rng.integers(0, 6)):
                words[rng.integers(len(words))] = str(rng.choice(vocabulary)) if rng.random() < 0.5 else f"q{rng.integers(99)}"
            parts.append(" ".join(words))
        texts.append(["\n", "\n\n", " \n \n"][rng.integers(3)].join(parts))
    names, scores = license.Matcher().match(pa.array([*texts, None]), 0.75)
    for text, name, score in zip([*texts, ""], names, scores, strict=True):
        expected = plain_license(text, license.TEMPLATES, 0.75)
        assert score == pytest.approx(expected[1], abs=1e-9)
        assert name == expected[0]


def test_inherited_licenses_match_a_walk_up_the_tree(spark):
    rng = np.random.default_rng(4)
    notices = [t for _, t in license.TEMPLATES if len(t) < 90]
    files = []
    for i in range(300):
        folder = "/".join(str(rng.choice(["a", "b", "c"])) for _ in range(rng.integers(0, 5)))
        name = ["LICENSE", "COPYING.md", "notice.txt", f"f{i}.py"][min(3, int(rng.integers(12)))]
        text = str(rng.choice(notices)) if name[0] != "f" or rng.random() < 0.1 else "code" if rng.random() < 0.8 else None
        files.append((i, f"{folder}/{name}" if folder else name, text))
    files += [(300, None, "code"), (7, *files[7][1:]), (7, *files[7][1:])]
    stated = {}
    for _, path, text in files:
        name, score = plain_license(text or "", license.TEMPLATES, 0.75)
        if name and path and path.rpartition("/")[2].lower().startswith(("license", "copying", "notice")):
            folder = path.rpartition("/")[0]
            stated[folder] = min(stated.get(folder, (0, "~")), (-round(score, 9), path, name))
    out = license.scan(spark.createDataFrame(files, "doc_id long, path string, text string").repartition(3))
    got = sorted(((r.doc_id, r.path or "", r.license, r.basis, r.inherited_from, round(r.score, 6)) for r in out.collect()), key=str)
    expected = []
    for i, path, text in files:
        name, score = plain_license(text or "", license.TEMPLATES, 0.75)
        basis, above = ("own" if name else "none"), None
        folder = path.rpartition("/")[0] if path else None
        while not name and folder is not None:
            if folder in stated:
                score, name, basis, above = -stated[folder][0], stated[folder][2], "inherited", stated[folder][1]
            elif not folder:
                break
            folder = folder.rpartition("/")[0]
        expected.append((i, path or "", name, basis, above, round(score, 6)))
    assert got == sorted(expected, key=str)
