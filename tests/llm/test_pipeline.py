"""The pipeline's stages against brute force, each on its own input, and on odd tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import common, toxicity
from tests.llm import brute
from tests.llm.conftest import frame


def mixed(rows):
    """(doc_id, text, source) rows as often as the mix takes them: targets, coins and numbers of repeats by plain loops."""
    size = lambda t: len(brute.WORD.findall(t or ""))
    left: dict = {}
    for _, text, source in rows:
        left[source] = left.get(source, 0) + size(text)
    order = [*sorted(s for s in left if s is not None), *[s for s in left if s is None]]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(left.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        full = {s for s in free if share[s] >= 3 * left[s]}
        target |= {s: 3.0 * left[s] for s in full} if full else share
        rest -= sum(3.0 * left[s] for s in full)
        free = free - full if full else set()
    out, met = [], {}
    for row in rows:
        key = hashlib.md5("|".join("-" if v is None else f"={v}" for v in (row[0], row[2], row[1])).encode()).hexdigest()
        met[key] = met.get(key, 0) + 1
        coin = int(hashlib.md5(f"mix-2:{key}:{met[key]}".encode()).hexdigest()[:13], 16) / 2**52
        rate = min(target[row[2]] / left[row[2]], 3.0) if left[row[2]] else 0.0
        out += [row] * (int(rate) + (coin < rate - int(rate)))
    return out


def plain(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns, before = docs.columns, docs
    bench = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialize(stage(spark, before, sf), f"test-{name}")
        rows, kept = [(r.doc_id, r.text) for r in before.collect()], [(r.doc_id, r.text) for r in after.collect()]
        if name != "sharding":
            assert after.columns == columns
        if name == "toxicity":
            model = toxicity.Model.from_bytes(bytes(toxicity.fit(before, common.table(spark, sf, "labels")).first().model))
            import pyarrow as pa

            assert sorted(kept) == sorted(r for r in rows if model.scores(pa.array([r[1]]))[0] < 0.5)
        elif name == "ngram_jaccard_join":
            groups = brute.components(rows, 5, 80)
            assert sorted(i for i, _ in kept) == sorted(i for i, (_, c) in groups.items() if i == c)
        elif name == "benchmark_decontamination":
            found = brute.contamination(rows, bench)
            assert sorted(i for i, _ in kept) == sorted(i for i, r in found.items() if not r[-1])
        elif name == "source_mixing":
            assert plain(after) == sorted(mixed([(r.doc_id, r.text, r.source) for r in before.collect()]), key=str)
        elif name == "sharding":
            assert sorted(kept) == sorted(rows)
        assert kept
        before = after


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with labels and a benchmark for the odd tables below."""
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, 0, int(i % 4 == 3)) for i in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta"), (None, "one two three four five"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_on_odd_rows(spark, odd):
    """Null ids, texts and sources, repeated rows, a very long text, and columns with the stages' own names."""
    rows = [(i, "you fool " * 3 if i % 4 == 3 else f"a kind word number {i}", "s") for i in range(40)]
    rows += [(50, None, "s"), (51, "", None), (None, None, None), (None, "no id here at all", "t"), (None, "no id here at all", "t")]
    rows += [(60, "same row twice over again", "t"), (60, "same row twice over again", "t"), (61, "say alpha beta gamma delta twice", "s"), (62, "one two three four five", None)]
    rows += [(70, "long " + " ".join(f"w{k}" for k in range(30_000)), "s")]
    docs = frame(spark, rows)
    for name in ("score", "class", "key", "words", "row", "copies", "number", "digest", "h", "id", "own_id", "own_text", "__own_id", "__own_text", "__id", "__text", "__words", "a.b"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, odd), f"odd-{name}")
        assert docs.columns == columns + (["n_bytes", "shard", "shard_bytes"] if name == "sharding" else [])
        held = [r.text for r in docs.collect()]
        sizes.append(len(held))
        assert not any("fool" in (t or "") for t in held)
        if name == "ngram_jaccard_join":
            assert held.count("same row twice over again") == held.count("no id here at all") == 1
            assert held.count(None) == 2
        if name == "benchmark_decontamination":
            assert not any("alpha" in (t or "") or t == "one two three four five" for t in held)
        assert {r["score"] for r in docs.collect()} == {"own score"}
    assert sizes[0] >= 38  # words that no label has seen may go either way
    assert sizes[-1] == sizes[-2]


def test_stages_on_an_empty_table(spark, odd):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, odd), f"empty-{name}")
        assert docs.isEmpty()


def test_run_agrees_with_itself(spark):
    one, two = (sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert one == two
