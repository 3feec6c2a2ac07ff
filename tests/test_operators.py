"""Operators against numpy and against properties that they must have."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.functions import columns as C
from netloom.operators import balancing, encoding, evaluation, federated, filters, fleet, network, projection, ranking, scaling, selection, splitting
from netloom.plans import training
from netloom.sources import sinks


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"id": range(400), "a": rng.random(400) * 9, "b": rng.integers(0, 5, 400).astype(float), "c": 1.0})
    frame["type"] = np.where(frame.a > 6, "dos", np.where(frame.b > 3, "xss", "normal"))
    return spark.createDataFrame(frame), frame


def test_chi2_uses_value_sums(toy):
    df, frame = toy
    got = {r.feature: r.score for r in selection.chi2(df, ["a", "b", "c"], "type").collect()}
    for c in ("a", "b", "c"):
        o = frame.groupby("type")[c].sum().to_numpy()
        e = frame.groupby("type").size().to_numpy() / len(frame) * o.sum()
        assert got[c] == pytest.approx(((o - e) ** 2 / e).sum())


def test_top_k_ties_go_to_later_columns(spark):
    scores = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0), ("c", 2, None), ("d", 3, 0.5)], "feature string, idx int, score double")
    assert [r.feature for r in selection.top_k(scores, 1).collect()] == ["b"]
    assert [r.feature for r in selection.top_k(scores, 3).collect()] == ["a", "b", "d"]


def test_continuous_information():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    assert selection.knn_information(rng.standard_normal(4000), y) < 0.02
    assert selection.knn_information(y * 10 + rng.standard_normal(4000), y) == pytest.approx(np.log(2), abs=0.02)


def test_continuous_information_over_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGE_ROWS", 37)
    monkeypatch.setattr(selection, "PIECE", 10)
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"type": rng.choice(["a", "b", "c", "few"], 900, p=[0.6, 0.3, 0.09, 0.01])})
    frame["x"] = rng.standard_normal(900) + 2 * (frame.type == "a") + 9 * (frame.type == "few")
    frame["y"] = rng.exponential(100, 900)
    frame["tied"] = np.where(frame.type == "b", 4.0, rng.integers(0, 5, 900))
    frame["same"] = 0.1
    frame.loc[900] = ["alone", 0.0, 5.0, 1.0, 0.1]
    columns = ["x", "y", "tied", "same"]
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 0.1), ("a", None, None, None, None)], "type string, x double, y double, tied double, same double"))
    got = {r.feature: r.score for r in selection.mi_continuous(df, columns, "type").collect()}
    for c in columns[:2]:
        assert got[c] == pytest.approx(selection.knn_information(frame[c].to_numpy(), frame.type.to_numpy()), abs=1e-6)
    for c in columns[2:]:
        tries = [selection.knn_information(frame[c].to_numpy(), frame.type.to_numpy(), seed=s) for s in range(9)]
        assert min(tries) - 0.02 <= got[c] <= max(tries) + 0.02
    assert {r.feature: r.score for r in selection.mi_continuous(df.repartition(5), columns, "type").collect()} == pytest.approx(got, abs=1e-9)


def test_continuous_information_queries_cover_the_table(spark, monkeypatch):
    from netloom.plans import queries

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice", "l_returnflag").toPandas()
    got = {r.feature: r.score for r in queries.QUERIES["mi_continuous"](spark, sf).collect()}
    every = selection.knn_information(table.l_extendedprice.to_numpy(float), table.l_returnflag.to_numpy())
    assert got["l_extendedprice"] == pytest.approx(every, abs=5e-4)
    asked = []
    monkeypatch.setattr(selection, "sample_n", lambda df, n, *rest: asked.append(n) or splitting.sample_n(df, n, *rest))
    assert queries.QUERIES["mi_continuous"](spark, "/root/testdata/sf0.001").count() == 4
    assert asked == []
    assert queries.QUERIES["stability_selection"](spark, "/root/testdata/sf0.001").count() >= 2
    assert asked == [200_000] * 3


def test_stability_keeps_informative(toy):
    df, _ = toy
    kept = [r.feature for r in selection.stable_features(df, ["a", "b", "c"], "type", top=2).collect()]
    assert set(kept) == {"a", "b"}


def test_split_is_a_partition_with_exact_sizes(toy):
    df, frame = toy
    out = splitting.train_val_test(df, "type", ["id"]).toPandas()
    assert sorted(out.id) == sorted(frame.id)
    assert out.part.value_counts().to_dict() == {"train": 240, "val": 80, "test": 80}
    again = splitting.train_val_test(df.repartition(7), "type", ["id"]).toPandas()
    assert out.set_index("id").part.to_dict() == again.set_index("id").part.to_dict()


@pytest.mark.parametrize("k", [1, 3, 5, 7])
def test_shards_differ_by_one_at_most(spark, k):
    sizes = splitting.shards(spark.range(23), k, ["id"]).groupBy("device_id").count().orderBy("device_id").collect()
    assert [r["count"] for r in sizes] == [len(x) for x in np.array_split(np.arange(23), k)]


def test_ranks_match_a_global_sort(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    got = ranking.with_hash_rank(df, ["id"], ["g"]).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


def test_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("Z",)], "v string")
    codes = encoding.fit_codes(train, "v")
    assert [(r.value, r.code) for r in codes.orderBy("code").collect()] == [("Z", 1), ("a", 2), ("b", 3), ("é", 4)]
    marked = {r.value: r.code for r in encoding.fit_codes_with_unknown(train, "v").collect()}
    assert marked == {"Z": 0, "__UNK__": 1, "a": 2, "b": 3, "é": 4}
    test = spark.createDataFrame([("a",), ("new",), (None,)], "v string")
    assert [r.code for r in encoding.apply_codes(test, "v", codes, "code").collect()] == [2, 0, 0]
    assert sorted(r.code for r in encoding.apply_codes_with_unknown(test, "v", encoding.fit_codes_with_unknown(train, "v"), "code").collect()) == [1, 1, 2]


def test_scaling_keeps_outside_values(spark):
    train = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "x double, k double")
    fitted = scaling.fit_min_max(train, ["x", "k"])
    out = scaling.apply_min_max(spark.createDataFrame([(20.0, 7.0)], "x double, k double"), ["x", "k"], fitted).first()
    assert (out.x, out.k) == (2.0, 2.0)
    z = scaling.apply_z(spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double"), ["x"], scaling.fit_z(spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double"), ["x"]))
    assert sorted(r.x for r in z.collect()) == pytest.approx([-1.2247448, 0, 1.2247448])


def test_smote_balances_within_classes(toy):
    df, frame = toy
    for chunk in (5000, 40):
        out = balancing.smote(df, ["a", "b"], "type", "id", chunk=chunk).toPandas()
        assert set(out.groupby("type").size()) == {frame.type.value_counts().max()}
        made, own = out[out.synthetic], out[~out.synthetic]
        for t, part in made.groupby("type"):
            real = own[own.type == t][["a", "b"]]
            assert (part[["a", "b"]].min() >= real.min()).all()
            assert (part[["a", "b"]].max() <= real.max()).all()
    weights = balancing.class_weights(balancing.smote(df, ["a", "b"], "type", "id"), "type").collect()
    assert {r.weight for r in weights} == {1.0}


def test_smote_neighbours_come_from_the_whole_class(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"id": range(160), "a": rng.standard_normal(160), "b": rng.standard_normal(160), "type": ["most"] * 100 + ["some"] * 47 + ["few"] * 13})
    df = spark.createDataFrame(frame)
    outs = [balancing.smote(df.repartition(n), ["a", "b"], "type", "id", chunk=chunk).toPandas() for n, chunk in ((1, 5000), (3, 4))]
    one, two = (out.sort_values(["type", "synthetic", "a", "b"]).reset_index(drop=True) for out in outs)
    pd.testing.assert_frame_equal(one, two)
    assert set(two.groupby("type").size()) == {100}
    for t, part in two[two.synthetic].groupby("type"):
        x = frame[frame.type == t][["a", "b"]].to_numpy()
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        start = np.repeat(x, 5, axis=0)
        way = x[np.argsort(d, axis=1)[:, :5].ravel()] - start
        for row in part[["a", "b"]].to_numpy():
            share = np.clip(((row - start) * way).sum(1) / (way**2).sum(1), 0, 1)
            assert np.abs(start + share[:, None] * way - row).sum(1).min() < 1e-9


def test_smote_skips_single_rows(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 1.0, "a"), (3, 5.0, "b")], "id long, x double, type string")
    assert balancing.smote(df, ["x"], "type", "id").count() == 3


def test_filters(spark):
    df = spark.createDataFrame([("mitm", 1), (None, 2), ("dos", 3)], "type string, n int")
    assert sorted(r.n for r in filters.exclude_classes(df, "type", ["mitm"]).collect()) == [2, 3]
    with pytest.raises(ValueError, match="has nulls"):
        filters.require_classes(df, "type")
    with pytest.raises(ValueError, match="missing columns"):
        filters.require_columns(df, ["label"])
    with pytest.raises(ValueError, match="dos"):
        filters.require_seen_classes(df.filter("n = 1"), df.filter("n = 3"), "type")
    with pytest.raises(ValueError, match="missing"):
        projection.restrict(df, ["x", "y"])
    assert filters.drop_rare_classes(df.union(df).union(df.filter("n = 3")), "type", 3).count() == 3


def test_rows_stay_where_they_are_without_rare_classes(spark):
    """A class of nearly all rows isn't one task's afterwards; nulls are a class."""
    df = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") < 2, "few").when(F.col("id") > 3, "most").alias("type"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = filters.drop_rare_classes(df, "type", 3)
        assert sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) == [246, 250, 250, 250]
        assert filters.drop_rare_classes(df, "type", 2).count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_vectors_and_columns(spark):
    df = spark.createDataFrame([("a", 1.5, 2)], "s string, x double, n long")
    row = df.select(projection.vector(["x", "n"]).alias("v")).select("v", projection.sequence_of(F.col("v")).alias("s"), projection.tokens_of(F.col("v")).alias("t")).first()
    assert (row.v, row.s, row.t) == ([1.5, 2.0], [[1.5, 2.0]], [[1.5], [2.0]])
    assert projection.downcast(df).dtypes == [("s", "string"), ("x", "float"), ("n", "int")]
    assert projection.split_columns_by_type(df) == (["s"], ["x", "n"])
    assert projection.split_columns_by_type(df, all_categorical=True) == (["s", "x", "n"], [])
    assert projection.label_column(df.withColumn("Label", F.lit(1)).withColumn("type", F.lit("a"))) in ("Label", "label")


def test_network_matches_its_gradient():
    rng = np.random.default_rng(1)
    x, y, p = rng.standard_normal((8, 3)), rng.integers(0, 2, 8).astype(float), network.start(3)
    loss = lambda q: (np.logaddexp(0, z := network.logits(q, x)[0]) - y * z).mean()
    step = network.Training(p, rate=1e-3)
    before = loss(p)
    for _ in range(50):
        step.update(x, y)
    assert loss(step.p) < before
    assert sum(w.size for w in p) == 64 * 3 + 64 + 2080 + 33


def test_federated_rounds(spark, toy, tmp_path):
    from netloom.sources.sinks import write_round

    df, _ = toy
    shards = splitting.shards(df.withColumn("label", (F.col("type") != "normal").cast("int")), 5, ["id"])
    seen = []

    class Watch(federated.Strategy):
        def evaluate(self, number, weights):
            seen.append((number, weights.count()))

    calls = iter(range(100))
    weights = federated.run_rounds(shards, ["a", "b"], 2, lambda t, n: write_round(t, f"{tmp_path}/{next(calls)}", n), Watch())
    size = 64 * 2 + 64 + 2080 + 33
    assert seen == [(0, size), (1, size), (2, size)]
    assert weights.count() == size
    with pytest.raises(ValueError, match="clients"):
        federated.run_rounds(shards.filter("device_id = 1"), ["a", "b"], 1, lambda t, n: write_round(t, f"{tmp_path}/{next(calls)}", n))


def test_fedavg_weighs_by_samples(spark):
    w = spark.createDataFrame([(1, 0, 0, 1.0, 1), (2, 0, 0, 4.0, 3)], "client_id int, layer int, pos int, w double, n_samples long")
    assert federated.fedavg(w).first().w == pytest.approx(3.25)


def test_poisson_ticks_are_seeded(spark):
    ticks = spark.range(4000).select(F.lit("router-001").alias("router_id"), F.col("id").alias("tick"))
    a, b = (federated.attack_ticks(ticks).agg(F.avg("attacks"), F.var_pop("attacks")).first() for _ in range(2))
    assert a == b
    assert a[0] == pytest.approx(1, abs=0.06)
    assert a[1] == pytest.approx(1, abs=0.12)


def test_report_totals(spark):
    y = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    classes = evaluation.class_domain((y, "t"), (y, "p"))
    assert evaluation.confusion_matrix(y, "t", "p", classes).count() == 9
    rows = {r.label: r for r in evaluation.classification_report(y, "t", "p", classes).collect()}
    assert rows["accuracy"].f1 == 0.5
    assert rows["c"].precision == 0
    assert rows["macro avg"].support == 4


def test_last_report_of_a_round_counts(spark):
    reports = spark.createDataFrame([(1, "r1", 5, 1), (1, "r1", 2, 2), (1, None, 9, 3), (1, "r2", None, 4)], "round int, router_id string, n int, seq int")
    row = fleet.round_metrics(reports).first()
    assert (row.anomalies_by_router, row.total_anomalies) == ({"r1": 2}, 2)
    assert fleet.by_router(fleet.round_metrics(reports)).count() == 1
    counts = spark.createDataFrame([("r1", 1, 3), ("r1", 1, 3), ("r1", 2, 4)], "router_id string, round int, n int")
    assert [r.cumulative for r in fleet.cumulative(counts).orderBy("round").collect()] == [3, 7]


def test_best_path(spark):
    paths = spark.createDataFrame([("/x/model_old.keras", 1), ("/y/bilstm_prod.keras", 1), ("/z/bilstm_prod2.keras", 0)], "path string, modified long")
    assert fleet.best_paths(paths, ["bilstm", "prod"]).first().path == "/y/bilstm_prod.keras"


def test_training_pads_and_codes_unknowns(spark, toy):
    df, _ = toy
    df = df.withColumn("proto", F.when(F.col("id") % 2 == 0, "tcp").otherwise("-"))
    for unknown in (None, "__UNK__"):
        out, fitted = training.prepare(df.withColumnRenamed("a", " a "), "type", ["id"], ["proto"], ["a"], k=3, unknown=unknown)
        assert out.count() == 400
        assert len(fitted.features) == 3
        fresh = training.transform(spark.createDataFrame([("udp", 3.0)], "proto string, a double"), fitted, "type")
        assert fresh.count() == 1


# --- the small network, its losses and its rounds -------------------------------


def plain_network(weights, x):
    """Logits of n -> 64 -> 32 -> 1 by plain products, from (layer, pos, w) rows."""
    p = [np.zeros(s) for s in ((64, x.shape[1]), (64,), (32, 64), (32,), (1, 32), (1,))]
    for r in weights:
        p[r.layer].ravel()[r.pos] = r.w
    h = np.maximum(x @ p[0].T + p[1], 0)
    return (np.maximum(h @ p[2].T + p[3], 0) @ p[4].T + p[5])[:, 0]


def labelled(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.2).astype(int)
    rows = [(int(i % 3 + 1), *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "device_id int, a double, b double, c double, label int"), x, y


def test_scores_and_evaluation_match_plain_products(spark):
    df, x, y = labelled(spark)
    w = federated.initial(df, ["a", "b", "c"], 3)
    z = plain_network(w.collect(), x)
    p = 1 / (1 + np.exp(-z))
    got = federated.predict(df, w, ["a", "b", "c"]).collect()
    assert [r.probability for r in got] == pytest.approx(p.tolist())
    said = p > 0.5
    row = federated.evaluate(df, w, ["a", "b", "c"]).first()
    assert (row.tp, row.tn, row.fp, row.fn) == ((said & (y == 1)).sum(), (~said & (y == 0)).sum(), (said & (y == 0)).sum(), (~said & (y == 1)).sum())
    assert row.loss == pytest.approx(np.mean(np.log1p(np.exp(z)) - y * z))
    empty = federated.evaluate(df.limit(0), w, ["a", "b", "c"]).first()
    assert (empty.tp, empty.loss) == (0, None)


def test_a_round_matches_plain_adam(spark):
    """Batches in the order of the rows' hashes, gradients by differences for the first batch, weights averaged by rows."""
    df, x, y = labelled(spark, 150)
    names = ["a", "b", "c"]
    w = federated.initial(df, names, 1)
    fits = federated.train_local(df, w, names, seed=5)
    again = federated.train_local(df.repartition(3), w, names, seed=5)
    other = federated.train_local(df, w, names, seed=6)
    table = lambda t: {(r.client_id, r.layer, r.pos): r.w for r in t.collect()}
    assert table(fits) == table(again)
    assert table(fits) != table(other)
    p0 = network.unflat([(r.layer, r.pos, r.w) for r in w.collect()], 3)
    keyed = df.filter("device_id = 2").withColumn("k", ranking.hash_key([*names, "label"], 5)).orderBy("k").collect()
    training = network.Training(p0)
    xs, ys = np.array([[r.a, r.b, r.c] for r in keyed]), np.array([r.label for r in keyed], float)
    for i in range(0, len(xs), network.BATCH):
        training.update(xs[i : i + network.BATCH], ys[i : i + network.BATCH])
    own = {(layer, pos): v for layer, pos, v in network.flat(training.p)}
    assert {(k[1], k[2]): v for k, v in table(fits).items() if k[0] == 2} == pytest.approx(own)
    # The first step of Adam moves each weight by the rate against the sign of its slope.
    step = network.Training(p0)
    step.update(xs, ys)
    loss = lambda p: network.loss_of(network.logits(p, xs)[0], ys).mean()
    for layer, pos in ((0, 4), (1, 7), (2, 100), (3, 3), (4, 5), (5, 0)):
        up, down = [v.copy() for v in p0], [v.copy() for v in p0]
        up[layer].ravel()[pos] += 1e-5
        down[layer].ravel()[pos] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        if abs(slope) > 1e-6:
            assert step.p[layer].ravel()[pos] - p0[layer].ravel()[pos] == pytest.approx(-network.RATE * np.sign(slope), rel=1e-2)
    mean = {(r.layer, r.pos): r.w for r in federated.fedavg(fits).collect()}
    rows = {d: n for d, n in df.groupBy("device_id").count().collect()}
    held = table(fits)
    assert mean[0, 4] == pytest.approx(sum(held[d, 0, 4] * n for d, n in rows.items()) / sum(rows.values()))


def test_watch_stops_and_slows():
    w = federated.Watch(patience=3, rate_patience=2, rate=0.1)
    assert [w.stops(k + 1, x) for k, x in enumerate([1.0, 0.5, 0.49999, 0.6, 0.7, 0.6])] == [False] * 5 + [True]
    assert w.best == 3
    assert w.rate == pytest.approx(0.025)


def test_rounds_return_the_best_weights(spark, tmp_path):
    df, _, _ = labelled(spark, 120)
    names, losses = ["a", "b", "c"], []

    class Seen(federated.Strategy):
        def evaluate(self, number, weights):
            losses.append(federated.evaluate(df, weights, names).first().loss)

    n = iter(range(100))
    out = federated.run_rounds(df, names, 2, lambda t, number: sinks.write_round(t, str(tmp_path / str(next(n))), number), Seen(), watch=federated.Watch(2, 2), validation=df)
    assert federated.evaluate(df, out, names).first().loss == pytest.approx(min(losses[1:]))


def test_poisson_draws_are_not_cut():
    for rate in (0.5, 1.0, 30.0, 300.0):
        totals = federated.poisson_totals(rate)
        assert totals[-1] == pytest.approx(1, abs=1e-12)
        assert sum(1 - t for t in totals) == pytest.approx(rate, rel=1e-6)


def test_focal_loss_and_softmax(spark):
    scores = [[1000.0, 999.0, -5.0], [0.0, 0.0, 0.0], [-2.0, 3.0, 1.0]]
    df = spark.createDataFrame([(s, k) for k, s in enumerate(scores)], "s array<double>, y int")
    rows = df.select("y", C.softmax(F.col("s")).alias("p"), C.focal_loss(C.softmax(F.col("s")), F.col("y"), F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), 2.0).alias("l")).collect()
    for r, s in zip(rows, scores, strict=True):
        e = np.exp(np.array(s) - max(s))
        p = e / e.sum()
        assert r.p == pytest.approx(p.tolist())
        assert r.l == pytest.approx(-(0.5, 1.0, 2.0)[r.y] * (1 - p[r.y]) ** 2 * np.log(p[r.y]))


def test_small_sample_is_the_head_of_the_hash_order(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    whole = [r.k for r in df.orderBy(ranking.hash_key(["k"], 42)).collect()]
    for n in (1, 70, 5000, 6000):
        assert sorted(r.k for r in splitting.sample_n(df, n, ["k"]).collect()) == sorted(whole[:n])


@pytest.mark.parametrize("equal", [False, True])
def test_splits_rank_only_rows_near_their_limits(spark, monkeypatch, equal):
    """The parts are those of ranks over all rows, and few rows are sorted for them."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("type"), (F.lit(1) if equal else F.col("id") * 3).alias("x"))
    columns = ["x", "id"] if equal else ["x"]
    ranks = {(r.type, r.id): r["rank"] for r in ranking.with_hash_rank(rows, columns, ["type"]).collect()}
    # No rank over the whole table.
    monkeypatch.setattr(splitting, "with_hash_rank", None)
    got = splitting.train_val_test(rows, "type", columns)
    found = got.collect()
    assert len(found) == 30_000
    for name, n in (("a", 21_000), ("b", 6_000), (None, 3_000)):
        parts = [r.part for r in sorted((r for r in found if r.type == name), key=lambda r: ranks[name, r.id])]
        assert parts == ["test"] * (n // 5) + ["val"] * (n // 5) + ["train"] * (n * 3 // 5)


def test_numbers_are_not_read_from_text_again(spark):
    values = [0.1, -0.0, 1e-300, 1.5e300, 123456789.123, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v, i, str(v), float(i) / 3) for i, v in enumerate(values)], "d double, n long, t string, f float")
    clean = projection.clean_features(df, [], ["d", "n", "t", "f"])
    as_text = projection.clean_features(df.select(*[F.col(c).cast("string") for c in df.columns]), [], ["d", "n", "t", "f"])
    assert [tuple(r) for r in clean.collect()] == [tuple(r) for r in as_text.collect()]
    assert "RLIKE" not in clean.select("d", "n")._jdf.queryExecution().optimizedPlan().toString()


def test_continuous_information_exchanges_little_between_ranges(spark, monkeypatch):
    """A range is one row; only windows at its ends ask other ranges, and the counts are those over all points."""
    monkeypatch.setattr(selection, "RANGE_ROWS", 500)
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"type": rng.choice(["a", "b", "rare"], 4000, p=[0.6, 0.399, 0.001]), "x": rng.standard_normal(4000)})
    points, sizes = selection._points(spark.createDataFrame(frame), ["x"], "type", 3, 42)
    bounds = selection._bounds(points)
    packed = selection._packed(points, bounds, 3)
    counted = selection._counted(packed, bounds, 3)
    assert packed.count() == 8 and packed.agg(F.sum("n")).first()[0] == 4000
    assert 0 < counted.filter("to IS NOT NULL").count() < 200
    found = selection._others(packed, counted).first()
    own = points.toPandas()
    line, around = np.sort(own.x), np.zeros(4000)
    for code in own.code.unique():
        at = np.flatnonzero(own.code == code)
        gaps = np.sort(np.abs(own.x.to_numpy()[at][:, None] - own.x.to_numpy()[at][None]), axis=1)
        reach = gaps[:, min(3, len(at) - 1)] * (1 - 1e-9)
        around[at] = np.searchsorted(line, own.x.to_numpy()[at] + reach, "right") - np.searchsorted(line, own.x.to_numpy()[at] - reach, "left")
    assert found.n == 4000 and found.others == pytest.approx(selection._digamma(around).sum(), rel=1e-9)
