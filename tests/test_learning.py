"""Networks against differences and plain loops, distributed training against one process, transfer, tables of parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import classifiers as K
from netloom.operators import learning
from netloom.operators.federated import Watch

SMALL = {
    "se_dwnet": ("se_dwnet", 9, {"stem": 4, "stages": ((4, 1), (6, 2), (8, 2)), "rate": 0.2}),
    "resnet_mlp": ("resnet_mlp", 7, {"width": 6}),
    "with attention": ("resnet_mlp", 5, {"width": 6, "heads": 2, "key_size": 3, "attention_rate": 0.1}),
    "bilstm": ("bilstm", 8, {"units": (4, 3, 2), "width": 5, "steps": 4}),
}
LOSSES = [K.Loss(), K.Loss(smoothing=0.1), K.Loss(gamma=2.0, alpha=[0.5, 1, 3]), K.Loss(weights=[1, 2, 0.5])]


def small(name, classes=3):
    builder, inputs, options = SMALL[name]
    return K.Network(builder, inputs, classes, options)


@pytest.mark.parametrize("name", SMALL)
@pytest.mark.parametrize("loss", LOSSES)
def test_slopes_agree_with_differences(name, loss):
    """Every parameter of every layer type: convolutions, gates, normalisations, recurrent and attention layers, and the loss."""
    rng, network = np.random.default_rng(0), small(name)
    params = {k: v + (0 if K.moving(k) else rng.normal(0, 0.05, v.shape)) for k, v in network.start(1).items()}
    x, y = rng.normal(size=(6, network.inputs)), rng.integers(0, 3, 6)
    own = K.batch_sums(network, params, x, y, loss, [3, 4]).slopes
    assert set(own) == {k for k in params if not K.moving(k)}
    for k, g in own.items():
        for _ in range(2):
            at, moved = tuple(rng.integers(0, n) for n in g.shape), []
            for step in (1e-5, -1e-5):
                other = {n: v.copy() for n, v in params.items()}
                other[k][at] += step
                moved.append(K.batch_sums(network, other, x, y, loss, [3, 4]).loss)
            assert (moved[0] - moved[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=2e-7), k


def test_recurrent_layers_agree_with_loops_over_gates():
    network = small("bilstm")
    p, rng = network.start(5), np.random.default_rng(2)
    p = {k: v + rng.normal(0, 0.1, v.shape) * (not K.moving(k)) for k, v in p.items()}
    x = rng.normal(size=8)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def way(layer, rows, n):
        h, c, out = np.zeros(n), np.zeros(n), []
        for row in rows:
            z = row @ p[f"{layer}/kernel"] + h @ p[f"{layer}/recurrent"] + p[f"{layer}/bias"]
            for j in range(n):
                c[j] = sig(z[n + j]) * c[j] + sig(z[j]) * np.tanh(z[2 * n + j])
            h = np.array([sig(z[3 * n + j]) * np.tanh(c[j]) for j in range(n)])
            out.append(h)
        return out

    norm = lambda layer, v: v / np.sqrt(1 + 1e-3) * p[f"{layer}/gamma"] + p[f"{layer}/beta"]
    rows = x.reshape(4, 2)
    for k, n in enumerate((4, 3)):
        ahead, back = way(f"lstm{k}/ahead", rows, n), way(f"lstm{k}/back", rows[::-1], n)[::-1]
        rows = np.array([norm(f"lstm{k}/norm", np.concatenate(pair)) for pair in zip(ahead, back, strict=True)])
    last = norm("lstm2/norm", np.concatenate([way("lstm2/ahead", rows, 2)[-1], way("lstm2/back", rows[::-1], 2)[-1]]))
    z = np.maximum(last @ p["dense/kernel"] + p["dense/bias"], 0) @ p["head/kernel"] + p["head/bias"]
    assert network.probabilities(p, x[None])[0] == pytest.approx(np.exp(z) / np.exp(z).sum())


def test_convolutional_network_agrees_with_loops():
    network = small("se_dwnet")
    p, rng = network.start(5), np.random.default_rng(2)
    p = {k: (np.abs(v + rng.normal(0, 0.1, v.shape)) if k.endswith("variance") else v + rng.normal(0, 0.1, v.shape)) for k, v in p.items()}
    x = rng.normal(size=9)

    def taps(rows, width, stride):
        n, outputs = len(rows), -(-len(rows) // stride)
        before = max(0, (outputs - 1) * stride + width - n) // 2
        at = lambda i: rows[i] if 0 <= i < n else np.zeros(rows.shape[1])
        return [[at(o * stride + k - before) for k in range(width)] for o in range(outputs)]

    def norm(layer, rows):
        return (rows - p[f"{layer}/mean"]) / np.sqrt(p[f"{layer}/variance"] + 1e-3) * p[f"{layer}/gamma"] + p[f"{layer}/beta"]

    def conv(layer, rows, width, stride=1):
        return np.array([sum(t @ p[f"{layer}/kernel"][k] for k, t in enumerate(own)) for own in taps(rows, width, stride)]) + p[f"{layer}/bias"]

    def separable(layer, rows, stride=1):
        deep = np.array([sum(t * p[f"{layer}/depthwise"][k] for k, t in enumerate(own)) for own in taps(rows, 3, stride)])
        return deep @ p[f"{layer}/kernel"] + p[f"{layer}/bias"]

    rows = np.maximum(norm("stem/norm", conv("stem/conv", x[:, None], 3)), 0)
    for k, (filters, stride) in enumerate(((4, 1), (6, 2), (8, 2))):
        s = f"stage{k}"
        past = rows if stride == 1 and rows.shape[1] == filters else norm(f"{s}/past_norm", conv(f"{s}/past", rows, 1, stride))
        y = norm(f"{s}/norm2", separable(f"{s}/conv2", np.maximum(norm(f"{s}/norm1", separable(f"{s}/conv1", rows, stride)), 0)))
        gate = 1 / (1 + np.exp(-np.maximum(y.mean(0) @ p[f"{s}/gate/down/kernel"], 0) @ p[f"{s}/gate/up/kernel"]))
        rows = np.maximum(y * gate + past, 0)
    z = rows.mean(0) @ p["head/kernel"] + p["head/bias"]
    assert network.probabilities(p, x[None])[0] == pytest.approx(np.exp(z) / np.exp(z).sum())


def test_full_sizes_and_unknown_names():
    count = lambda net: sum(v.size for v in net.start().values())
    assert count(K.Network("bilstm", 25, 8)) > count(K.Network("bilstm", 25, 8, {"units": (64, 64, 32)}))
    assert K.Network("se_dwnet", 25, 8).start()["stage2/conv2/kernel"].shape == (256, 256)
    assert K.Network("resnet_mlp", 25, 8, {"heads": 4}).start()["columns/query/kernel"].shape == (1, 32)
    with pytest.raises(ValueError, match="se_dwnet"):
        K.Network("transformer", 3, 2)


def blobs(spark, n=600, classes=3, inputs=9, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = np.random.default_rng(9).normal(size=(8, inputs))[y] * 1.2 + rng.normal(size=(n, inputs))
    rows = [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))]
    names = [f"x{k}" for k in range(inputs)]
    return spark.createDataFrame(rows, "id long, label int, " + ", ".join(f"{c} double" for c in names)), names


@pytest.mark.parametrize("name", ["se_dwnet", "bilstm"])
def test_training_equals_one_process_for_any_number_of_partitions(spark, name):
    network = K.Network(name, 8, 3, SMALL[name][2])
    df, names = blobs(spark, 230, inputs=8)
    df = df.unionByName(df.limit(1).select("id", F.lit(None).cast("int").alias("label"), *names))
    dealt = learning.deal(df, names, "label", micro=16, batch=64, seed=4)
    assert (dealt.rows, dealt.micros, dealt.steps) == (230, 15, 4)
    loss, start = K.Loss(gamma=2.0, alpha=[1.0, 2.0, 0.5]), network.start(3)
    params, adam, history = start, K.Adam(0.01, 1.0), []
    for epoch in (1, 2):
        lost = 0.0
        for k in np.random.default_rng([6, epoch]).permutation(4).tolist():
            sums = [K.batch_sums(network, params, np.array(r.x), np.array(r.y), loss, [(6 << 32) + adam.step, r.micro]) for r in dealt.step(k).collect()]
            whole = K.Sums(sum(s.rows for s in sums), sum(s.loss for s in sums), {n: sum(s.slopes[n] for s in sums) for n in sums[0].slopes}, {n: sum(s.batch[n] for s in sums) for n in sums[0].batch})
            params = K.apply(params, whole, adam, 0.9)
            lost += whole.loss
        history.append(lost / 230)
    for tasks in (1, 3, 7):
        got = learning.train(dealt, network, start, loss, 2, 0.01, 1.0, seed=6, tasks=tasks, momentum=0.9)
        assert [h[1] for h in got.history] == pytest.approx(history, rel=1e-9)
        assert all(np.allclose(got.params[k], v, rtol=1e-6, atol=1e-9) for k, v in params.items())


def test_sums_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(learning, "FAN", 2)
    network = small("resnet_mlp")
    df, names = blobs(spark, 100, inputs=7)
    dealt = learning.deal(df, names, "label", micro=8, batch=200)
    one, many = (learning.train(dealt, network, network.start(), K.Loss(), 1, 0.01, tasks=t).history[0][1] for t in (1, 7))
    assert one == pytest.approx(many, rel=1e-9)


def test_learns_and_transfers_to_other_classes(spark):
    df, names = blobs(spark, 900, 5)
    parts = df.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(4)))
    few, held = parts.filter("held > 0 AND label < 3"), parts.filter("held = 0")
    network = K.Network("se_dwnet", 9, 3, {"stem": 6, "stages": ((6, 1), (8, 2)), "rate": 0.0})
    loss = learning.focal_loss_of(few, "label", 3)
    assert len(loss.alpha) == 3 and min(loss.alpha) >= 0.5
    dealt = learning.deal(few, names, "label", 32, 128)
    base = learning.train(dealt, network, network.start(), loss, 8, 0.02, 1.0, momentum=0.8, watch=Watch(3, 2, 0.02), validation=(held.filter("label < 3"), names, "label"))
    losses = [h[2] for h in base.history]
    assert learning.mean_loss(held.filter("label < 3"), network, base.params, names, "label", loss) == pytest.approx(min(losses))
    right = lambda model, rows: rows.join(learning.predict(rows, model, names).select("id", F.expr("array_position(probabilities, array_max(probabilities)) - 1").alias("said")), "id").agg(F.avg((F.col("label") == F.col("said")).cast("int"))).first()[0]
    assert right(base, held.filter("label < 3")) > 0.7
    kept = {}
    every = learning.deal(parts.filter("held > 0"), names, "label", 32, 128)
    first, second = learning.transfer(base, every, 5, learning.weighted_loss_of(parts.filter("held > 0"), "label", 5), 2, 5, momentum=0.8, rates=(0.03, 0.01), keep=lambda k, p: kept.setdefault(k, p))
    assert second.network.head == K.TRANSFER_HEAD and second.params["transfer_head/kernel"].shape[1] == 5
    for k, v in first.params.items():
        if K.layer_of(k) != K.TRANSFER_HEAD:
            assert (v == base.params[k]).all() and not (second.params[k] == v).all(), k
    assert sorted(kept) == list(range(1, 8))
    assert right(second, held) > max(0.6, right(first, held) - 0.05)


def test_parameters_go_through_a_table(spark):
    network = small("bilstm")
    params = network.start(2)
    table = learning.to_table(spark, params, 1).unionByName(learning.to_table(spark, network.start(3), 2))
    back = learning.from_table(table, network, 1)
    assert all((back[k] == v).all() for k, v in params.items())
    with pytest.raises(ValueError, match="another network"):
        learning.from_table(table, small("resnet_mlp"), 1)


def test_scoring_odd_rows(spark):
    network = small("resnet_mlp")
    model = learning.Trained(network, network.start())
    names = [f"x{k}" for k in range(7)]
    rows = [(1, *[0.5] * 7), (1, *[0.5] * 7), (2, None, *[0.0] * 6), (3, float("nan"), *[0.0] * 6)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names)).withColumns({"probabilities": F.lit("old"), "a.b": F.lit(1)})
    got = learning.predict(df, model, names)
    assert sorted(got.columns) == sorted(df.columns)
    own = [tuple(r.probabilities) for r in got.orderBy("id").collect()]
    assert own[0] == own[1] and own[2] == pytest.approx(own[3]) and sum(own[0]) == pytest.approx(1)
    assert learning.predict(df.limit(0), model, names).count() == 0
    empty = learning.deal(df.withColumn("label", F.lit(0)).limit(0), names, "label")
    assert learning.train(empty, network, model.params, K.Loss(), 3, 0.1).params is model.params


@pytest.mark.parametrize("name", SMALL)
def test_scoring_takes_a_bounded_number_of_rows_at_once(name, monkeypatch):
    network, sizes = small(name), []
    params, x = network.start(1), np.random.default_rng(3).normal(size=(1000, network.inputs))
    whole = K.slopes.softmax(network.logits(K.Scope(params), x)).value
    logits = K.Network.logits
    monkeypatch.setattr(K.Network, "logits", lambda self, s, part: sizes.append(len(part)) or logits(self, s, part))
    assert network.probabilities(params, x) == pytest.approx(whole)
    y = np.arange(1000) % 3
    assert learning._lost(network, params, x, y, K.Loss()) == pytest.approx(-np.log(whole[np.arange(1000), y]).sum())
    assert max(sizes) <= 256 and sum(sizes) == 2000


def test_steps_are_read_without_a_shuffle(spark, monkeypatch):
    """Micro-batches lie in files by task; a step over them is one stage."""
    network, plans = small("resnet_mlp"), []
    df, names = blobs(spark, 100, inputs=7)
    dealt = learning.deal(df, names, "label", micro=8, batch=200)
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().toString()) or collect(self))
    learning.train(dealt, network, network.start(), K.Loss(), 1, 0.01)
    monkeypatch.undo()
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "Exchange" not in plans[0]
    files = {r.file for r in dealt.step(0).select(F.input_file_name().alias("file")).collect()}
    assert len(files) > 1 and dealt.step(0).select("micro").distinct().count() == dealt.step(0).count() == dealt.micros


def test_tasks_of_a_step_have_as_much_to_do(spark):
    """A file for each task, of as many micro-batches but for one, however steps and tasks were dealt."""
    df, names = blobs(spark, 1000, inputs=7)
    dealt = learning.deal(df, names, "label", micro=8, batch=125)
    assert dealt.micros == 125 and dealt.steps == 8
    for k in range(8):
        step = dealt.step(k)
        assert step.columns == ["micro", "x", "y"]
        sizes = [r["count"] for r in step.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= 1


def test_letter_shares_in_one_pass(spark, tmp_path):
    """As by replacing each letter, for letters of one and two bytes, other alphabets, nulls and long texts."""
    from netloom.functions.letters import LETTERS
    from netloom.plans import queries

    texts = [None, "", "É", "ÃéÃ", "Ünder Straße ŉ ÿ Ā", "日本é語𝄞a", "\x00zé\x7f", "aé" * 700_000, "Ñ" + "é" * 1_048_577, "İI"]
    spark.createDataFrame([(str(i % 3), t) for i, t in enumerate(texts)], "lang string, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got, names = queries.letter_shares(spark, str(tmp_path))
    low = F.lower(F.coalesce("text", F.lit("")))
    size = F.greatest(F.length(low), F.lit(1))
    shares = [(F.lit(1000.0) * (F.length(low) - F.length(F.replace(low, F.lit(c)))) / size).alias(n) for c, n in zip(LETTERS, names, strict=True)]
    expected = spark.read.parquet(f"{tmp_path}/documents.parquet").select("lang", *shares)
    assert got.columns == expected.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("name", SMALL)
def test_micro_batches_below_one_another_add_up(name):
    """Statistics and dropout stay those of each micro-batch."""
    network, rng, loss = small(name), np.random.default_rng(4), K.Loss(weights=[1, 2, 0.5])
    params, x, y = network.start(1), rng.normal(size=(15, network.inputs)), rng.integers(0, 3, 15)
    seeds = [[7, k] for k in range(3)]
    own = [K.batch_sums(network, params, x[k * 5 : k * 5 + 5], y[k * 5 : k * 5 + 5], loss, seeds[k]) for k in range(3)]
    got = K.group_sums(network, params, x, y, loss, seeds)
    assert got.rows == 15 and got.loss == pytest.approx(sum(s.loss for s in own))
    for part in ("slopes", "batch"):
        assert set(getattr(got, part)) == set(getattr(own[0], part))
        for k, v in getattr(got, part).items():
            assert np.allclose(v, sum(getattr(s, part)[k] for s in own), rtol=1e-9, atol=1e-12), k


def test_few_micro_batches_are_held_at_once():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    sizes = [int(n) for n in rng.choice([63, 64], 50)] + [300]
    x, y = ([rng.normal(size=(n, 2)).tolist() for n in sizes], [list(range(n)) for n in sizes])
    whole = pa.RecordBatch.from_arrays([pa.array(range(51)), pa.array(x), pa.array(y, pa.list_(pa.int32()))], ["micro", "x", "y"])
    groups = list(learning._groups(iter([whole.slice(0, 20), whole.slice(20)])))
    assert sorted(micro for group in groups for micro, _, _ in group) == list(range(51))
    assert all(len({len(labels) for _, _, labels in group}) == 1 for group in groups)
    assert all(sum(len(labels) for _, _, labels in group) <= 256 for group in groups if len(group) > 1)
    assert len(groups) <= 50 // 4 + 3
    for micro, values, labels in (t for group in groups for t in group):
        assert (values == np.array(x[micro])).all() and labels.tolist() == y[micro]


def test_recurrent_layers_are_one_piece(monkeypatch):
    """As many values for eight steps as for two, though each is a loop over the steps."""
    counts, start = [], K.slopes.Var.__init__
    for steps in (2, 8):
        network = K.Network("bilstm", 8, 3, {"units": (4, 3, 2), "width": 5, "steps": steps})
        params = network.start()
        made = []
        monkeypatch.setattr(K.slopes.Var, "__init__", lambda self, *a, made=made: made.append(1) or start(self, *a))
        K.batch_sums(network, params, np.ones((6, 8)), np.arange(6) % 3, K.Loss(), [1])
        counts.append(len(made))
    assert counts[0] == counts[1] < 150


def test_gates_of_large_inputs_are_full():
    """No overflow in either direction, and the slopes there are 0."""
    drive, again = K.slopes.of(np.full((2, 3, 8), 1e4) * np.array([1.0, -1.0])[:, None, None]), K.slopes.of(np.zeros((2, 8)))
    with np.errstate(all="raise", under="ignore"):
        out = K.slopes.recurrent(drive, again)
        K.slopes.hand_back(K.slopes.total(out))
    assert out.value[0] == pytest.approx(np.tanh([1.0, 2.0, 3.0])[:, None] * np.ones(2)) and np.abs(out.value[1]).max() < 1e-9
    assert np.isfinite(drive.slope).all() and np.abs(drive.slope).max() < 1e-9
