"""Estimators and models: fitted, saved and loaded as one pipeline."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from netloom.plans.stages import Coder, CoderModel, Scaler, Selector


def frame(spark, n=60):
    rows = [(i, "tcp" if i % 3 else "udp", f"s{i % 4}", float(i % 2) * 5 + i % 3, float(i), None if i % 7 == 0 else 1.0, i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id long, proto string, service string, a double, b double, c double, label int")


def test_a_saved_pipeline_gives_equal_rows(spark, tmp_path):
    df = frame(spark).fillna(0.0, ["c"])
    columns = ["proto", "service", "a", "b", "c"]
    pipeline = Pipeline(stages=[Coder(columns=["proto", "service"]), Scaler(columns=columns), Selector(columns=columns, label="label", k=3)])
    pipeline.save(str(tmp_path / "plain"))
    model = Pipeline.load(str(tmp_path / "plain")).fit(df)
    model.write().overwrite().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    new = df.union(df.limit(2).withColumns({"id": F.col("id") + 1000, "proto": F.lit("icmp"), "service": F.lit(None).cast("string")}))
    one, two = (sorted(map(str, m.transform(new).collect())) for m in (model, again))
    assert one == two and len(one) == 62
    left = again.transform(new).columns
    assert left[0] == "id" and left[-1] == "label" and len(left) == 5
    assert [type(s) for s in again.stages] == [type(s) for s in model.stages] and [s.uid for s in again.stages] == [s.uid for s in model.stages]


def test_unseen_and_null_values_get_the_unknown_code(spark, tmp_path):
    df = frame(spark)
    model = Coder(columns=["proto"], unknown="??").fit(df)
    model.save(str(tmp_path / "coder"))
    back = CoderModel.load(str(tmp_path / "coder"))
    codes = {r.value: r.code for r in back.table.collect()}
    assert codes == {"??": 0, "tcp": 1, "udp": 2}
    odd = spark.createDataFrame([(1, "icmp"), (2, None), (3, "udp")], "id int, proto string").withColumn("value", F.lit("own"))
    assert sorted((r.id, r.proto, r.value) for r in back.transform(odd).collect()) == [(1, 0, "own"), (2, 0, "own"), (3, 2, "own")]
    assert Coder(columns=[]).fit(df).transform(df).columns == df.columns
