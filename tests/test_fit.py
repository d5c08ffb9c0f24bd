"""The fitted classifier: optimal, its scores those of its exported weights; records of many runs from one job."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from threadlens.operators.evaluate import binary_prf, epoch_metrics, micro_macro, roc_auc
from threadlens.plans import q_io, q_score
from threadlens.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    return materialize(q_io.classifier_rows(spark, SF01))


def largest(g):
    return max(abs(r.gradient) for r in g.collect())


def test_gradient_tells_a_fit_from_other_weights(rows):
    model = q_io.fit_classifier(rows)
    weights = model.coefficients.toArray().tolist()
    assert len(weights) == q_io.N_FEATURES
    assert largest(q_io.loss_gradient(rows, weights, model.intercept)) < 1e-4
    assert largest(q_io.loss_gradient(rows, [0.0] * len(weights), 0.0)) > 1e-2
    shuffled = rows.withColumn("label", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).cast("double"))
    other = q_io.fit_classifier(materialize(shuffled))
    assert largest(q_io.loss_gradient(rows, other.coefficients.toArray().tolist(), other.intercept)) > 1e-2


def test_exported_weights_score_alike_in_duckdb(spark, rows):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    model = q_io.fit_classifier(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE f (doc_id BIGINT, label DOUBLE, split VARCHAR, x DOUBLE[])")
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?)",
                    [(r.doc_id, r.label, r.split, list(r.features)) for r in rows.collect()])
    w = model.coefficients.toArray().tolist()
    sql = f"1 / (1 + exp(-({model.intercept!r} + list_inner_product(x, {w!r}::DOUBLE[]))))"
    want = dict(con.execute(f"SELECT doc_id, {sql} FROM f").fetchall())
    scored = model.transform(rows.withColumn("features", array_to_vector("features")))
    got = {r.doc_id: r.p for r in scored.select("doc_id", F.element_at(vector_to_array("probability"), 2).alias("p")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)
    loss = con.execute(f"SELECT avg(-ln(CASE WHEN label = 1 THEN {sql} ELSE 1 - {sql} END)) FROM f WHERE split = 'train'").fetchone()[0]
    penalty = q_io.REG / 2 * sum(v * v for v in w)
    assert loss + penalty == pytest.approx(model.summary.objectiveHistory[-1], abs=1e-6)


def scored(spark):
    return spark.range(400).select(
        (F.col("id") % 3).cast("string").alias("split"), (F.col("id") % 2).cast("int").alias("label"),
        (F.pmod(F.hash("id"), F.lit(3)) > 0).cast("int").alias("prediction"),
        (F.pmod(F.hash("id", F.lit(1)), F.lit(50)) / 50).alias("score"), (F.col("id") / 100).alias("loss"),
        (F.col("id") % 7).alias("batch_id"))


def test_one_aggregate_gives_all_metrics(spark):
    df = scored(spark)
    got = {(r.split, r.metric): r.value for r in epoch_metrics(df, batched=df).collect()}
    for r in binary_prf(df, "label", "prediction", ("split",)).collect():
        assert [got[r.split, m] for m in ("precision", "recall", "f1")] == pytest.approx([r.precision, r.recall, r.f1])
    for r in roc_auc(df, "label", "score", ("split",)).collect():
        assert got[r.split, "auc"] == pytest.approx(r.auc)
    batches = df.groupBy("split", "batch_id").agg(F.avg("loss").alias("m")).groupBy("split").agg(F.avg("m").alias("m"))
    for r in batches.collect():
        assert got[r.split, "loss"] == pytest.approx(r.m)
    many = {(r.split, r.metric): r.value for r in epoch_metrics(df, multiclass=True).collect()}
    for r in micro_macro(df, "label", "prediction", ("split",)).collect():
        assert many[r.split, "macro_f1"] == pytest.approx(r.macro_f1)
    for r in df.groupBy("split").agg(F.avg("loss").alias("m")).collect():
        assert many[r.split, "loss"] == pytest.approx(r.m)


def test_rows_are_read_once_for_all_metrics(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = scored(spark)
    df = df.mapInArrow(counted, df.schema)
    assert epoch_metrics(df, batched=df).count() == 15
    assert seen.value == 400


def test_heads_together_give_each_heads_record(spark):
    heads = [q_score.grid_head(*run, 1) for run in q_score.GRID_RUNS[:3]]
    both = q_score.reply_records(spark, SF01, heads).collect()
    for i, head in enumerate(heads):
        alone = {(r.split, r.metric): r.value for r in q_score.reply_record(spark, SF01, head).collect()}
        assert {(r.split, r.metric): r.value for r in both if r.head == i} == pytest.approx(alone)
