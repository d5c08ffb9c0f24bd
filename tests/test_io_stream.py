"""CSV split round trip of hostile text; stream == batch for stateless steps."""

from pyspark.sql import functions as F

from conftest import SF01
from threadlens.functions.patterns import NA_WORDS
from threadlens.session import scratch_path
from threadlens.sources.splits import read_splits, write_splits
from threadlens.streaming import stateless as ST

HOSTILE = ['say "hi", then\nleave', "  padded  ", "a\r\nb\rc", "NA", "null", "", None,
           "comma,semi;tab\t", '"quoted"', "back\\slash \\\"x\\\"", "N/A ", "ünïcødé 😀"]


def test_csv_round_trip(spark):
    rows = [(i, t, i % 2, "train" if i % 3 else "test") for i, t in enumerate(HOSTILE)]
    df = spark.createDataFrame(rows, "id long, text string, label int, split string")
    path = write_splits(df, scratch_path(spark, "test-csv"))
    back = {r.id: r for r in read_splits(spark, path, "id long, text string, label int", ("text",)).collect()}
    assert len(back) == len(HOSTILE)
    for i, t in enumerate(HOSTILE):
        want = None if t is None or t in NA_WORDS else t
        assert back[i].text == want, (t, back[i].text)
        assert back[i].label == i % 2 and back[i].split == ("train" if i % 3 else "test")
    only_test = read_splits(spark, path, "id long, text string, label int", ("text",), splits=("test",))
    assert only_test.count() == sum(1 for i in range(len(HOSTILE)) if i % 3 == 0)


def test_stream_equals_batch(spark):
    schema = "conv_id long, turn long, role string, text string"
    src = ST.file_stream(spark, SF01, schema, glob="conversations.parquet")
    out = ST.stream_text_features(src.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", "text")
    base = scratch_path(spark, "test-stream")
    ST.run_available_now(out, f"{base}/sink", f"{base}/ckpt")
    streamed = sorted(tuple(r) for r in spark.read.parquet(f"{base}/sink").collect())
    batch_src = spark.read.parquet(f"{SF01}/conversations.parquet")
    batch = ST.stream_text_features(batch_src.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", "text")
    assert streamed == sorted(tuple(r) for r in batch.collect())
    assert len(streamed) == batch_src.count()


def test_streams_read_tables_of_several_files(spark, tmp_path):
    from threadlens.plans import QUERIES

    spark.read.parquet(f"{SF01}/documents.parquet").limit(40).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF01}/embeddings.parquet").limit(40).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("stream_clean_stats", "stream_fusion_scores", "stream_head_scores"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 40, name
