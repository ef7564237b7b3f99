import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.llm import common


def batches(docs):
    """Rows and bytes of each Arrow batch that a task gets."""

    def sizes(found):
        for batch in found:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    return [tuple(r) for r in docs.mapInArrow(sizes, "n long, bytes long").collect()]


def lengths(docs):
    out = T.StructType([T.StructField("length", T.LongType())])
    return common.map_texts(docs, ["doc_id"], "text", lambda: lambda texts: [[len(t or "") for t in texts]], out)


def test_batches_of_texts_are_bounded(spark):
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") < 600, 20_000).otherwise(100)).alias("text"))
    assert len(lengths(docs).where("length = if(doc_id < 600, 20000, 100)").collect()) == 3000  # all rows, whole texts
    found = batches(docs)
    assert sum(n for n, _ in found) == 3000
    assert max(n for n, _ in found) <= common.SLICE_ROWS and max(b for _, b in found) <= common.BATCH_BYTES + (1 << 16)
    one = docs.limit(3).select("doc_id", F.repeat(F.lit("y"), common.BATCH_BYTES + 1).alias("text"))  # longer than a batch may be
    assert sorted(r["length"] for r in lengths(one).collect()) == [common.BATCH_BYTES + 1] * 3


def test_a_setting_of_the_session_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        assert lengths(spark.range(20).selectExpr("id doc_id", "string(id) text")).count() == 20
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.unset(key)
