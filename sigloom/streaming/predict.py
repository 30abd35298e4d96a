"""The batch prediction plan, run on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigloom.plans.predict import predict_sequences
from sigloom.sources.fasta import parse_fasta
from sigloom.sources.models import load_model


def predict_stream(
    spark: SparkSession, model_path: str, fasta_dir: str, output: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Predict every new file of a folder once and append ``(file, cls, prob, rank)`` to ``output``.

    A file is predicted on its own, so no state is kept between batches; the output
    folder of a batch carries its number and is overwritten when the batch is replayed.
    """
    fitted = load_model(spark, model_path)
    texts = spark.readStream.format("text").option("wholetext", True).load(fasta_dir)
    name = F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1))
    files = texts.select(name.alias("sample_id"), F.col("value").alias("content"))

    def one_batch(batch: DataFrame, number: int) -> None:
        sequences = parse_fasta(batch, "content").select("sample_id", "seq")
        ranked = predict_sequences(fitted, sequences, batch.select("sample_id"))
        ranked.withColumnRenamed("sample_id", "file").write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        files.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
