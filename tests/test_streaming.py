from pyspark.sql import functions as F

from quadrille import Namespaces, Template
from quadrille.streaming.templates import stream_distinct_triples, stream_triples

NS = Namespaces({"ex": "http://example.org/"})


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_templates_over_a_stream(spark, tmp_path):
    rows = spark.range(10).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    rows.unionAll(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    template = Template("ex:{?id} ex:id ?id ; ex:v ?v", NS)
    run(stream_triples(template, stream), "plain")
    assert spark.table("plain").count() == 30
    run(stream_distinct_triples(template, stream, "ts", "1 hour"), "once")
    assert spark.table("once").count() == 15
