"""Names that are counted as documents arrive equal the batch's, through restarts; metrics are written and read."""

import random

from paperloom.operators import layout
from paperloom.sources import readers, writers
from paperloom.streaming import names


def test_names_through_restarts(spark, tmp_path):
    rng = random.Random(1)
    words = ["Anna", "Berg", "Émile", "runs", "IBM", "x", "Z", "Đông", "lower", "McDonald"]
    incoming, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    incoming.mkdir()
    every = []
    for step in range(4):
        rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(30)] + [(99, None)]
        every += rows
        spark.createDataFrame(rows, "doc_id long, Text string").coalesce(2).write.mode("append").parquet(str(incoming))
        if step == 2:
            continue  # two deliveries at once for the last run
        stream = spark.readStream.schema("doc_id long, Text string").option("maxFilesPerTrigger", 1).parquet(str(incoming))
        query = names.follow_names(stream, out, state)
        query.awaitTermination()
        assert query.exception() is None
        batch = layout.proper_names(spark.createDataFrame(every, "doc_id long, Text string"), 10)
        assert sorted(map(tuple, names.names_so_far(spark, out).collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() > 3
    # a batch that is written again replaces what it wrote
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    before = sorted(map(tuple, names.names_so_far(spark, out, 1).collect()))
    rows = spark.createDataFrame(spark.read.parquet(f"{out}/batch={last}").collect(), "name string, cnt long")
    rows.write.mode("overwrite").parquet(f"{out}/batch={last}")
    assert sorted(map(tuple, names.names_so_far(spark, out, 1).collect())) == before


def test_metrics(spark, tmp_path):
    rows = spark.createDataFrame([("rouge1", 41.5), ("rouge2", None)], "metric string, value double")
    writers.write_metrics(rows, str(tmp_path / "metrics"))
    got = readers.read_jsonl(spark, str(tmp_path / "metrics"), rows.schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
