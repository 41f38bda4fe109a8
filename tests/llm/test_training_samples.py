"""What training takes to the driver."""

import numpy as np
import pyarrow as pa

from veridoc.llm import linear, quality_rules


def test_training_samples_are_columns(spark, monkeypatch):
    """Packed rows come as Arrow columns, in order of doc_id, and a product with weights is taken in runs of rows."""
    docs = spark.createDataFrame([(i, f"w{i} w{i % 3} same", "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality_rules.labelled_sample(docs, labels, "quality", 30)
    assert isinstance(got, pa.Table)
    ids = [str(x) for x in got.column("doc_id").to_pylist()]
    assert ids == sorted(ids) and len(ids) == 30
    x = linear.Sparse.unpacked(got.column("index"), got.column("value"))
    w = np.arange(3 * quality_rules.BUCKETS) / 1000
    want = [sum(w[i] * v for i, v in zip(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32), strict=True)) for a, b in zip(got.column("index").to_pylist(), got.column("value").to_pylist(), strict=True)]
    assert np.allclose(x.dot(w), want)
    monkeypatch.setattr(linear, "RUN", 7)
    assert np.allclose(x.dot(w), want)
    assert linear.joined(pa.chunked_array([], pa.binary()), np.int32)[1].tolist() == [0]
