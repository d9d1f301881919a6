import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenseek.operators import embedders as E


@pytest.mark.parametrize(("model", "cpus", "ram", "n"), [("minilm", 8, 16.0, 8), ("minilm", 64, 64.0, 8), ("bge-base", 8, 16.0, 1), ("minilm", 8, 4.0, 3), ("minilm", 8, 2.0, 1), ("minilm", 8, None, 1), ("minilm", 0, 16.0, 1)])
def test_worker_count(model, cpus, ram, n):
    assert E.worker_count(model, cpus, ram) == n


def test_memory_limits():
    assert [E.parse_memory_limit(x) for x in ("max\n", "4294967296\n", "not-a-number", "", "0")] == [None, 4294967296, None, None, None]
    assert [E.least_limit(*x) for x in ((16, 4), (4, 16), (16, None), (None, 4), (None, None))] == [4, 4, 16, 4, None]


def test_batch_size():
    assert [E.effective_batch_size(*x) for x in ((None, 1), (16, 1), (0, 16))] == [1, 16, 1]


def test_registry():
    assert E.parse_model("BAAI/bge-small-en-v1.5").short == "bge-small" and E.parse_model("jina-code").dim == 768
    assert E.parse_model("minilm", "mlx").short == "mlx-minilm" and E.parse_model("hash-32").dim == 32
    for name, backend in (("nothing", "cpu"), ("jina-code", "mlx")):
        with pytest.raises(ValueError, match="unknown"):
            E.parse_model(name, backend)
    with pytest.raises(ValueError, match="model directory"):
        E.build("minilm")


def test_pooling_and_norm():
    hidden = np.array([[[1.0, 0], [3, 4], [9, 9]]])
    mask = np.array([[1, 1, 0]])
    assert E.pooled(hidden, mask, "cls").tolist() == [[1, 0]] and E.pooled(hidden, mask, "mean").tolist() == [[2, 2]]
    assert E.normalized(np.array([[3.0, 4], [0, 0]])).tolist() == [[np.float32(0.6), np.float32(0.8)], [0, 0]]


def test_http_replies():
    model = E.HttpEmbedder("http://host:1", "m", 2)
    assert model.url == "http://host:1/v1/embeddings" and E.endpoint("http://h/v1/x") == "http://h/v1/x"
    assert model.parse({"data": [{"embedding": [1, "x"]}]}, 1) == [[1.0, 0.0]]
    with pytest.raises(ValueError):
        model.parse({"data": []}, 1)


def test_column_equals_python(spark):
    texts = ["", "Alpha beta ALPHA", "Ünïcode x1 x1", "K elvin"]
    model = E.HashEmbedder(16)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = [r[0] for r in df.select(model.column(F.col("text"))).collect()]
    assert np.allclose(rows, model.embed(texts), atol=1e-6)


def test_embed_column_checks_shape(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "text string, embedding int")
    assert [r["embedding"] for r in E.embed_column(df, E.ConstantEmbedder()).collect()] == [[1.0, 0.0]] * 2
    wrong = E.ConstantEmbedder()
    wrong.dim = 3
    with pytest.raises(Exception, match="expected 2 vectors|expected 1 vectors"):
        E.embed_column(df, wrong).collect()


def test_embedders_get_few_bytes_at_once(spark):
    """Arrow batches hold up to 10,000 rows, however long their texts are; a text is never split, and empty ones are rows too."""

    class Sparing(E.ConstantEmbedder):
        def embed(self, texts):
            if len(texts) > 1 and sum(map(len, texts)) > 8 << 20:
                raise RuntimeError(f"{sum(map(len, texts))} bytes at once")
            return super().embed(texts)

    df = spark.range(0, 1500, 1, 1).select("id", F.when(F.col("id") % 100 == 7, None).when(F.col("id") == 3, F.repeat(F.lit("x"), 5 << 20)).otherwise(F.repeat(F.lit("word "), 4000)).alias("text"))
    found = E.embed_column(df, Sparing()).select("id", F.octet_length("text").alias("n"), "embedding").collect()
    assert sorted(r["id"] for r in found) == list(range(1500)) and {tuple(r["embedding"]) for r in found} == {(1.0, 0.0)}
    assert {r["n"] for r in found if r["id"] % 100 != 7} == {20_000, 5 << 20}


def test_onnx_is_lazy_and_picklable(tmp_path):
    model = E.OnnxEmbedder(str(tmp_path), E.MODELS["minilm"])
    assert pickle.loads(pickle.dumps(model))._session is None and model.dim == 384
