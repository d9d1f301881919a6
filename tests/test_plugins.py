"""The embedders that need a model or a service, with a hand-made graph and a local server."""

import json
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from lumenseek.operators import embedders

onnxruntime = pytest.importorskip("onnxruntime")
tokenizers = pytest.importorskip("tokenizers")

VOCABULARY = {"[PAD]": 0, "[UNK]": 1, "alpha": 2, "beta": 3, "gamma": 4}
TABLE = np.array([[9, 9, 9], [0, 0, 1], [1, 0, 0], [0, 2, 0], [1, 1, 1]], np.float32)


def number(value):
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def field(key, value):
    """A protobuf field: an integer, or text, bytes or a message."""
    if isinstance(value, int):
        return number(key << 3) + number(value)
    data = value.encode() if isinstance(value, str) else value
    return number(key << 3 | 2) + number(len(data)) + data


def value_info(name, kind, *dims):
    shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def graph():
    """A model whose hidden states are rows of TABLE: one Gather by input_ids."""
    table = b"".join(field(1, d) for d in TABLE.shape) + field(2, 1) + field(8, "table") + field(9, struct.pack(f"<{TABLE.size}f", *TABLE.ravel()))
    node = field(1, "table") + field(1, "input_ids") + field(2, "hidden") + field(4, "Gather")
    body = field(1, node) + field(2, "g") + field(5, table) + field(11, value_info("input_ids", 7, "b", "s")) + field(12, value_info("hidden", 1, "b", "s", 3))
    return field(1, 8) + field(7, body) + field(8, field(1, "") + field(2, 13))


@pytest.fixture
def directory(tmp_path):
    (tmp_path / "model.onnx").write_bytes(graph())
    tokenizer = tokenizers.Tokenizer(tokenizers.models.WordLevel(VOCABULARY, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    return str(tmp_path)


def unit(rows):
    rows = np.array(rows, float)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("batch", [1, 2, 5])
def test_local_model(spark, directory, batch):
    texts = ["alpha", "alpha beta", "beta gamma unknown", "gamma gamma gamma alpha"]
    ids = [[VOCABULARY.get(w, 1) for w in t.split()] for t in texts]
    for pooling, expected in (("mean", [TABLE[i].mean(axis=0) for i in ids]), ("cls", [TABLE[i[0]] for i in ids])):
        model = embedders.OnnxEmbedder(directory, embedders.ModelSpec("tiny", "tiny", 3, pooling))
        model.batch_size = batch  # texts of a batch are padded, and padding has no weight
        assert np.allclose(model.embed(texts), unit(expected), atol=1e-6)
        assert model.embed([]).shape == (0, 3)
    if batch == 2:
        rows = embedders.embed_column(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), model).collect()
        assert np.allclose([r["embedding"] for r in sorted(rows)], unit(expected), atol=1e-6)


def test_batches_hold_texts_of_like_length(directory):
    rng = np.random.default_rng(6)
    lengths = rng.integers(0, 60, 500)
    batches = embedders.token_batches(lengths, 256, 16)
    assert sorted(np.concatenate(batches).tolist()) == list(range(500))
    assert all(len(b) <= 16 and (len(b) == 1 or len(b) * lengths[b].max() <= 256) for b in batches)
    assert embedders.token_batches(np.array([900, 3]), 256, 16)[-1].tolist() == [0] and embedders.token_batches(np.zeros(0, np.int64), 256, 16) == []
    texts = [" ".join(rng.choice(list(VOCABULARY)[2:], n)) for n in lengths + 1]
    plain = embedders.OnnxEmbedder(directory, embedders.ModelSpec("tiny", "tiny", 3))
    plain.batch_size, plain.token_budget = 1, 1
    model = embedders.OnnxEmbedder(directory, embedders.ModelSpec("tiny", "tiny", 3))
    assert np.allclose(model.embed(texts), plain.embed(texts), atol=1e-6)
    # in the order in which they come, batches of as many texts would be padding by half
    came = [lengths[i : i + 32] + 1 for i in range(0, 500, 32)]
    before = sum(len(b) * b.max() - b.sum() for b in came) / sum(len(b) * b.max() for b in came)
    assert plain.padded == 0 and model.padded / model.run < before / 2


def test_auto_falls_back_from_a_missing_model_to_the_service(directory, tmp_path, caplog):
    assert isinstance(embedders.build("minilm", directory=directory, url="http://x"), embedders.OnnxEmbedder)
    assert not caplog.records
    (tmp_path / "model.onnx").unlink()
    assert isinstance(embedders.build("minilm", directory=directory, url="http://x"), embedders.HttpEmbedder)
    assert "falling back" in caplog.text and isinstance(embedders.build("minilm", url="http://x"), embedders.HttpEmbedder)
    assert isinstance(embedders.build("minilm", "onnx", directory=directory, url="http://x"), embedders.OnnxEmbedder)
    for options in ({}, {"directory": directory}, {"backend": "http"}, {"backend": "mlx"}):
        with pytest.raises(ValueError):
            embedders.build("minilm", **options)


def test_long_texts_are_cut_to_the_most_tokens(directory):
    model = embedders.OnnxEmbedder(directory, embedders.ModelSpec("tiny", "tiny", 3), most_tokens=2)
    assert np.allclose(model.embed(["alpha beta gamma gamma"]), unit([TABLE[[2, 3]].mean(axis=0)]), atol=1e-6)


@pytest.fixture
def service():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, asked))
            vectors = [[len(t), "x", 1.0] for t in asked["input"]][: -1 if "lose" in asked["input"] else None]
            data = json.dumps({"data": [{"embedding": v} for v in vectors]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_service(service):
    url, seen = service
    model = embedders.HttpEmbedder(url, "tiny", 3)
    texts = ["t" * n for n in range(1, 40)]
    assert np.allclose(model.embed(texts), unit([[n, 0, 1] for n in range(1, 40)]), atol=1e-6)
    assert [len(asked["input"]) for _, asked in seen] == [16, 16, 7] and all(path == "/v1/embeddings" and asked["model"] == "tiny" for path, asked in seen)
    with pytest.raises(ValueError, match="1 vectors for 2 texts"):
        model.embed(["lose", "one"])
