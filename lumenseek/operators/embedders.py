"""Embedding functions: the protocol, a registry of model names, and the implementations that run here.

``HashEmbedder`` needs no model: it counts hashed words, a lexical stand-in without any claim to semantics.
``OnnxEmbedder`` and ``HttpEmbedder`` are plug-ins for a local model directory and a service.
"""

from __future__ import annotations

import hashlib
import json
import logging
import math
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable
from urllib import request

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lumenseek.functions import paths, vectors


log = logging.getLogger(__name__)


@runtime_checkable
class Embedder(Protocol):
    """Anything picklable with these members; ``embed`` runs in the executors' Python workers."""

    model: str
    dim: int
    batch_size: int

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        """A float32 row of ``dim`` numbers for each text, of unit length or zero."""


@dataclass(frozen=True)
class ModelSpec:
    """short: the name under which vectors are stored; pooling: how token vectors become one."""

    short: str
    repo: str
    dim: int
    pooling: str = "mean"


#: Models by name. Vectors of another backend of the same model do not mix, hence the prefix.
MODELS = {
    m.short: m
    for m in (
        ModelSpec("bge-small-q", "BAAI/bge-small-en-v1.5-quantized", 384, "cls"),
        ModelSpec("bge-small", "BAAI/bge-small-en-v1.5", 384, "cls"),
        ModelSpec("bge-base", "BAAI/bge-base-en-v1.5", 768, "cls"),
        ModelSpec("minilm", "sentence-transformers/all-MiniLM-L6-v2", 384, "mean"),
        ModelSpec("jina-code", "jinaai/jina-embeddings-v2-base-code", 768, "mean"),
    )
}
MLX_MODELS = {name: ModelSpec(f"mlx-{name}", MODELS[name].repo, MODELS[name].dim, MODELS[name].pooling) for name in ("bge-small", "minilm", "bge-base")}
SMALL_MODELS = ("minilm", "bge-small", "bge-small-q")
MOST_WORKERS, WORKER_GIB, LEAST_HEADROOM_GIB = 8, 0.75, 1.5


def parse_model(name: str, backend: str = "cpu") -> ModelSpec:
    """The model of a short or full name; ``mlx`` has entries of its own. ``hash-<dim>`` is the hashed stand-in."""
    if re.fullmatch(r"hash-[1-9]\d*", name):
        return ModelSpec(name, name, int(name[5:]), "sum")
    known = MLX_MODELS if backend == "mlx" else MODELS
    for key, spec in known.items():
        if name in (key, spec.repo):
            return spec
    raise ValueError(f"unknown {'mlx ' if backend == 'mlx' else ''}model: {name}")


def worker_count(model: str, cpus: int, ram_gib: float | None) -> int:
    """How many model sessions a host should run at once."""
    if ram_gib is None:
        return 1
    by_ram = math.floor((ram_gib - max(LEAST_HEADROOM_GIB, ram_gib / 4)) / WORKER_GIB)
    return max(1, min(max(1, cpus), MOST_WORKERS if model in SMALL_MODELS else 1, by_ram))


def parse_memory_limit(text: str) -> int | None:
    """Bytes in a control-group file; None for ``max``, empty, invalid and 0."""
    text = text.strip()
    return int(text) or None if text.isascii() and text.isdigit() else None


def least_limit(*limits: int | None) -> int | None:
    return min((x for x in limits if x is not None), default=None)


def effective_batch_size(requested: int | None, default: int) -> int:
    return max(1, default if requested is None else requested)


def normalized(matrix: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    matrix = np.asarray(matrix, np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return (matrix / np.where(norms > 0, norms, 1)).astype(np.float32)


class _Heads(dict):
    """Word -> the first 16 bits of its MD5."""

    def __missing__(self, word: str) -> int:
        head = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16)
        return head


#: Words that this process knows, forgotten when they are many.
_HEADS, _KEPT_HEADS = _Heads(), 200_000
_ASCII_WORD = re.compile("[a-z0-9]+")


class HashEmbedder:
    """Counts of ASCII words, lower-cased, in ``dim`` buckets by the first 16 bits of their MD5; unit length."""

    batch_size = 256
    by_length = False

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.model = dim, f"hash-{dim}"

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        found = [_ASCII_WORD.findall(text.lower() if text.isascii() else text.translate(_ASCII_LOWER)) for text in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        if len(_HEADS) > _KEPT_HEADS:
            _HEADS.clear()
        heads = np.fromiter((_HEADS[word] for words in found for word in words), np.int64, int(counts.sum()))
        places = np.repeat(np.arange(len(found)), counts) * self.dim + heads % self.dim
        return normalized(np.bincount(places, minlength=len(found) * self.dim).reshape(len(found), self.dim))

    def column(self, text: Column) -> Column:
        """The same vector as a column expression, for SQL users and small dimensions."""
        words = F.regexp_extract_all(paths.ascii_lower(text), F.lit("([a-z0-9]+)"), 1)
        buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % self.dim)
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
        return vectors.l2_normalize(counts)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


class ConstantEmbedder:
    """The same vector for every text; for tests. Fails on the n-th call of a process if asked."""

    batch_size = 1

    def __init__(self, vector: Sequence[float] = (1.0, 0.0), fail_on_call: int | None = None, model: str = "constant") -> None:
        self.vector, self.dim, self.model, self.fail_on_call, self.calls = list(vector), len(vector), model, fail_on_call, 0

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        self.calls += 1
        if self.fail_on_call is not None and self.calls >= self.fail_on_call:
            raise RuntimeError("embedding failed as asked")
        return np.tile(np.asarray(self.vector, np.float32), (len(texts), 1))


class HttpEmbedder:
    """A service that answers POST {input, model} with data[].embedding; what is not a number there counts as 0."""

    batch_size = 16

    def __init__(self, url: str, model: str, dim: int, timeout: float = 120.0) -> None:
        self.url, self.model, self.dim, self.timeout = endpoint(url), model, dim, timeout

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        rows = []
        for at in range(0, len(texts), self.batch_size):
            part = list(texts[at : at + self.batch_size])
            body = json.dumps({"input": part, "model": self.model}).encode()
            with request.urlopen(request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as reply:
                rows += self.parse(json.load(reply), len(part))
        return normalized(np.array(rows, np.float64).reshape(len(rows), self.dim))

    def parse(self, reply: dict, n: int) -> list[list[float]]:
        data = reply.get("data") or []
        out = [[float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0 for x in item["embedding"]] for item in data]
        if len(out) != n or any(len(v) != self.dim for v in out):
            raise ValueError(f"the service gave {len(out)} vectors for {n} texts, or of another length than {self.dim}")
        return out


def endpoint(url: str) -> str:
    return url if "/v1/" in url else url.rstrip("/") + "/v1/embeddings"


class OnnxEmbedder:
    """A local directory with ``model.onnx`` and ``tokenizer.json``; the session is made once per Python worker, when first used.

    Texts go through the model in batches of like length in tokens, of ``batch_size`` texts and ``token_budget`` tokens, padding included, at most; ``padded`` and
    ``run`` count the tokens of padding and all tokens so far.
    """

    batch_size = 32
    token_budget = 4096

    def __init__(self, directory: str, spec: ModelSpec, most_tokens: int = 512, threads: int = 1) -> None:
        self.directory, self.spec, self.model, self.dim = directory, spec, spec.short, spec.dim
        self.most_tokens, self.threads = most_tokens, threads
        self._session = None
        self.padded = self.run = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def _load(self):
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            tokenizer = Tokenizer.from_file(f"{self.directory}/tokenizer.json")
            tokenizer.enable_truncation(self.most_tokens)
            told = tokenizer.padding
            self._pad = told["pad_id"] if told else 0
            tokenizer.no_padding()
            self._session = onnxruntime.InferenceSession(f"{self.directory}/model.onnx", options), tokenizer
        return self._session

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        session, tokenizer = self._load()
        wanted = {i.name for i in session.get_inputs()}
        out = np.zeros((len(texts), self.dim))
        for at in range(0, len(texts), ENCODED_TEXTS):
            encoded = tokenizer.encode_batch(list(texts[at : at + ENCODED_TEXTS]))
            lengths = np.array([len(e.ids) for e in encoded], np.int64)
            for batch in token_batches(lengths, self.token_budget, self.batch_size):
                width = max(1, int(lengths[batch].max()))
                ids, mask = np.full((len(batch), width), self._pad, np.int64), np.zeros((len(batch), width), np.int64)
                for row, i in enumerate(batch.tolist()):
                    ids[row, : lengths[i]] = encoded[i].ids
                    mask[row, : lengths[i]] = 1
                feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
                hidden = session.run(None, {k: v for k, v in feeds.items() if k in wanted})[0]
                out[at + batch] = pooled(hidden, mask, self.spec.pooling)
                self.run += ids.size
                self.padded += ids.size - int(lengths[batch].sum())
        return normalized(out)


#: Texts that are cut into tokens together, among which batches of like length are formed.
ENCODED_TEXTS = 2048


def token_batches(lengths: np.ndarray, budget: int, most: int) -> list[np.ndarray]:
    """Places of texts in batches, by length: at most ``most`` texts, whose tokens with padding are ``budget`` at most; a longer text is a batch of its own."""
    order = np.argsort(lengths, kind="stable")
    out, first = [], 0
    for i in range(1, len(order) + 1):
        full = i < len(order) and (i - first >= most or (i - first + 1) * int(lengths[order[i]]) > budget)
        if full or i == len(order):
            out.append(order[first:i])
            first = i
    return out


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """The first token's vector (cls), or the mean over the tokens that the mask keeps."""
    if how == "cls":
        return hidden[:, 0]
    weight = mask[:, :, None].astype(np.float64)
    return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


BACKENDS: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder, "constant": ConstantEmbedder, "http": HttpEmbedder, "onnx": OnnxEmbedder}


def build(name: str, backend: str = "auto", **options) -> Embedder:
    """An embedder by model name. ``auto`` takes the hashed stand-in for ``hash-<dim>``, a local model if its ``directory`` has one, and falls back to the
    service at ``url``, if there is one, with a message; a backend that is asked for by name has to work.
    """
    spec = parse_model(name, "mlx" if backend == "mlx" else "cpu")
    directory, url = options.get("directory"), options.get("url")
    if backend == "mlx":
        raise ValueError("the mlx backend needs Apple hardware, which Spark executors do not offer")
    if spec.short.startswith("hash-"):
        return HashEmbedder(spec.dim)
    if backend == "http" and not url:
        raise ValueError("the http backend needs the service's url")
    if backend == "http":
        return HttpEmbedder(url, spec.short, spec.dim)
    missing = [f for f in ("model.onnx", "tokenizer.json") if directory and not os.path.exists(f"{directory}/{f}")]
    if directory and (not missing or backend != "auto"):
        return OnnxEmbedder(directory, spec, threads=options.get("threads", 1))
    if backend == "auto" and url:
        if missing:
            log.warning("[onnx] unavailable (no %s in %s); falling back to the service", missing[0], directory)
        return HttpEmbedder(url, spec.short, spec.dim)
    raise ValueError(f"model {name} needs a local model directory or the http backend")


#: Bytes of texts, and of vectors as numbers of 8 bytes, that an embedder gets at once. Its words or tokens take many times as much.
SLICE_BYTES = 2 << 20


def _slices(batch: pa.RecordBatch, text: str, dim: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about ``SLICE_BYTES``; one text is never split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8 * dim
    firsts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE_BYTES, prepend=-1))
    for first, end in zip(firsts.tolist(), np.append(firsts[1:], batch.num_rows).tolist()):
        yield batch.slice(first, end - first)


def embed_column(df: DataFrame, embedder: Embedder, text: str = "text", into: str = "embedding") -> DataFrame:
    """``df`` with a vector for each row's text (null: empty).

    Within each partition texts are sorted by length, so that batches of a model hold texts of like length, unless the embedder says that it gains nothing
    (``by_length`` is false); a vector of another length than ``dim`` fails.
    """
    kept = [c for c in df.columns if c != into]
    schema = df.select(*kept).schema.add(into, ArrayType(FloatType()))
    arrow_type = pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text, embedder.dim):
                texts = [t or "" for t in part.column(text).to_pylist()]
                matrix = np.asarray(embedder.embed(texts), np.float32)
                if matrix.shape != (len(texts), embedder.dim):
                    raise ValueError(f"expected {len(texts)} vectors of {embedder.dim}, got {matrix.shape}")
                offsets = np.arange(0, matrix.size + 1, embedder.dim, dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel())).cast(arrow_type)
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, into])

    ordered = df.select(*kept)
    if getattr(embedder, "by_length", True):
        ordered = ordered.sortWithinPartitions(F.octet_length(F.col(text).cast("string")))
    return ordered.mapInArrow(run, schema)
