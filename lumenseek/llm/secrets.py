"""Secret scan: fixed key patterns, and a randomness test battery for the strings that no pattern knows.

Every string of ``MIN_LENGTH`` or more key characters is a candidate; ``=`` is one only as padding at the end, elsewhere it
parts a name from its value. Its encoding is the smallest known alphabet that holds it. Three tests ask whether it could be uniformly random over that alphabet:
chi-squared on the character counts, Wald-Wolfowitz runs above and below the middle of the alphabet, and the
lag-1 serial correlation. A second p-value asks whether plain words or digits could look as uniform
by chance (chi-squared shifted by what their uneven characters add, which grows with the length). A candidate's
p-value is the larger of that one and a penalty that grows as the three tests' Bonferroni p-value falls, and
reaches the rate itself at ``RANDOM_LEAST_P``; being no less than the p-value of words it keeps the rate.
The candidates of a text are held to a false discovery rate by weighted Benjamini-Hochberg on these p-values of the whole battery,
with weights in proportion to the bits that a candidate's length and alphabet can carry. What is discovered there is a secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenseek.llm import common

#: Fixed patterns; a match counts if the named group has the least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 characters or more
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 20
FALSE_DISCOVERY_RATE = 0.01
RANDOM_LEAST_P = 0.001
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Known encodings, smallest first: alphabet, and the sum of squared character shares when words or numbers are written in it.
ENCODINGS = [
    ("decimal", _DIGITS, 0.115),
    ("hex", _DIGITS + "abcdef", 0.11),
    ("hex upper", _DIGITS + "ABCDEF", 0.11),
    ("lower", _LOWER, 0.066),
    ("upper", _UPPER, 0.066),
    ("base32", _UPPER + "234567", 0.066),
    ("base36", _DIGITS + _LOWER, 0.062),
    ("base36 upper", _DIGITS + _UPPER, 0.062),
    ("letters", _LOWER + _UPPER, 0.062),
    ("base62", _DIGITS + _LOWER + _UPPER, 0.058),
    ("base64", _DIGITS + _LOWER + _UPPER + "+/", 0.055),
    ("base64url", _DIGITS + _LOWER + _UPPER + "-_", 0.055),
    ("mixed", _DIGITS + _LOWER + _UPPER + "+/-_", 0.055),
]
_SETS = [(name, frozenset(alphabet), {c: i for i, c in enumerate(alphabet)}, share) for name, alphabet, share in ENCODINGS]


class Battery(NamedTuple):
    encoding: str
    p_uniform: float
    p_runs: float
    p_serial: float
    p_text: float
    bits: float


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(candidate: str) -> Battery | None:
    """The tests of one candidate; None if no known encoding holds it (padding ``=`` aside) or it is shorter than 2."""
    body = candidate.rstrip("=")
    n, used = len(body), set(body)
    found = next((s for s in _SETS if used <= s[1]), None)
    if found is None or n < 2:
        return None
    name, _, rank, share = found
    k = len(rank)
    chi = k / n * sum(c * c for c in Counter(body).values()) - n
    sd = math.sqrt(2 * (k - 1) * (n - 1) / n)
    p_uniform = _upper_tail((chi - (k - 1)) / sd)
    at = [rank[c] for c in body]
    high = [2 * x >= k for x in at]
    n1 = sum(high)
    n0 = n - n1
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    if n0 and n1 and n > 2:
        mean = 2 * n0 * n1 / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper_tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(variance)) if variance > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    middle = sum(at) / n
    spread = sum((x - middle) ** 2 for x in at)
    r = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:])) / spread if spread else 1.0
    p_serial = 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n))
    uneven = k * share - 1
    mean, sd = (k - 1) + (n - 1) * uneven, math.sqrt(2 * (k - 1) + 4 * n * uneven)
    p_text = _upper_tail((mean - chi) / sd)
    return Battery(name, p_uniform, min(1.0, p_runs), min(1.0, p_serial), p_text, n * math.log2(k))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the strings to test: runs of key characters, cut at each ``=`` that is not padding at their end."""
    for m in CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        body = run.rstrip("=")
        if "=" not in body:
            yield at, m.end()
            continue
        for part in body.split("="):
            end = at + len(part)
            if end == m.start() + len(body):
                end = m.end()
            if end - at >= MIN_LENGTH:
                yield at, end
            at = end + 1


def random_strings(text: str, rate: float = FALSE_DISCOVERY_RATE, least_p: float = RANDOM_LEAST_P) -> list[tuple[int, int]]:
    """(start, end) of the candidates in ``text`` that are random beyond what words explain, by position."""
    tested = [(s, e, b) for s, e in candidates(text) if (b := battery(text[s:e]))]
    if not tested:
        return []
    mean_bits = sum(b.bits for _, _, b in tested) / len(tested)
    ranked = sorted((combined(b, rate, least_p) / (b.bits / mean_bits), s, e) for s, e, b in tested)
    last = max((i for i, (p, _, _) in enumerate(ranked, 1) if p <= rate * i / len(ranked)), default=0)
    return sorted((s, e) for _, s, e in ranked[:last])


def combined(b: Battery, rate: float = FALSE_DISCOVERY_RATE, least_p: float = RANDOM_LEAST_P) -> float:
    """The p-value of the whole battery against words: at least ``p_text``, and more the less random the string is in any of the tests."""
    p_random = min(1.0, 3 * min(b.p_uniform, b.p_runs, b.p_serial))
    return min(1.0, max(b.p_text, rate * (least_p / p_random) ** 2)) if p_random > least_p * 1e-3 else 1.0


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in ``text``, by start and then kind in the order of ``KINDS``.

    Positions are code points, ends are exclusive. A random string inside a span of the fixed patterns is not told again.
    """
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found += [(s, e, "random") for s, e in random_strings(text) if not any(a <= s and e <= b for a, b, _ in found)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with every span replaced by ``<SECRET>``; overlapping spans become one."""
    out, at, merged = [], 0, []
    for start, end, _ in found:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], "<SECRET>"]
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with two columns more: secret_spans (array of struct start, end, kind) and redacted_text.

    One row per row, in any number and with any other columns; existing columns of the new names are replaced. A
    null text has no spans and stays null, an empty one has none. Runs in the tasks that read the rows, without a shuffle.
    """
    kept = [c for c in docs.columns if c not in ("secret_spans", "redacted_text")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("secret_spans"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "secret_spans", 2_000_000):
                texts = part.column("secret_spans").to_pylist()
                found = [spans(t or "") for t in texts]
                redacted = [redact(t, f) if f else t for t, f in zip(texts, found)]
                told = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found], span)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], told, pa.array(redacted, pa.string())], [*kept, "secret_spans", "redacted_text"])
        common.release()

    types = "secret_spans array<struct<start:bigint,end:bigint,kind:string>>, redacted_text string"
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *StructType.fromDDL(types).fields]))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document (columns doc_id and text; others are ignored).

    A null text counts as empty and has no spans; repeated rows are answered each; an empty table gives no rows.
    """

    def joined(found: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{k}:{s}:{e}" for s, e, k in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "text")):
            found = [spans(t) for t in common.texts_of(batch.column("text"))]
            base = [[x for x in f if x[2] != "random"] for f in found]
            counts = [pa.array([sum(x[2] == kind for x in f) for f in found], pa.int64()) for kind in KINDS]
            hashes = [hashlib.sha256(joined(f).encode()).hexdigest() for f in base]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(hashes, pa.string()), pa.array([joined(f) for f in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))
