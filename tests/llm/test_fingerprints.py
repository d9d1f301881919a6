import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenseek.llm import catalog, common, fingerprints
from lumenseek.llm.fingerprints import LEAST


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Ids, counts and hashes from the plain text; the order among rows of one id is told by the results themselves."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), text, changed, following))
    return out


def share(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if a == b else len(a & b) / min(len(a), len(b)) if a and b else 0.0


def one(text):
    return fingerprints.sketches(pa.array([text]))[0]


def check(found, rows):
    key = lambda r: (r[0] is None, r[0], r[2])
    expected = sorted(brute(rows), key=key)
    found = sorted((tuple(r) for r in found), key=key)
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    for (_, _, _, mine, theirs, near_edited, near_next), (_, _, _, text, changed, following) in zip(found, expected):
        assert mine == fingerprints.pack(one(text)).hex() and theirs == fingerprints.pack(one(changed)).hex()
        for near, other in ((near_edited, changed), (near_next, following)):
            if max(len(shingles(text)), len(shingles(other))) < LEAST:
                assert near == share(text, other)
            else:
                assert abs(near - share(text, other)) <= 0.35


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"] or "") for r in common.table(spark, sf_dir, "documents").collect()]
    check(catalog.queries()["op11_fingerprints"](spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("ranges", [1, 7])
def test_awkward_rows_in_any_number_of_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(fingerprints, "MOST_RANGES", ranges)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1000)
    rng = random.Random(5)
    texts = [*AWKWARD, *(" ".join(rng.choices("abcdefgh", k=rng.randrange(90))) for _ in range(60)), "x " * 1_500_000]
    found = fingerprints.with_next(documents(spark, texts)).collect()
    check(found, [(None if t is None and i == 0 else i, t or "") for i, t in enumerate(texts)])


def test_repeated_rows_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200)
    df = spark.createDataFrame([(5, f"text number {i} of the hot id") for i in range(40)] + [(5, "the same")] * 30 + [(i, "another text") for i in range(10, 14)], "doc_id bigint, text string").repartition(4)
    found = fingerprints.with_next(df).collect()
    assert len(found) == 74 and sum(r["near_next"] == 1.0 and r["n_chars"] == 8 for r in found) == 29
    # each text but the copies is followed by another one, and all successors differ from row to row
    assert len({r["edited_sha256"] for r in found if r["n_chars"] > 20}) >= 40


def test_single_row_follows_itself_and_no_row_gives_none(spark):
    row = fingerprints.with_next(spark.createDataFrame([(3, "one two three")], "doc_id int, text string")).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"one two tone ").hexdigest()
    assert fingerprints.with_next(empty(spark)).count() == 0


sets = st.sets(st.integers(0, 2**64 - 1), max_size=120)


@settings(max_examples=200, deadline=None)
@given(sets, sets)
def test_the_merge_of_sketches_is_the_sketch_of_the_union(a, b):
    x, y, both = (fingerprints.sketch(np.array(sorted(s), np.uint64)) for s in (a, b, a | b))
    assert fingerprints.merge(x, y).tolist() == both.tolist()
    assert fingerprints.unpack(fingerprints.pack(x)).tolist() == x.tolist() and fingerprints.likeness(x, x) == 1.0


def test_containment_of_very_unequal_sets_is_estimated_without_bias():
    rng = np.random.default_rng(4)
    whole = rng.integers(0, 2**64, 60_000, np.uint64)
    errors = []
    for _ in range(40):
        part = np.concatenate((rng.choice(whole, 1500, replace=False), rng.integers(0, 2**64, 1500, np.uint64)))
        errors.append(fingerprints.likeness(fingerprints.sketch(part), fingerprints.sketch(whole)) - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_groups_have_the_sketch_of_all_their_shingles(spark):
    rng = random.Random(2)
    groups = {g: [" ".join(rng.choices([f"w{i}" for i in range(500)], k=n)) for _ in range(6)] for g, n in (("a", 400), ("b", 30), ("c", 0))}
    rows = [(g, t) for g, texts in groups.items() for t in texts]
    sketched = [(g, one(t).astype(np.int64).tolist()) for g, t in rows]
    found = {}
    for r in fingerprints.merged(spark.createDataFrame(sketched, "g string, sketch array<bigint>"), "g").collect():
        found.setdefault(r["g"], []).append(r["x"])
    for g, texts in groups.items():
        expected = np.zeros(0, np.uint64)
        for t in texts:
            expected = fingerprints.merge(expected, one(t))
        assert sorted(found.get(g, [])) == expected.tolist()
    docs = spark.createDataFrame(list(enumerate(groups["b"])), "doc_id int, text string")
    assert [r["sketch"] for r in fingerprints.fingerprints(docs).orderBy("doc_id").collect()] == [one(t).tolist() for t in groups["b"]]
