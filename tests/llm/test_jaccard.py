import random
import re

import numpy as np
import pytest
from helpers import AWKWARD, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect

from lumenseek.llm import components as components_module
from lumenseek.llm import jaccard
from lumenseek.llm.components import components


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def family(rng, words, n, edits):
    """Copies of a text with up to ``edits`` words replaced."""
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(8):
        base = rng.choices(vocabulary, k=rng.choice([5, 8, 20, 60, 150]))
        texts += family(rng, base, 20, 4)
        texts += [" ".join(base[: -(-len(base) * 6 // 7)]), " ".join(base + base[: len(base) // 4])]
    passage = rng.choices(vocabulary, k=30)
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(40)]
    texts += ["the only words", "The ONLY words ", "one", "x  y", *AWKWARD, *AWKWARD]
    rng.shuffle(texts)
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, texts[5]), (3, texts[3])]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, n int, node string")
    assert sorted((tuple(r) for r in jaccard.join(docs).collect()), key=repr) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = family(rng, base, 30, 2) + ["", None, " ", "alone here with six words now"] + ["copies of one text that is long"] * 50
    docs = documents(spark, texts, 1)
    kept = jaccard.keep_one(docs.union(docs.where("doc_id = 1")))
    groups = {r["component_id"] for r in jaccard.join(docs).collect()}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)
    assert jaccard.keep_one(empty(spark)).count() == 0 and jaccard.join(empty(spark)).count() == 0


def test_order_and_shuffles_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    texts = family(rng, [f"w{i}" for i in range(80)], 60, 5) + [f"z{i} and other words of mine" for i in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (0, 7):
        monkeypatch.setattr(jaccard, "MOST_MARKED", most)
        monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
        assert sorted((tuple(r) for r in jaccard.join(docs).collect()), key=repr) == brute(rows)


def test_split_groups_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    texts = family(rng, base, 60, 5) + [" ".join(base[:20] + [f"x{k}y{i}" for i in range(rng.randrange(1, 30))]) for k in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute(rows)
    for name, value in (("PAIRS_AT_ONCE", 3), ("GROUPS_AT_ONCE", 2), ("PASS_BYTES", 4000), ("MOST_RANGE_BITS", 4)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(components_module, "HUB_EDGES", 3)
    monkeypatch.setattr(components_module, "FEW_EDGES", 0)
    assert sorted((tuple(r) for r in jaccard.join(docs).collect()), key=repr) == expected
    # without the leaders' round the grouped prefix join alone finds every link
    monkeypatch.setattr(jaccard, "leader_pairs", lambda signed, percent: signed.selectExpr("node AS a", "node AS b").limit(0))
    assert sorted((tuple(r) for r in jaccard.join(docs).collect()), key=repr) == expected


@given(st.integers(51, 100), st.integers(1, 10**6), st.integers(0, 10**6))
def test_similar_sizes_are_in_neighbouring_bands(percent, a, more):
    edges = jaccard.size_bands(percent)
    b = min(a + more, a * 100 // percent)
    band = lambda n: sum(e <= n for e in edges)
    assert band(a) <= band(b) <= band(a) + 1


def test_low_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        jaccard.join(empty(spark), percent=50)


def test_words_of_a_pattern_and_long_texts(spark):
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(k, " ".join("".join("ab"[bit ^ k] for bit in morse) + x for x in "cdefg")) for k in (0, 1)]
    long = " ".join(f"w{i}" for i in range(40_000))
    rows += [(5, long), (4, long + " and more words at the end"), (6, "start " + long[:100_000])]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {0: 0, 1: 1, 4: 4, 5: 4, 6: 6}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 60))
def test_bitmaps_never_rule_out_similar_sets(common, extra, drop):
    a = np.array(sorted(common), np.uint64)
    b = np.array(sorted(set(sorted(common)[min(drop, len(common) - 1) :]) | extra), np.uint64)
    if jaccard.similar(a, b):
        assert jaccard.may_be_similar(len(a), jaccard.bitmap(a), len(b), jaccard.bitmap(b))


def test_bitmaps_rule_out_others():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(20)]
    maps = [jaccard.bitmap(s) for s in sets]
    assert not any(jaccard.may_be_similar(500, maps[i], 500, maps[j]) for i in range(20) for j in range(i))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50)], [(9, 3), (3, 7), (8, 7), (20, 21)], [(100, i) for i in range(100)] + [(150, i) for i in range(140, 255) if i != 150] + [(100, 254)]])
def test_components(spark, edges, monkeypatch):
    monkeypatch.setattr(components_module, "HUB_EDGES", 20)
    monkeypatch.setattr(components_module, "FEW_EDGES", 30)
    df = spark.createDataFrame([(bytearray([a]), bytearray([b])) for a, b in edges], "a binary, b binary")
    found = {bytes(r["node"])[0]: bytes(r["component"])[0] for r in components(df).collect()}
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(80):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least


def test_query_equals_sql(spark, sf_dir):
    assert_same(spark, connect(sf_dir), jaccard.op9_jaccard_join, jaccard.ORACLE_SQL, sf_dir)


def test_packed_values_come_back():
    rng = np.random.default_rng(4)
    for top in (10, 65535, 65536, 10**6, 2**36):
        values = np.unique(rng.integers(0, top, 500)).astype(np.uint64)
        assert (jaccard.unpack_sorted(jaccard.pack_sorted(values)) == values).all()
    edge = np.array([0, 65535, 131070, 131071, 400000], np.uint64)
    assert (jaccard.unpack_sorted(jaccard.pack_sorted(edge)) == edge).all() and len(jaccard.unpack_sorted(b"")) == 0


def test_marks_know_shared_shingles(spark):
    texts = [f"these five words are shared {i} but not these ones {i} {i}x" for i in range(20)] + ["alone among all of the texts"] * 3
    marks = jaccard.shared_shingles(spark.createDataFrame([(t,) for t in texts], "text string"))
    sets = jaccard.shingle_sets(jaccard.pa.array(texts))
    shared = set.intersection(*(set(s.tolist()) for s in sets[:20]))
    assert len(shared) == 1 and marks.levels(np.array(sorted(shared), np.uint64)).tolist() == [2]
    assert not marks.levels(sets[-1]).any()


def test_clashing_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "x", 1, 2, 3), (2, "a b c d e f", "y", 1, 2, 3), (2, "a b c d e f", "y", 1, 2, 3), (3, "", "z", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, doc_key string, text_key int, _text_key int, again int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
