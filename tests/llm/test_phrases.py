import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect
from pyspark.sql import functions as F

from lumenseek.llm import phrases


def brute(rows, least, most):
    """All counts and scores in Python's integers."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    frequent = {key: n for key, n in counts.items() if n >= least}
    inside = {}
    for (lang, p), n in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(n, inside.get((lang, p[i : i + k]), 0))
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and inside.get((lang, p), 0) < a:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            low, k = min(cuts)
            out.setdefault(lang, []).append((-low, -a, " ".join(p).encode(), " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], low))
    return sorted((lang, i, *row[3:]) for lang, found in out.items() for i, row in enumerate(sorted(found)[:most], 1))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "a", "é", " x", "z" * 80, *(f"w{i}" for i in range(8))]
    weights = [9, 7, 3, 3, 3, 2, 1, 1, *[1] * 8]
    texts = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(60)):
            out.append(rng.choices(vocabulary, weights)[0])
            if rng.random() < 0.1:
                out.append("new york city")
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", ";"]))
        texts.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(out)))
    return texts + [("en", t) for t in AWKWARD] + [("en", "one very common line of words")] * 60


def found(spark, rows, **options):
    df = spark.createDataFrame([(l, t, 1, "clash", 2.0) for l, t in rows], "lang string, text string, n int, phrase string, score double").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows, least=5, most_rows=40) == brute(rows, 5, 40) != []


@pytest.mark.parametrize("listed", [0, 3])
def test_unlisted_words_change_nothing(spark, monkeypatch, listed):
    monkeypatch.setattr(phrases, "LISTED", listed)
    monkeypatch.setattr(phrases, "SORTED", 500)
    rows = corpus(3)
    assert found(spark, rows, least=4) == brute(rows, 4, 2000)


@pytest.mark.parametrize("cell", [1, 20, 200])
def test_hot_words_in_many_cells_change_nothing(spark, monkeypatch, cell):
    monkeypatch.setattr(phrases, "CELL_WORDS", cell)
    monkeypatch.setattr(phrases, "SORTED", 700)
    monkeypatch.setattr(phrases, "COUNTED", 5)
    monkeypatch.setattr(phrases, "OFTEN_LEAST", 2)
    monkeypatch.setattr(phrases, "HEAVY", 10**9)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 300)
    rows = corpus(4)
    assert found(spark, rows, least=3) == brute(rows, 3, 2000)


def test_query_equals_sql(spark):
    assert_same(spark, connect("/root/testdata/sf0.01"), phrases.op12_phrases, phrases.ORACLE_SQL, "/root/testdata/sf0.01")


def test_empty_tables_and_texts(spark):
    assert phrases.collocations(empty(spark)).count() == 0
    assert found(spark, [(None, None), ("en", ""), ("en", " .,")], least=1) == []
    assert phrases.collocations(empty(spark)).columns == [c.split()[0] for c in phrases.SCHEMA.split(", ")]


def test_one_long_text(spark):
    rows = [("en", "alpha beta. " * 300_000 + "gamma " * 200_000)]
    assert found(spark, rows) == brute(rows, 100, 2000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3), st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), max_size=60), st.lists(st.integers(1, 9), min_size=3, max_size=3))
def test_prefixes_are_those_of_all_suffixes(rows, frequency):
    columns = np.array([[*(x if all(r[1:j]) or j == 0 else 0 for j, x in enumerate(r))] for r in rows], np.int64).reshape(-1, 5).T
    columns = columns[:, columns[1] > 0]
    counts = {}
    for r in columns.T.tolist():
        for k in range(2, 6):
            if all(r[:k]):
                counts[tuple(r[:k])] = counts.get(tuple(r[:k]), 0) + 1
    made = phrases.added_up(columns, np.ones(columns.shape[1], np.int64))
    assert {tuple(p): n for _, found, ns in phrases.prefixes(*made) for p, n in zip(found.T.tolist(), ns.tolist())} == counts
    # a prefix that is not too frequent lies in one cell, whatever the counts are
    listed = ["a", "b", "c"]
    rows = [("en", " ".join(listed[w - 1] for w in p), n) for p, n in counts.items() if len(p) < 5]
    lexicon = phrases.Lexicon(["en"] * 3, listed, np.array(sorted(frequency, reverse=True)), True, 4, 64, phrases.heavy_phrases([r for r in rows if r[2] > 4], ["en"] * 3, listed))
    cells = phrases.dealt(columns, np.arange(4, dtype=np.uint64), lexicon)
    where = {}
    for r, cell in zip(columns.T.tolist(), cells.tolist()):
        for k in range(2, 6):
            if all(r[:k]):
                where.setdefault(tuple(r[:k]), set()).add(cell)
    for p, found in where.items():
        shared = len(p) < 5 and phrases.too_frequent(np.array([*p, 0]).reshape(-1, 1), lexicon)[len(p) - 1][0]
        assert shared or len(found) == 1


def test_a_pair_that_is_everywhere_is_dealt_to_many_cells():
    rng = random.Random(3)
    text = " ".join(x for _ in range(4000) for x in ("very", "common", f"w{rng.randrange(500)}", f"v{rng.randrange(500)}"))
    tokens = text.encode().split()
    heavy = phrases.often(tokens, Counter(tokens))
    assert heavy[b"very common"] == 4000
    listed = ["very", "common", *sorted({w for w in text.split()} - {"very", "common"})]
    lexicon = phrases.Lexicon(["en"] * len(listed), listed, np.array([4000, 4000] + [8] * (len(listed) - 2)), True, 250, 64, phrases.heavy_phrases([("en", "very common", 4000)], ["en"] * len(listed), listed))
    numbers = np.array([listed.index(w) + 1 for w in text.split()])
    sizes = [n for _, _, n, _ in phrases.blocks(numbers, lexicon, [])]
    assert max(sizes) < 1500 and sum(sizes) > 15_000


def test_scores_beyond_64_bits_are_exact(spark):
    rng = random.Random(1)
    rows = [(a := rng.randrange(1, 10**12), rng.randrange(10**12, 10**15), a + rng.randrange(10**6), a + rng.randrange(10**3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint")
    for r in df.select("*", phrases.score(*(F.col(c) for c in "anlr")).alias("score")).collect():
        assert r["score"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"])
