import hashlib
import random
import re

import pyarrow as pa
import pytest
from helpers import AWKWARD, documents, empty

from lumenseek.llm import common, decontamination


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, passage in items:
            v = words(passage)
            k = min(10, len(v))
            wanted = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in wanted:
                    hit |= set(range(i, i + k))
                    names.add("null" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdé") for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 9, 10, 11, 25, 60]))) for i in range(12)] + [(3, text(12)), (None, text(14)), (50, None), (51, "..."), (7, text(9))]
    docs = [(i, text(rng.randrange(0, 120))) for i in range(60)]
    docs += [(i + 100, f"x! {t or ''}, Y") for i, (_, t) in enumerate(items)] + [(5, docs[5][1])] * 3 + [(None, items[8][1])] + [(200 + i, t) for i, t in enumerate(AWKWARD)]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize(("seed", "block_bytes"), [(1, 1 << 24), (2, 1 << 24), (1, 150)])
def test_equals_brute_force(spark, seed, block_bytes):
    docs, items, d, b = tables(spark, seed)
    found = decontamination.contamination(d, b, block_bytes=block_bytes).drop("spans")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items)


def test_many_blocks_take_one_scan_and_go_out_one_by_one(spark, monkeypatch):
    docs, items, _, b = tables(spark, 4)
    docs = [(i, t) for i, t in docs if i is not None and i < 100]
    path = common.scratch_path(spark, "docs")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(path)
    size = sum(len((t or "").encode()) for _, t in items) // 7
    assert decontamination.block_count(b, size) == 8
    sent, rows = [], []
    monkeypatch.setattr(decontamination, "block", lambda *a, f=decontamination.block: sent.append(f(*a)) or sent[-1])
    monkeypatch.setattr(decontamination, "_search", lambda d, *a, f=decontamination._search, **k: rows.append(d.count()) or f(d, *a, **k))
    found = decontamination.contamination(spark.read.parquet(path), b, block_bytes=size)
    assert sorted((tuple(r)[:6] for r in found.collect()), key=repr) == brute(docs, items)
    # the blocks share the items, and meet rows that the one scan of the documents let through
    assert len(sent) == 8 and sum(len(index.names) for index in sent) == len(items)
    assert len(set(rows)) == 1 and rows[0] < len(docs)
    assert path.rsplit("/", 1)[1] not in found._jdf.queryExecution().executedPlan().toString()
    clean = {r[0] for r in brute(docs, items) if not r[5]}
    assert {r["doc_id"] for r in decontamination.keep_clean(spark.read.parquet(path), b, block_bytes=size).collect()} == clean


def test_words_of_a_pattern_are_told_apart(spark):
    """Two words that every polynomial hash modulo 2**64 takes for one."""
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    first, second = ("".join("ab"[bit ^ k] for bit in morse) for k in (0, 1))
    around = "one two three four five six seven eight nine"
    assert decontamination.hits(pa.array([f"{second} {around}"]), decontamination.build(["1"], [f"{first} {around}"]))[1] == []
    assert decontamination.hits(pa.array([f"{first} {around}"]), decontamination.build(["1"], [f"{first} {around}"]))[1] == [(0, 0, 10)]


def test_windows_of_equal_hashes_are_told_apart_by_the_second(monkeypatch):
    texts = [" ".join(f"w{i + 100 * k}" for i in range(10)) for k in range(4)]
    monkeypatch.setattr(decontamination.words, "range_hashes", lambda folded, s, e, seed=0, f=decontamination.words.range_hashes: f(folded, s, e, seed) * (seed != 0))
    index = decontamination.build(["0", "1", "2"], texts[:3])
    counts, spans, items = decontamination.hits(pa.array(texts), index)
    assert items == {0: {0}, 1: {1}, 2: {2}} and [s[0] for s in spans] == [0, 1, 2]


def test_a_text_of_several_megabytes(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    long = " ".join(f"w{i}" for i in range(900_000)) + f" {passage}"
    docs = spark.createDataFrame([(1, long), (2, long[:5_000_000])], "doc_id bigint, text string")
    found = decontamination.contamination(docs, spark.createDataFrame([(1, passage)], "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_hit"], r["n_words"] > 600_000) for r in found) == [(1, 12, True), (2, 0, True)]


def test_every_long_span_is_found(spark):
    rng = random.Random(9)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = [(n, " ".join(f"z{rng.randrange(10**6)}" for _ in range(30)) + " " + " ".join(passage[5 : 5 + n]) + " end") for n in range(1, 40)]
    found = decontamination.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, text string"))
    assert {r["doc_id"]: r["n_hit"] for r in found.collect()} == {n: n if n >= 10 else 0 for n in range(1, 40)}


def test_slices_and_benchmarks_of_few_words(spark):
    long = [f"w{i}" for i in range(14)]
    index = decontamination.build(["1"], [" ".join(long)])
    for n in range(13):
        counts, spans, items = decontamination.hits(pa.array([" ".join(long[:n])]), index)
        assert (counts.tolist(), spans, items) == ([n], [(0, 0, n)] if n >= 10 else [], {0: {0}} if n >= 10 else {})
        counts, spans, items = decontamination.hits(pa.array([" ".join(long)]), decontamination.build(["1"], [" ".join(long[:n])]))
        assert (counts.tolist(), spans, items) == ([14], [(0, 0, n)] if n else [], {0: {0}} if n else {})
    docs = spark.createDataFrame([(1, "just these four words")], "doc_id bigint, text string")
    found = decontamination.contamination(docs, spark.createDataFrame([(1, " ".join(long))], "item_id bigint, text string")).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in found] == [(4, 0, False)]


def test_empty_tables_and_clashes(spark):
    docs = documents(spark, AWKWARD)
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(docs, nothing).where("contaminated").count() == 0
    assert decontamination.contamination(empty(spark), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    items = spark.createDataFrame([(1, "one", 5)], "item_id bigint, text string, n_hit int")
    assert decontamination.contamination(docs, items).where("contaminated").count() == 2
    kept = decontamination.keep_clean(docs, items)
    assert kept.count() == len(AWKWARD) - 2 and kept.columns == docs.columns
