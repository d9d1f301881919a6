import re

import pytest
from helpers import AWKWARD, empty
from oracle import assert_same, connect
from test_decontamination import brute as shared_passages
from test_jaccard import brute as similar_documents
from test_secrets import base_spans
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lumenseek.llm import catalog, common, decontamination, jaccard, secrets, tokens, toxicity

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_decontamination_equals_sql(spark, sf_dir):
    assert_same(spark, connect(sf_dir), catalog.queries()["op3_decontamination"], decontamination.ORACLE_SQL, sf_dir)


def test_each_stage_does_its_work(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    clean = common.materialize(stages["toxicity"](spark, docs, sf), "t1")
    model = toxicity.train(docs, common.table(spark, sf, "labels"))
    rejected = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - rejected and 0 < len(rejected) < 250
    unique = common.materialize(stages["near_duplicates"](spark, clean, sf), "t2")
    firsts = {r["component_id"] for r in jaccard.join(clean).collect()}
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(firsts) and len(firsts) < clean.count()
    fair = common.materialize(stages["decontamination"](spark, unique, sf), "t3")
    hit = {r["doc_id"] for r in decontamination.contamination(unique, common.table(spark, sf, "benchmark")).where("contaminated").collect()}
    assert {r["doc_id"] for r in fair.collect()} == firsts - hit and hit
    safe = common.materialize(stages["secrets"](spark, fair, sf), "t4")
    before = {r["doc_id"]: r["text"] for r in fair.collect()}
    changed = 0
    for r in safe.collect():
        assert not [s for s in secrets.spans(r["text"]) if s[2] != "random"] and r["n_chars"] == len(r["text"])
        changed += r["text"] != before[r["doc_id"]]
    assert changed and safe.count() == fair.count()
    for df in (clean, unique, fair, safe):
        assert df.columns == COLUMNS
    packed = stages["packing"](spark, safe, sf).collect()
    assert {r["doc_id"] for r in packed} == set(before) and all(len(r["ids"]) == r["length"] for r in packed)


@pytest.mark.parametrize("rows", [0, 1])
def test_awkward_tables_pass_all_stages(spark, sf_dir, rows):
    docs = spark.createDataFrame([(i or None, t, None, "s", None) for i, t in enumerate(AWKWARD * 2)], empty(spark).schema) if rows else empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    texts = {re.sub(r"\s+", " ", t or "").strip() for t in AWKWARD}
    assert (docs.count() >= len(texts) - 1) if rows else docs.count() == 0


def test_run_equals_plain_versions_of_all_stages(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, sf_dir, "documents").collect()]
    items = [tuple(r) for r in common.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    model = toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

    def toxic(text):
        at, weight = toxicity.bag(text or "")
        return model.bias + float(model.table[at].astype(float) @ weight) >= 0

    docs = [(i, t) for i, t in docs if not toxic(t)]
    firsts = {component for _, _, component in similar_documents(docs)}
    docs = [(i, t) for i, t in docs if i in firsts]
    hit = {row[0] for row in shared_passages(docs, items) if row[5]}
    docs = [(i, t) for i, t in docs if i not in hit]
    cut = {}
    for i, t in docs:
        groups = []
        for start, end in sorted([(start, end) for start, end, _ in base_spans(t)] + secrets.random_strings(t)):
            if groups and start < groups[-1][1]:
                groups[-1][1] = max(end, groups[-1][1])
            else:
                groups.append([start, end])
        for start, end in reversed(groups):
            t = t[:start] + "<SECRET>" + t[end:]
        cut[i] = t
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(cut) and len(cut) < 200
    encoder = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    sequences = {}
    for i, text in cut.items():
        parts = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == i)
        assert [x for _, ids in parts for x in ids] == [*encoder.encode(text, add_special_tokens=False).ids, 2], i
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 4096
