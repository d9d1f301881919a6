import functools
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenseek.llm import common, packing, simple8b, tokens

BYTES, WORDS = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")


@functools.cache
def whole(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab Zé\n\t.,'s1  ́ΣİK\0\r|<>"), max_size=40), max_size=6))
def test_cut_texts_have_the_ids_of_whole_texts(path, texts):
    ids, counts = tokens.encoder(path).ids(texts)
    expected = [e.ids for e in whole(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.pieces_of(ids, counts)] == expected


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_documents_have_the_ids_of_whole_texts(spark, path, sf_dir):
    texts = [r[0] for r in common.table(spark, sf_dir, "documents").select("text").collect()] + [t or "" for t in AWKWARD] + ["<|endoftext|> it's  <|startoftext|>"]
    ids, counts = tokens.encoder(path).ids(texts)
    for e, got in zip(whole(path).encode_batch(texts, add_special_tokens=False), tokens.pieces_of(ids, counts)):
        assert e.ids == got.tolist()


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=60, deadline=None)
@given(words=st.lists(st.text(st.sampled_from("abZéßÿñ×÷µªΣİ1_#.,'’"), min_size=1, max_size=9), max_size=30), most=st.integers(2, 40))
def test_words_with_marks_have_the_ids_of_whole_texts(path, words, most):
    encoder = FEW.setdefault(path, tokens.Encoder(path))
    encoder.most = most
    texts = [" ".join(words), "\n".join(words)]
    ids, counts = encoder.ids(texts)
    assert [x.tolist() for x in tokens.pieces_of(ids, counts)] == [e.ids for e in whole(path).encode_batch(texts, add_special_tokens=False)]


FEW: dict[str, tokens.Encoder] = {}


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cache_is_bounded_and_keeps_what_comes_again(path):
    encoder = tokens.Encoder(path, 60)
    plain = whole(path)
    for k in range(10):
        texts = [" ".join(f"w{k * 7 + i}" for i in range(30)), "x" * 100 + f" {k}", "common words here"]
        ids, counts = encoder.ids(texts)
        assert [x.tolist() for x in tokens.pieces_of(ids, counts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert len(encoder.slots) <= 60 and not any(len(p) > tokens.CACHE_CHARS for p in encoder.slots)
    assert "common" in encoder.slots


def test_each_piece_is_encoded_once_a_call_however_long_another_is():
    encoder = tokens.Encoder(BYTES)
    asked, plain, joined = [], encoder._plain, encoder.words.ids
    encoder._plain = lambda pieces: asked.extend(pieces) or plain(pieces)
    encoder.words.ids = lambda pieces: asked.extend(pieces) or joined(pieces)
    encoder.ids(["some words, x1 " + "y" * 200 + " some words, x1"])
    assert sorted(asked) == sorted(["some", " words", ",", " x1", " " + "y" * 200, " some"])
    asked.clear()
    encoder.ids([" some words. x1"])
    assert asked == ["."]


def test_an_encoder_takes_the_bound_of_its_last_caller():
    assert tokens.encoder(BYTES, 10).most == 10 and tokens.encoder(BYTES).most == tokens.CACHE_PIECES


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, blocks, escapes, escaped = simple8b.encode(v)
    assert (simple8b.decode(words, escapes, escaped) == v).all() and len(escapes) == sum(x >= 1 << 60 for x in values)
    assert len(blocks) == -(-len(v) // simple8b.BLOCK) + 1 and blocks[-1] == len(words)


def test_blocks_decode_alone_and_words_are_full():
    v = np.random.default_rng(1).integers(0, 50_000, 10_000).astype(np.uint64)
    words, blocks, _, _ = simple8b.encode(v)
    for k in range(len(blocks) - 1):
        assert (simple8b.decode(words[int(blocks[k]) : int(blocks[k + 1])]) == v[k * 1024 : (k + 1) * 1024]).all()
    assert len(words) < len(v) / 2.9
    ones, _, _, _ = simple8b.encode(np.ones(960, np.uint64))
    assert len(ones) == 16


def test_segments_tell_damage():
    data = simple8b.segment(3, 40, [5, None, 9], np.array([2, 0, 1]), np.array([7, 2, 2], np.uint64)) + simple8b.END
    (found,) = simple8b.read_segments(data)
    assert (found.part, found.before, found.doc_ids, found.counts.tolist(), found.ids().tolist()) == (3, 40, [5, None, 9], [2, 0, 1], [7, 2, 2])
    for bad in (data[:40], b"x" + data, data[:70] + bytes([data[70] ^ 1]) + data[71:]):
        with pytest.raises(ValueError):
            list(simple8b.read_segments(bad))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.integers(0, 5000), st.integers(0, 2**32))
def test_any_ids_of_a_segment_are_read_from_their_blocks_alone(a, b, seed):
    v = np.random.default_rng(seed).integers(0, 1 << 20, 5000).astype(np.uint64)
    v[::701] += np.uint64(1 << 62)
    (found,) = simple8b.read_segments(simple8b.segment(0, 0, [1, 2], np.array([2000, 3000]), v) + simple8b.END)
    assert (found.ids(a, b) == v[a:b]).all() and (found.ids() == v).all()


def test_small_files_in_several_segments(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simple8b, "SEGMENT_IDS", 5_000)
    monkeypatch.setattr(simple8b, "FILE_SEGMENTS", 3)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = common.scratch_path(spark, "small-files")
    simple8b.write(docs, path, BYTES)
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r) for r in simple8b.index(spark, path).collect()) == expected_files(rows, BYTES)
    some = {d: t for d, t in rows if d % 50 == 3}
    found = {r["doc_id"]: r["ids"] for r in simple8b.ids_of(spark, path, list(some)).collect()}
    assert found == {d: [*whole(BYTES).encode(t or "", add_special_tokens=False).ids, 2] for d, t in some.items()}


def expected_files(rows, path):
    """doc_id, start, n_tokens, crc by encoding every text whole, in doc_id order."""
    plain, at, out = whole(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, r[1] or ""))):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_of_documents(spark, sf_dir):
    rows = [tuple(r) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = simple8b.op8_simple8b(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in found) == expected_files(rows, BYTES)


def test_files_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD).unionByName(documents(spark, AWKWARD, 5))
    path = common.scratch_path(spark, "awkward")
    simple8b.write(docs, path, BYTES)
    found = sorted((tuple(r) for r in simple8b.index(spark, path).collect()), key=lambda r: r[1])
    assert found == expected_files([tuple(r) for r in docs.select("doc_id", "text").collect()], BYTES)
    path = common.scratch_path(spark, "nothing")
    simple8b.write(empty(spark), path, BYTES)
    assert simple8b.index(spark, path).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(4, 33))
def test_assignment_invariants(lengths, capacity):
    placed = packing.assign(np.array(lengths, np.int64), capacity)
    check_pieces([(d, s, n, q, o, lengths[d]) for d, s, n, q, o in placed], capacity, len(lengths))
    if lengths:
        assert max(q for *_, q, _ in placed) + 1 == -(-sum(lengths) // capacity)  # as few sequences as the tokens need


def plain_assign(lengths, capacity):
    """Piece after piece, longest first, to the cheapest sequence with room; all sequences are looked at each time."""
    sequences = [[capacity, 0.0] for _ in range(-(-sum(lengths) // capacity))]
    out, waiting, full = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((d, k * capacity, capacity, full, 0))
            sequences[full], full = [0, float("inf")], full + 1
        if n % capacity:
            waiting.append((d, n - n % capacity, n % capacity))
    while waiting:
        piece = max(waiting, key=lambda w: w[2])
        waiting.remove(piece)
        d, start, n = piece
        fit = [i for i, (room, _) in enumerate(sequences) if room >= n]
        i = min(fit, key=lambda i: (sequences[i][1], i)) if fit else max(range(len(sequences)), key=lambda i: (sequences[i][0], -i))
        part = min(n, sequences[i][0])
        out.append((d, start, part, i, capacity - sequences[i][0]))
        sequences[i][0] -= part
        sequences[i][1] += packing.LINEAR_COST * part + packing.QUADRATIC_COST * part * part
        if part < n:
            waiting.append((d, start + part, n - part))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=50), st.integers(4, 40))
def test_assignment_equals_a_plain_version(lengths, capacity):
    assert packing.assign(np.array(lengths, np.int64), capacity) == plain_assign(lengths, capacity)


def check_pieces(pieces, capacity, n_docs):
    """Each id in exactly one piece, and sequences without gaps or overflow."""
    docs, sequences = {}, {}
    for d, s, n, q, o, total in pieces:
        docs.setdefault(d, []).append((s, n, total))
        sequences.setdefault(q, []).append((o, n))
    assert len(docs) == n_docs
    for parts in docs.values():
        at = 0
        for s, n, total in sorted(parts):
            assert s == at and n > 0
            at += n
        assert at == total
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity


def test_costs_are_balanced():
    rng = np.random.default_rng(3)
    lengths = rng.integers(50, 1500, 2000)
    placed = packing.assign(lengths)
    cost = np.zeros(max(p[3] for p in placed) + 1)
    for _, _, n, q, _ in placed:
        cost[q] += packing.LINEAR_COST * n + packing.QUADRATIC_COST * n * n
    first_fit = np.zeros(len(cost) + 50)
    room = np.full(len(first_fit), packing.SEQUENCE_TOKENS)
    for n in sorted(lengths.tolist(), reverse=True):
        s = int((room >= n).argmax())
        room[s] -= n
        first_fit[s] += packing.LINEAR_COST * n + packing.QUADRATIC_COST * n * n
    assert cost.std() < 0.5 * first_fit[first_fit > 0].std()


def test_packed_documents(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = packing.pack(docs, WORDS, with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_pieces([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"], r["doc_tokens"]) for r in rows], 4096, len(texts))
    plain, by_doc = whole(WORDS), {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).extend(r["ids"])
    assert all(by_doc[d] == [*plain.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items())
    used = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) * 4096 - used < 4096 * packing.pack(docs, WORDS).rdd.getNumPartitions()


def test_pack_awkward_rows(spark):
    docs = documents(spark, AWKWARD * 2).repartition(3)
    rows = packing.pack(docs, WORDS, sequence_tokens=64, chunk_tokens=500).collect()
    assert sum(r["length"] for r in rows) == sum(len(tokens.encoder(WORDS).ids([t or ""])[0]) + 1 for t in AWKWARD * 2)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_rows_of_one_doc_id_fill_several_parts(spark, monkeypatch):
    monkeypatch.setattr(simple8b, "PART_BYTES", 400)
    texts = [f"{chr(97 + i % 26)} text number {i} of one id" for i in range(120)]
    path = common.scratch_path(spark, "one-id")
    simple8b.write(spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string"), path, BYTES)
    rows = simple8b.read(spark, path).collect()
    sizes = [sum(r["part"] == p for r in rows) for p in {r["part"] for r in rows}]
    assert len(rows) == 120 and len(sizes) > 3 and max(sizes) < 60
    found = simple8b.index(spark, path).orderBy("start").collect()
    counts = [len(whole(BYTES).encode(t, add_special_tokens=False).ids) + 1 for t in sorted(texts)]
    assert [r["n_tokens"] for r in found] == counts and [r["start"] for r in found] == [sum(counts[:i]) for i in range(120)]
