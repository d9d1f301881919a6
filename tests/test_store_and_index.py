"""The behaviours of an incremental, content-addressed, append-only store, over real git repositories."""

import subprocess
import threading

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.functions import col, concat, lit

from lumenseek import cli
from lumenseek.functions import codec
from lumenseek.operators import indexer, search, stats
from lumenseek.operators import store as stores
from lumenseek.operators.embedders import ConstantEmbedder, HashEmbedder
from lumenseek.operators.store import Store
from lumenseek.sources import gitfiles, tables
from lumenseek.streaming import continuous


def git(root, *args):
    return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git(root, "init", "-q")
    git(root, "config", "user.name", "t")
    git(root, "config", "user.email", "t@example.com")
    return root


def commit(root, **files):
    for name, text in files.items():
        (root / name.replace("__", ".")).write_bytes(text.encode())
    git(root, "add", "-A")
    git(root, "commit", "-qm", "c")
    return git(root, "rev-parse", "HEAD")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), "constant", 2)


def run(spark, root, store, model=None, **options):
    return indexer.index(spark, gitfiles.read(spark, str(root), content=True), store, model or ConstantEmbedder(), **options)


FIRST = {"a__txt": "alpha authentication token\n", "b__txt": "beta virtual machine provisioning\n"}


def test_branch_switches_embed_nothing_twice(spark, repo, store):
    first = commit(repo, **FIRST)
    assert run(spark, repo, store).blobs_embedded == 2
    commit(repo, a__txt="rotated browser authentication session\n")
    assert run(spark, repo, store).blobs_embedded == 1
    git(repo, "checkout", "-q", first)
    again = run(spark, repo, store)
    assert (again.blobs_embedded, again.blobs_already_cached, again.blobs_pruned) == (0, 2, 0)
    assert store.blobs().count() == 3
    files = gitfiles.read(spark, str(repo))
    assert store.vectors(files.select("blob_sha")).count() == 2
    assert "2 unique, 2 cached, 0 embedded" in str(again)


def test_interrupted_run_keeps_finished_groups(spark, repo, store):
    commit(repo, **FIRST)

    class FailsOnSecond(ConstantEmbedder):
        def embed(self, texts):
            if any("beta" in t for t in texts) == first_is_alpha:
                raise RuntimeError("as asked")
            return super().embed(texts)

    shas = {r["path"]: r["blob_sha"] for r in gitfiles.read(spark, str(repo)).collect()}
    first_is_alpha = shas["a.txt"] < shas["b.txt"]
    with pytest.raises(Exception, match="as asked"):
        run(spark, repo, store, FailsOnSecond(), group_chunks=1)
    assert store.blobs().count() == 1
    assert run(spark, repo, store, group_chunks=1).blobs_embedded == 1
    assert store.files.names(f"{store.location}/staging") == []


def test_empty_files_are_known_without_chunks(spark, repo, store):
    commit(repo, empty__txt="", code__txt="virtual machine provisioning\n")
    first = run(spark, repo, store)
    assert (first.blobs_embedded, first.blobs_skipped, first.chunks_embedded) == (2, 0, 1)
    second = run(spark, repo, store)
    assert (second.blobs_already_cached, second.blobs_embedded) == (2, 0)


def test_filtered_content_is_keyed_by_the_index(spark, repo, store):
    (repo / ".gitattributes").write_text("*.txt text\n")
    (repo / "filtered.txt").write_bytes(b"first\r\nsecond line\r\n")
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "c")
    row = gitfiles.read(spark, str(repo), content=True).first()
    assert row["path"] == "filtered.txt" and row["blob_sha"] != gitfiles.blob_sha(bytes(row["content"]))
    first = run(spark, repo, store)
    assert (first.blobs_embedded, first.blobs_skipped) == (1, 0)
    assert run(spark, repo, store).blobs_already_cached == 1


def test_modified_and_deleted_files(spark, repo):
    commit(repo, **FIRST, c__txt="to be deleted soon\n")
    (repo / "a.txt").write_text("changed on disk only\n")
    (repo / "c.txt").unlink()
    rows = {r["path"]: r for r in gitfiles.read(spark, str(repo)).collect()}
    assert set(rows) == {"a.txt", "b.txt"}
    assert rows["a.txt"]["raw_sha"] and rows["a.txt"]["blob_sha"] == gitfiles.blob_sha(b"changed on disk only\n")
    assert not rows["b.txt"]["raw_sha"]


def test_unmerged_path_gives_its_rows_once(spark, repo):
    base = commit(repo, a__txt="base of all\n")
    git(repo, "checkout", "-qb", "side")
    commit(repo, a__txt="one side of it\n")
    git(repo, "checkout", "-q", base)
    commit(repo, a__txt="the other side\n")
    subprocess.run(["git", "-C", str(repo), "merge", "side"], capture_output=True)
    assert gitfiles.read(spark, str(repo)).count() == 1
    assert gitfiles.read(spark, str(repo), unmerged="keep").count() == 3


def entry(spark, sha, dim=2):
    chunks = spark.createDataFrame([(sha, 0, 1, 1, [1.0] + [0.0] * (dim - 1))], "blob_sha string, chunk_idx int, start_line int, end_line int, embedding array<float>")
    return chunks, spark.createDataFrame([(sha, stores.VERSION, dim, 1)], stores.BLOBS)


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    barrier, errors = threading.Barrier(2), []

    def write(sha):
        try:
            mine = Store(spark, str(tmp_path / "store"), "constant", 2)
            rows = entry(spark, sha)
            barrier.wait()
            mine.commit(*rows)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(c * 40,)) for c in "12"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    both = Store(spark, str(tmp_path / "store"), "constant", 2)
    assert {r[0] for r in both.vectors().select("blob_sha").collect()} == {"1" * 40, "2" * 40} and both.head().number == 2


def test_damaged_entries_heal(spark, repo, store):
    commit(repo, **FIRST)
    run(spark, repo, store)
    files = gitfiles.read(spark, str(repo))
    sha = files.where("path = 'a.txt'").first()["blob_sha"]
    store.commit(blobs=spark.createDataFrame([(sha, 99, 2, 1)], stores.BLOBS))
    assert run(spark, repo, store).blobs_embedded == 0  # damaged still counts as known
    assert search.search_store(spark, store, files, [1.0, 0.0]).count() == 1
    assert store.blobs().count() == 1
    assert run(spark, repo, store).blobs_embedded == 1 and store.blobs().count() == 2
    assert search.search_store(spark, store, files, [1.0, 0.0]).count() == 2


def test_validity_checks_rows(spark, store):
    for sha, dim, version, n in (("1" * 40, 2, 1, 1), ("2" * 40, 3, 1, 1), ("3" * 40, 2, 2, 1), ("4" * 40, 2, 1, 2)):
        chunks, _ = entry(spark, sha, dim)
        store.commit(chunks, spark.createDataFrame([(sha, version, dim, n)], stores.BLOBS))
    store.commit(blobs=spark.createDataFrame([("5" * 40, 1, 2, 0), ("meta", 1, 2, 0)], stores.BLOBS))
    assert [r[0][0] for r in store.vectors().select("blob_sha").collect()] == ["1"]
    assert store.known().where("blob_sha = 'meta'").count() == 0 and store.known().count() == 5


def test_removed_blobs_and_insert_beats_delete(spark, store):
    one, two = entry(spark, "1" * 40), entry(spark, "2" * 40)
    store.commit(*one)
    store.commit(*two)
    store.remove(two[1])
    assert store.blobs().count() == 1 and store.vectors().count() == 1
    store.commit(*two, deletes=two[1].select("blob_sha"))
    assert store.blobs().count() == 2 and store.vectors().count() == 2
    assert store.commit().number == store.head().number  # nothing to do


def test_gc_clear_and_models(spark, tmp_path, store):
    other = Store(spark, store.location, "other", 2)
    other.commit(*entry(spark, "9" * 40))
    for c in "123":
        store.commit(*entry(spark, c * 40))
    store.remove(spark.createDataFrame([("3" * 40,)], "blob_sha string"))
    before = store.head().id
    assert store.gc(vacuum=True)[0] == before
    assert len(store.head().snaps) == 1 and store.blobs().count() == 2 and store.vectors().count() == 2
    assert store.clear() and not store.clear() and store.blobs().count() == 0
    assert other.blobs().count() == 1 and Store(spark, store.location, "none", 2).gc() is None


def test_push_pull_merge(spark, tmp_path, store):
    remote = str(tmp_path / "remote")
    store.commit(*entry(spark, "1" * 40))
    assert stores.push(spark, store.location, remote) == ["constant"]
    far = Store(spark, remote, "constant", 2)
    far.commit(*entry(spark, "2" * 40))
    store.commit(*entry(spark, "3" * 40))
    with pytest.raises(stores.Diverged):
        stores.push(spark, store.location, remote)
    third = Store(spark, str(tmp_path / "third"), "constant", 2)
    stores.pull(spark, third.location, remote)
    assert third.blobs().count() == 2
    stores.merge(spark, third.location, store.location)
    assert {r[0][0] for r in third.vectors().select("blob_sha").collect()} == {"1", "2", "3"}
    stores.push(spark, store.location, remote, force=True)
    assert {r[0][0] for r in far.blobs().select("blob_sha").collect()} == {"1", "3"}
    assert stores.configure_remote(spark, store.location, "origin", remote) and not stores.configure_remote(spark, store.location, "origin", remote)
    assert stores.remote_url(spark, store.location, "origin") == remote


def test_progress_is_logged_by_group(spark, store, caplog):
    files = spark.createDataFrame([(f"f{i}.txt", f"{i:040d}", False, f"content of file number {i}".encode()) for i in range(4)], "path string, blob_sha string, raw_sha boolean, content binary")
    indexer.index(spark, files, store, ConstantEmbedder(), group_chunks=2, quiet=False, verbose=True)
    assert [r.message for r in caplog.records] == ["[embed] constant · batch 1", "[index] embedding 4 chunks across 4 unique blobs in groups of ≤2...", "[index] ... group 1 done (2 chunks total)", "[index] ... group 2 done (4 chunks total)"]
    caplog.clear()
    more = files.withColumn("blob_sha", concat(lit("a"), col("blob_sha").substr(2, 39)))
    indexer.index(spark, more, store, ConstantEmbedder(), group_chunks=3, quiet=False)
    assert [r.message for r in caplog.records][-2:] == ["indexing: 3/4 chunks (75%)", "indexing: 4/4 chunks (100%)"]


def test_payload_export(spark, store):
    store.commit(*entry(spark, "1" * 40))
    store.commit(blobs=spark.createDataFrame([("2" * 40, 1, 2, 0)], stores.BLOBS))
    found = {r["blob_sha"][0]: codec.unpack_payload(bytes(r["payload"])) for r in store.payloads().collect()}
    assert found["1"][:2] == (2, [(1, 1)]) and found["1"][2].tolist() == [[1.0, 0.0]] and found["2"][1] == []


def test_manifests_stay_small_and_still_tell_divergence(spark, tmp_path, store, monkeypatch):
    monkeypatch.setattr(stores, "FULL_EVERY", 10)
    ids = [store._publish(lambda head, i=i: [*head.snaps, {"id": f"s{i}", "kinds": []}]).id for i in range(64)]
    head = store.head()
    assert [s["id"] for s in head.snaps] == [f"s{i}" for i in range(64)] and head.number == 64 and store.ancestors(head) == set(ids[:-1])
    sizes = [store.files.lengths(store._manifests())[f"{i:010d}.json"] for i in range(1, 65)]
    assert sum(n > 250 for n in sizes) <= 7 and max(sizes) < 3000
    remote = str(tmp_path / "remote")
    stores.push(spark, store.location, remote)
    far = Store(spark, remote, "constant", 2)
    assert far.head().id == head.id and far.ancestors(far.head()) == store.ancestors(head)
    other = Store(spark, str(tmp_path / "other"), "constant", 2)
    stores.pull(spark, other.location, remote)
    mine = other._publish(lambda head: [*head.snaps, {"id": "more", "kinds": []}])
    assert other.ancestors(mine) == set(ids)
    # an old head of the other side is known although it came over by a pull
    stores.push(spark, other.location, remote)
    store._publish(lambda head: [*head.snaps, {"id": "apart", "kinds": []}])
    with pytest.raises(stores.Diverged):
        stores.push(spark, store.location, remote)
    store._publish(lambda head: [])
    assert store.head().snaps == [] and len(store.ancestors(store.head())) == 65


def test_changed_files_are_examined_again(spark, store):
    for c in "123":
        store.commit(*entry(spark, c * 40))
    wanted = store.known()
    assert store.heal(wanted) == 0
    snap = store.head().snaps[1]["id"]
    # the vectors of one snapshot are replaced behind the store's back
    chunks, _ = entry(spark, "2" * 40, 3)
    chunks.write.mode("overwrite").parquet(store._data("vectors", snap))
    again = Store(spark, store.location, "constant", 2)
    assert [r[0][0] for r in again.invalid(wanted).collect()] == ["2"] and again.heal(wanted) == 1
    assert sorted(r["blob_sha"][0] for r in again.vectors().collect()) == ["1", "3"] and again.known().count() == 2


def test_a_search_reads_the_vectors_once_and_shuffles_none(spark, store, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"{i:040x}", 0, 1, 1, [float(x) for x in rng.normal(size=2)]) for i in range(60)]
    store.commit(spark.createDataFrame(rows, stores.VECTORS), spark.createDataFrame([(r[0], 1, 2, 1) for r in rows], stores.BLOBS))
    store.remove(spark.createDataFrame([(rows[5][0],)], "blob_sha string"))
    files = spark.createDataFrame([(f"d{i % 3}/f{i}.txt", r[0]) for i, r in enumerate(rows)], "path string, blob_sha string")
    found = {}
    for most in (500_000, 0):
        monkeypatch.setattr("lumenseek.operators.joins.BROADCAST_ROWS", most)
        hits = search.search_store(spark, store, files, [1.0, 0.5], 7, "d1/")
        plan = hits._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        nodes = plan.split("\n\n")
        assert not [n for n in nodes if "Exchange" in n.split("\n")[0] and "embedding" in n]
        assert sum("embedding" in n and "Scan parquet" in n.split("\n")[0] for n in nodes) == 1
        found[most] = [tuple(r) for r in hits.collect()]
    expected = sorted(((1.0 * v[0] + 0.5 * v[1], f"d{i % 3}/f{i}.txt") for i, (_, _, _, _, v) in enumerate(rows) if i % 3 == 1 and i != 5), reverse=True)[:7]
    assert found[0] == found[500_000] and [h[0] for h in found[0]] == [p for _, p in expected]


def test_a_broken_copy_goes_on_where_it_stopped(spark, tmp_path, store):
    store.commit(*entry(spark, "1" * 40))
    store.commit(*entry(spark, "2" * 40))
    remote = tmp_path / "remote"
    far = Store(spark, str(remote), "constant", 2)
    snaps = store.head().snaps
    stores.push(spark, store.location, str(remote))
    import pathlib

    def data(location):
        return {p.relative_to(location): p.read_bytes() for p in sorted(pathlib.Path(location).rglob("*.parquet")) if not p.name.startswith(".")}

    assert data(remote) == data(store.location)
    whole = sorted(pathlib.Path(far._data("vectors", snaps[0]["id"])).glob("*.parquet"))[0]
    size = whole.stat().st_size
    whole.write_bytes(whole.read_bytes()[: size // 2])
    kept = sorted(pathlib.Path(far._data("vectors", snaps[1]["id"])).glob("*.parquet"))[0]
    stamp = kept.stat().st_mtime_ns
    stores._copy_model(spark, store, far)
    assert data(remote) == data(store.location) and kept.stat().st_mtime_ns == stamp
    assert not [p for p in remote.rglob(".part*") if not p.name.endswith(".crc")]


def greedy(sizes, most):
    """The groups' numbers, blob by blob: a group ends before a blob that would take it over ``most``, and once it has ``most``."""
    out, number, held = [], 0, 0
    for sha, n in sorted(sizes):
        if held and held + n > most:
            number, held = number + 1, 0
        out.append((sha, n, number))
        held += n
        if held >= most:
            number, held = number + 1, 0
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=12), max_size=6), st.integers(1, 12))
def test_cuts_go_on_from_range_to_range(ranges, most):
    number, held, found = 0, 0, []
    for sizes in ranges:
        cuts, held = indexer.greedy_cuts(np.array(sizes, np.int64), held, most)
        found += [number + sum(c <= i for c in cuts) for i in range(len(sizes))]
        number += len(cuts)
    flat = [(f"{i:03d}", n) for i, n in enumerate(n for r in ranges for n in r)]
    assert found == [g for _, _, g in greedy(flat, most)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), min_size=1, max_size=6), st.integers(1, 12))
def test_carry_functions_compose_to_the_greedy_cut(ranges, most):
    for sizes in ranges:
        f = indexer.carry_function(np.array(sizes, np.int64), most)
        assert len(f.start) <= most + 1 and f.start[0] == 0
        for held in range(most):
            cuts, left = indexer.greedy_cuts(np.array(sizes, np.int64), held, most)
            assert indexer.apply(f, held) == (len(cuts), left)
    functions = [indexer.carry_function(np.array(sizes, np.int64), most) for sizes in ranges]
    for ordered in (lambda fs: [indexer.compose(a, b) for a, b in zip(fs[::2], fs[1::2])] + fs[len(fs) // 2 * 2 :],):
        while len(functions) > 1:
            functions = ordered(functions)
    flat = np.array([n for sizes in ranges for n in sizes], np.int64)
    for held in range(most):
        cuts, left = indexer.greedy_cuts(flat, held, most)
        assert indexer.apply(functions[0], held) == (len(cuts), left)


def test_groups_are_the_greedy_ones(spark):
    import hashlib

    sizes = [(hashlib.sha1(str(i).encode()).hexdigest(), 90 if i % 40 == 3 else i % 7) for i in range(300)]
    rows = indexer.checkpoint_groups(spark.createDataFrame(sizes, "blob_sha string, n bigint"), 50).orderBy("blob_sha").collect()
    assert [tuple(r) for r in rows] == greedy(sizes, 50)
    assert indexer.checkpoint_groups(spark.createDataFrame([], "blob_sha string, n bigint"), 5).count() == 0


def test_directory_and_stream(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "sub" / "a.md").write_text("hello spark search words")
    files = tables.from_directory(spark, str(tmp_path / "d"))
    assert [r["path"] for r in files.collect()] == ["sub/a.md"]
    inbox = str(tmp_path / "inbox")
    store = Store(spark, str(tmp_path / "s"), "hash-8", 8)
    for n in (1, 2):
        spark.createDataFrame([(i, f"document number {i} of the stream") for i in range(n * 2)], "id bigint, text string").write.mode("append").parquet(inbox)
        stream = continuous.table_stream(spark, inbox, "id bigint, text string", "concat('doc', id, '.txt')", "text")
        query = continuous.index_stream(stream, store, HashEmbedder(8), str(tmp_path / "ck"))
        query.awaitTermination()
        assert store.blobs().count() == n * 2
    assert store.vectors().count() == 4


def test_report_and_cli(spark, repo, capsys):
    commit(repo, **FIRST)
    base = ["--repo", str(repo), "--model", "hash-32"]
    assert cli.main([*base, "index", "-q"], spark) == 0
    assert "2 embedded" in capsys.readouterr().out
    cli.main([*base, "authentication", "token", "-k", "1", "--json"], spark)
    import json

    hits = json.loads(capsys.readouterr().out)
    assert [h["path"] for h in hits] == ["a.txt"] and list(hits[0]) == ["path", "start_line", "end_line", "score", "blob_sha", "chunk_idx"]
    cli.main([*base, "search", "beta", "machine", "--show", "-k", "1", "--no-auto-index"], spark)
    out = capsys.readouterr().out
    assert "b.txt:1-1" in out and "    beta virtual machine provisioning" in out
    cli.main([*base, "stats"], spark)
    assert "2/2 current cached (2 total cache entries)" in capsys.readouterr().out
    cli.main([*base, "gc"], spark)
    assert "collapsed history" in capsys.readouterr().out
    cli.main([*base, "clear"], spark)
    assert "deleted hash-32" in capsys.readouterr().out
    with pytest.raises(ValueError, match="query is empty"):
        cli.main([*base, "search"], spark)
    assert cli.main([], spark) == 0


def test_source_fails_outside_a_tree(spark, tmp_path):
    with pytest.raises(Exception, match="rev-parse"):
        gitfiles.read(spark, str(tmp_path)).count()


def test_counts(spark):
    files = spark.createDataFrame([("a.py", "1"), ("b.py", "1"), ("c.py", "2"), ("bin", "3")], "path string, blob_sha string")
    blobs = spark.createDataFrame([("1", 1, 2, 3), ("9", 1, 2, 1)], stores.BLOBS)
    assert tuple(stats.store_counts(files, blobs, 2).first()) == (3, 2, 1, 3, 12 + 24 + 24, 2)
