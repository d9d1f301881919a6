"""Object stores made by git itself and by the library's own writer."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from lumenseek.functions import codec, gitformat, hashing
from lumenseek.operators import indexer, notes
from lumenseek.operators.embedders import ConstantEmbedder
from lumenseek.operators.store import Store
from lumenseek.sources import gitfiles, gitobjects


def git(root, *args, data=None):
    done = subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, input=data)
    return done.stdout.decode().strip()


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git(root, "init", "-q", "-b", "main")
    git(root, "config", "user.name", "t")
    git(root, "config", "user.email", "t@example.com")
    return root


def grow(root, versions=12, files=6, seed=3):
    """Files that change a little with each commit, so that packing makes delta chains."""
    rng = random.Random(seed)
    texts = {f"{'src/deep/er' if i % 2 else 'docs'}/f{i}.txt": [f"line {j} of file {i} with some words {rng.random()}" for j in range(200)] for i in range(files)}
    for v in range(versions):
        for name, lines in texts.items():
            lines[rng.randrange(len(lines))] = f"changed in version {v}: {rng.random()}"
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text("\n".join(lines) + "\n")
        git(root, "add", "-A")
        git(root, "commit", "-qm", f"v{v}")


def all_objects(root):
    out = {}
    for line in git(root, "cat-file", "--batch-all-objects", "--batch-check").splitlines():
        sha, kind, size = line.split()
        out[sha] = kind, int(size)
    return out


def read_all(spark, root, few):
    ids = gitobjects.located(spark, str(root), idsperpartition="50").select("id").distinct()
    before, gitobjects.FEW_IDS = gitobjects.FEW_IDS, few
    try:
        return gitobjects.contents(ids, str(root)).collect()
    finally:
        gitobjects.FEW_IDS = before


@pytest.mark.parametrize("few", [0, 10**6])
def test_packs_with_delta_chains_and_loose_objects(spark, repo, few):
    grow(repo)
    git(repo, "gc", "-q", "--aggressive")
    # chains of references to ids as well as to offsets
    assert int(git(repo, "verify-pack", "-s", *map(str, (repo / ".git/objects/pack").glob("*.idx"))).count("chain length")) > 0
    (repo / "loose.txt").write_text("not packed yet\n")
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "loose")
    expected = all_objects(repo)
    found = read_all(spark, repo, few)
    assert {r["id"]: (r["kind"], len(r["content"])) for r in found} == expected
    assert all(gitformat.object_id(r["kind"], bytes(r["content"])) == r["id"] for r in found)


def test_bases_named_by_id_and_bare_repositories(spark, repo, tmp_path):
    grow(repo, 6, 3)
    # without offset deltas a pack names bases by id
    names = git(repo, "rev-list", "--objects", "--all")
    bare = tmp_path / "bare.git"
    git(tmp_path, "init", "-q", "--bare", str(bare))
    pack = subprocess.run(["git", "-C", str(repo), "-c", "repack.usedeltabaseoffset=false", "pack-objects", "--stdout", "-q"], input="\n".join(n.split()[0] for n in names.splitlines()).encode() + b"\n", capture_output=True, check=True).stdout
    subprocess.run(["git", "-C", str(bare), "index-pack", "--stdin"], input=pack, capture_output=True, check=True)
    assert {r["id"]: (r["kind"], len(r["content"])) for r in read_all(spark, bare, 0)} == all_objects(repo)


def test_missing_repeated_and_null_ids(spark, repo):
    grow(repo, 2, 2)
    sha = git(repo, "rev-parse", "HEAD:docs/f0.txt")
    wanted = spark.createDataFrame([(1, sha), (2, "0" * 40), (3, sha), (4, None), (5, "no id")], "n int, id string")
    for few in (0, 10):
        before, gitobjects.FEW_IDS = gitobjects.FEW_IDS, few
        found = {r["n"]: r["content"] for r in gitobjects.contents(wanted, str(repo)).collect()}
        gitobjects.FEW_IDS = before
        assert bytes(found[1]) == bytes(found[3]) == (repo / "docs/f0.txt").read_bytes() and found[2] is found[4] is found[5] is None and len(found) == 5


def test_damaged_objects_end_the_query(spark, repo):
    (repo / "a.txt").write_text("some text\n")
    git(repo, "add", "-A")
    sha = git(repo, "rev-parse", ":a.txt")
    path = repo / ".git/objects" / sha[:2] / sha[2:]
    path.chmod(0o644)
    import zlib

    path.write_bytes(zlib.compress(b"blob 10\0other text"))
    with pytest.raises(Exception, match="other bytes"):
        gitobjects.contents(spark.createDataFrame([(sha,)], "id string"), str(repo)).collect()


def test_files_of_any_revision_without_a_work_tree(spark, repo):
    grow(repo, 3, 4)
    old = git(repo, "rev-parse", "HEAD~2")
    git(repo, "gc", "-q")
    for revision in ("HEAD", old):
        expected = {}
        for line in git(repo, "ls-tree", "-r", revision).splitlines():
            meta, path = line.split("\t")
            expected[path] = meta.split()[2]
        found = gitobjects.revision_files(spark, str(repo), revision).collect()
        assert {r["path"]: r["blob_sha"] for r in found} == expected
        assert all(gitfiles.blob_sha(bytes(r["content"])) == r["blob_sha"] for r in found)
    with pytest.raises(ValueError, match="no revision"):
        gitobjects.revision_files(spark, str(repo), "nothing")


def test_branch_switch_embeds_only_what_is_new(spark, repo, tmp_path):
    """Two revisions share most contents; the second one's index embeds the rest, with no work tree read."""
    store = Store(spark, str(tmp_path / "store"), "constant", 2)
    (repo / "a.txt").write_text("alpha authentication token\n")
    (repo / "b.txt").write_text("beta virtual machine\n")
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "one")
    (repo / "a.txt").write_text("rotated browser session\n")
    git(repo, "commit", "-qam", "two")
    first = indexer.index(spark, gitobjects.revision_files(spark, str(repo), "HEAD~1"), store, ConstantEmbedder())
    second = indexer.index(spark, gitobjects.revision_files(spark, str(repo)), store, ConstantEmbedder())
    assert (first.blobs_embedded, second.blobs_embedded, second.blobs_already_cached) == (2, 1, 1)


@pytest.mark.parametrize("version", [2, 4])
def test_index_in_blocks(spark, repo, version):
    for i in range(300):
        path = repo / f"d{i % 7}" / f"é file {i}.txt"
        path.parent.mkdir(exist_ok=True)
        path.write_text(f"{i}\n")
    git(repo, "config", "index.version", str(version))
    git(repo, "config", "index.threads", "3")
    git(repo, "add", "-A")
    assert (repo / ".git/index").read_bytes()[7] == version
    expected = sorted(gitfiles.list_tracked(str(repo)))
    assert gitobjects.index_files(spark, str(repo)).rdd.getNumPartitions() == 3
    assert sorted((r["path"], r["blob_sha"]) for r in gitobjects.index_files(spark, str(repo)).collect()) == expected


def test_index_of_an_empty_work_tree_and_unmerged_paths(spark, repo):
    assert gitobjects.index_files(spark, str(repo)).count() == 0
    (repo / "a.txt").write_text("base\n")
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "base")
    git(repo, "checkout", "-qb", "side")
    (repo / "a.txt").write_text("one\n")
    git(repo, "commit", "-qam", "one")
    git(repo, "checkout", "-q", "main")
    (repo / "a.txt").write_text("two\n")
    git(repo, "commit", "-qam", "two")
    subprocess.run(["git", "-C", str(repo), "merge", "side"], capture_output=True)
    assert sorted(r["stage"] for r in gitobjects.index_files(spark, str(repo)).collect()) == [1, 2, 3]


def test_our_packs_are_read_by_git(spark, tmp_path):
    root = gitobjects.new_repository(str(tmp_path / "made.git"))
    rows = spark.range(500).select(F.concat(F.lit("d"), (F.col("id") % 9).cast("string"), F.lit("/x/f"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("text "), (F.col("id") % 450).cast("string")).cast("binary").alias("content"))
    files = rows.select("path", F.lit(0o100644).alias("mode"), hashing.git_blob_sha(F.col("content")).alias("blob_sha"))
    gitobjects.write_packs(rows.select(F.lit("blob").alias("kind"), "content"), root)
    trees, top = gitobjects.trees(files)
    gitobjects.write_packs(trees, root)
    assert git(root, "fsck", "--full", "--strict") is not None
    listed = {line.split("\t")[1]: line.split()[2] for line in git(root, "ls-tree", "-r", top).splitlines()}
    assert listed == {r["path"]: r["blob_sha"] for r in files.collect()}
    assert {r["path"]: r["blob_sha"] for r in gitobjects.tree_files(spark, root, top).collect()} == listed
    empty = gitobjects.trees(files.limit(0))
    assert empty[1] == "4b825dc642cb6eb9a060e54bf8d69288fbee4904" and gitobjects.write_packs(rows.limit(0).select(F.lit("blob").alias("kind"), "content"), root) == 0


def test_vectors_kept_as_notes_are_taken_over(spark, repo, tmp_path):
    """A cache that lies in git: payloads at two digits, a slash, the rest of the id. Other entries and payloads of another length are left out."""
    entries = []
    for i, (sha, payload) in enumerate([("1" * 40, codec.pack_payload(2, [(1, 3), (2, 5)], [[1, 0], [0, 1]])), ("2" * 40, codec.pack_payload(2, [], [])), ("3" * 40, codec.pack_payload(3, [(1, 1)], [[1, 0, 0]])), ("4" * 40, b"damaged")]):
        blob = git(repo, "hash-object", "-w", "--stdin", data=payload)
        entries.append(f"100644 blob {blob}\t{sha[:2]}/{sha[2:]}")
    entries.append(f"100644 blob {blob}\tREADME")
    for line in entries:
        meta, path = line.split("\t")
        git(repo, "update-index", "--add", "--cacheinfo", f"100644,{meta.split()[2]},{path}")
    tree = git(repo, "write-tree")
    git(repo, "update-ref", "refs/notes/cache/constant", git(repo, "commit-tree", tree, "-m", "notes"))
    store = Store(spark, str(tmp_path / "store"), "constant", 2)
    assert notes.take_over(spark, str(repo), "refs/notes/cache/constant", store) == 2
    assert sorted((r["blob_sha"][0], r["chunk_idx"], r["start_line"], r["end_line"], list(r["embedding"])) for r in store.vectors().collect()) == [("1", 0, 1, 3, [1.0, 0.0]), ("1", 1, 2, 5, [0.0, 1.0])]
    assert store.known().count() == 2
