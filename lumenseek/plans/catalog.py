"""Named queries over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenseek.functions import chunking, formatting, hashing, paths, udtf, vectors
from lumenseek.operators import embedders, indexer, notes, search, shared, stats
from lumenseek.operators import store as stores
from lumenseek.operators.store import Store
from lumenseek.sources import corpus, gitobjects, interchange, tables

DIM = 64
PREFIX = "src1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files by source and language, pages as .html files by host, conversations' turns as .md files, and some paths that are left out."""
    docs = _table(spark, sf_dir, "documents")
    pages = _table(spark, sf_dir, "pages")
    talks = _table(spark, sf_dir, "conversations")
    return (
        tables.documents_as_files(docs)
        .unionByName(tables.from_table(pages, F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html")))
        .unionByName(tables.from_table(talks, F.concat(F.lit("talks/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("_"), "role", F.lit(".md")), F.col("text")))
    )


_SQL_FILES = """files AS (
  SELECT path, text, sha1('blob ' || strlen(text) || chr(0) || text) AS blob_sha FROM (
    SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text FROM documents
    UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages
    UNION ALL SELECT 'talks/' || conv_id || '/' || turn || '_' || role || '.md', text FROM conversations))"""
_SQL_DOCS = """docs AS (
  SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, doc_id, text, sha1('blob ' || strlen(text) || chr(0) || text) AS blob_sha FROM documents)"""
_SQL_LINES = """lined AS (
  SELECT *, CASE WHEN ls[-1] = '' AND len(ls) > 1 THEN ls[:-2] ELSE ls END AS l
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM blobs WHERE strlen(text) BETWEEN 16 AND 1000000 AND NOT contains(text[:8192], chr(0)))),
windows AS (
  SELECT *, k * 16 + 1 AS start_line, least(k * 16 + 20, len(l)) AS end_line
  FROM (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((len(l) - 20) / 16.0) AS BIGINT)))) AS k FROM lined))"""
_SQL_BODY = "array_to_string(l[start_line:end_line], chr(10))"
_SQL_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def _docs(spark, sf_dir):
    return tables.documents_as_files(_table(spark, sf_dir, "documents"))


def _blobs(files: DataFrame) -> DataFrame:
    return files.groupBy("blob_sha").agg(F.min_by("content", "path").alias("content"))


def _embeddings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The embeddings as a vector table, and the paths that hold its blobs: one each, and a second one for every third."""
    rows = _table(spark, sf_dir, "embeddings")
    sha = F.sha1(F.col("vec_id").cast("string").cast("binary"))
    vectors_ = rows.select(sha.alias("blob_sha"), F.lit(0).alias("chunk_idx"), F.lit(1).alias("start_line"), F.lit(20).alias("end_line"), "embedding", "vec_id", "label")
    one = rows.select(F.concat(F.lit("src"), F.col("label").cast("string"), F.lit("/v"), F.col("vec_id").cast("string"), F.lit(".py")).alias("path"), sha.alias("blob_sha"))
    two = rows.where("vec_id % 3 = 0").select(F.concat(F.lit("copy/v"), F.col("vec_id").cast("string"), F.lit(".py")).alias("path"), sha.alias("blob_sha"))
    return vectors_, one.union(two)


_SQL_VECTORS = """vecs AS (SELECT sha1(CAST(vec_id AS VARCHAR)) AS blob_sha, embedding, vec_id, label FROM embeddings),
paths AS (
  SELECT 'src' || label || '/v' || vec_id || '.py' AS path, blob_sha FROM vecs
  UNION ALL SELECT 'copy/v' || vec_id || '.py', blob_sha FROM vecs WHERE vec_id % 3 = 0),
q AS (SELECT embedding AS qvec FROM embeddings WHERE vec_id = 0)"""
_SQL_SCORE = _SQL_DOT.format(a="embedding", b="qvec")


def _query_vector(spark, sf_dir) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def scan_textual_files(spark, sf_dir):
    files = _files(spark, sf_dir)
    odd = files.select(F.concat(F.lit("x/node_modules/"), "path").alias("path"), "blob_sha").union(files.select(F.concat("path", F.lit(".lock")), "blob_sha")).union(files.select(F.concat("path", F.lit("_README")), "blob_sha"))
    return files.select("path", "blob_sha").union(odd).where(paths.is_textual(F.col("path")))


def git_blob_sha(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", hashing.git_blob_sha(F.col("text")).alias("blob_sha"), F.octet_length("text").cast("bigint").alias("n_bytes"))


def distinct_blobs(spark, sf_dir):
    return _files(spark, sf_dir).agg(F.count("*").alias("files"), F.count_distinct("blob_sha").alias("blobs"))


def canonical_path(spark, sf_dir):
    return indexer.canonical(_files(spark, sf_dir)).select("blob_sha", "path")


def paths_per_blob(spark, sf_dir):
    grouped = _docs(spark, sf_dir).groupBy("blob_sha").agg(F.array_sort(F.collect_list("path")).alias("p"))
    return grouped.where(F.size("p") > 1).select("blob_sha", F.size("p").cast("bigint").alias("n"), F.array_join("p", ",").alias("paths"))


def modified_files(spark, sf_dir):
    """Files of every seventh document are modified on disk, of every 49th unreadable."""
    docs = _table(spark, sf_dir, "documents")
    files = _docs(spark, sf_dir)
    listed = files.select("path", F.col("blob_sha").alias("index_sha"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    changed = docs.where("doc_id % 7 = 0").select(path.alias("path"), F.when(F.col("doc_id") % 49 != 0, hashing.git_blob_sha(F.concat("text", F.lit("\n")))).alias("disk_sha"))
    return indexer.resolved(listed, changed)


def chunk_ranges(spark, sf_dir):
    return chunking.with_chunks(_blobs(_files(spark, sf_dir))).select("blob_sha", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def chunk_texts(spark, sf_dir):
    return chunking.with_chunks(_blobs(_docs(spark, sf_dir))).select("blob_sha", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "text")


def chunk_stats(spark, sf_dir):
    chunks = chunking.with_chunks(_blobs(_docs(spark, sf_dir)))
    return chunks.agg(F.count("*").alias("chunks"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.max("end_line").cast("bigint").alias("last_line"))


def _known(spark, sf_dir):
    """The contents of documents with even ids."""
    return _table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(hashing.git_blob_sha(F.col("text")).alias("blob_sha")).distinct()


def index_todo(spark, sf_dir):
    return indexer.todo(_docs(spark, sf_dir), _known(spark, sf_dir)).select("blob_sha", "path")


def index_cached(spark, sf_dir):
    return _docs(spark, sf_dir).select("blob_sha").distinct().join(_known(spark, sf_dir), "blob_sha", "left_semi")


def index_stats(spark, sf_dir):
    files, known = _docs(spark, sf_dir), _known(spark, sf_dir)
    new = indexer.todo(files, known)
    chunks = chunking.with_chunks(_blobs(files).join(new.select("blob_sha"), "blob_sha", "left_semi"))
    return (
        files.agg(F.count("*").alias("files_total"), F.count_distinct("blob_sha").alias("blobs_unique"))
        .crossJoin(index_cached(spark, sf_dir).agg(F.count("*").alias("blobs_already_cached")))
        .crossJoin(new.agg(F.count("*").alias("blobs_embedded")))
        .crossJoin(chunks.agg(F.count("*").alias("chunks_embedded")))
    )


def checkpoint_groups(spark, sf_dir):
    files = _docs(spark, sf_dir)
    sizes = chunking.with_chunks(_blobs(files)).groupBy("blob_sha").agg(F.count("*").alias("n"))
    return indexer.checkpoint_groups(sizes, 64)


def l2_norms(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.l2_norm(F.col("embedding")), 6).alias("norm"))


def l2_normalize(spark, sf_dir):
    """Vectors stretched by their label, made unit again, plus their sum as a check."""
    rows = _table(spark, sf_dir, "embeddings")
    stretched = F.transform("embedding", lambda x: x * F.col("label"))
    unit = vectors.l2_normalize(stretched)
    return rows.select("vec_id", F.round(vectors.l2_norm(unit), 5).alias("norm"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def hash_embed(spark, sf_dir):
    """The hashed stand-in's vector of each document, as bucket and value of what is not zero."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = embedders.embed_column(rows, embedders.HashEmbedder(DIM)).select("doc_id", F.posexplode("embedding").alias("bucket", "value"))
    return found.where("value <> 0").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("value").cast("double"), 5).alias("value"))


def topk_inner_product(spark, sf_dir):
    rows, _ = _embeddings(spark, sf_dir)
    found = search.top_k(search.scored(rows, vectors.literal(_query_vector(spark, sf_dir))), 10)
    return found.select("blob_sha", F.round("score", 6).alias("score"))


def topk_scan(spark, sf_dir):
    """The same winners from the Arrow scan."""
    rows, _ = _embeddings(spark, sf_dir)
    return search.scan_top_k(rows, _query_vector(spark, sf_dir), 10).select("blob_sha", F.round("score", 6).alias("score"))


def topk_prefix_filter(spark, sf_dir):
    rows, files = _embeddings(spark, sf_dir)
    found = search.scan_top_k(search.candidates(rows, files, PREFIX), _query_vector(spark, sf_dir), 10)
    return found.select("blob_sha", F.round("score", 6).alias("score"))


def topk_fanout_paths(spark, sf_dir):
    rows, files = _embeddings(spark, sf_dir)
    hits = search.search(rows, files, _query_vector(spark, sf_dir), 12)
    return hits.select("path", "blob_sha", F.round("score", 6).alias("score"))


def topk_batch(spark, sf_dir):
    rows, _ = _embeddings(spark, sf_dir)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return search.search_many(rows, queries, 5).select("qid", F.col("rank").cast("bigint").alias("rank"), "blob_sha", F.round("score", 6).alias("score"))


def _document_hits(spark, sf_dir) -> DataFrame:
    """Documents with the text of benchmark item 0 as the query, by the hashed stand-in."""
    files = _docs(spark, sf_dir)
    model = embedders.HashEmbedder(DIM)
    text = _table(spark, sf_dir, "benchmark").where("item_id = 0").first()["text"]
    rows = embedders.embed_column(chunking.with_chunks(_blobs(files)), model)
    return search.search(rows, files, model.embed([text])[0].tolist(), 10)


def search_documents(spark, sf_dir):
    return _document_hits(spark, sf_dir).select("path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.round("score", 4).alias("score"))


def show_lines(spark, sf_dir):
    shown = search.show_lines(_document_hits(spark, sf_dir), _docs(spark, sf_dir))
    return shown.select("path", F.col("start_line").cast("bigint").alias("start_line"), F.array_join("lines", "\n").alias("shown"))


def hits_json(spark, sf_dir):
    rows, files = _embeddings(spark, sf_dir)
    hits = search.search(rows, files, _query_vector(spark, sf_dir), 10)
    return hits.withColumn("score", F.round(F.col("score") * 1000).cast("bigint")).select("path", formatting.hit_json().alias("hit"))


def hits_text(spark, sf_dir):
    rows, files = _embeddings(spark, sf_dir)
    hits = search.search(rows, files, _query_vector(spark, sf_dir), 10)
    return hits.select("path", formatting.hit_text().alias("hit"))


def store_stats(spark, sf_dir):
    files = _files(spark, sf_dir)
    sizes = chunking.with_chunks(_blobs(files)).groupBy("blob_sha").agg(F.count("*").cast("int").alias("n_chunks"))
    blobs = sizes.join(_known(spark, sf_dir), "blob_sha", "left_semi")
    return stats.store_counts(files.where(paths.under_prefix(F.col("path"), PREFIX)), blobs, DIM)


def corpus_extract(spark, sf_dir):
    return stats.corpus(_docs(spark, sf_dir)).select("blob_sha", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.octet_length("text").cast("bigint").alias("n_bytes"))


def compare_runs(spark, sf_dir):
    """The embeddings against themselves, moved a little by their label."""
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.transform("embedding", lambda x: (x.cast("double") * (1 + F.col("label") / 100)).cast("double"))
    found = stats.compare_runs(rows.select(F.col("vec_id").alias("seq"), "embedding"), rows.select(F.col("vec_id").alias("seq"), moved.alias("embedding")))
    return found.select(F.round("mean", 5).alias("mean"), F.round("worst", 5).alias("worst"), "n")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(spark, rows: DataFrame, n_chunks=None) -> Store:
    """A fresh store of vector rows, one chunk a blob, whose entries tell ``n_chunks``."""
    store = Store(spark, _scratch(spark, "store"), f"vectors-{DIM}", DIM)
    entries = rows.select("blob_sha", F.lit(stores.VERSION).alias("version"), F.lit(DIM).alias("dim"), (F.lit(1) if n_chunks is None else n_chunks).cast("int").alias("n_chunks"))
    store.commit(rows, entries)
    return store


def merge_stores(spark, sf_dir):
    """Union of two stores that overlap in every sixth blob."""
    rows, _ = _embeddings(spark, sf_dir)
    mine, theirs = _stored(spark, rows.where("vec_id % 2 = 0")), _stored(spark, rows.where("vec_id % 3 = 0"))
    stores.merge(spark, mine.location, theirs.location)
    return mine.vectors().select("blob_sha", F.col("chunk_idx").cast("bigint").alias("chunk_idx"))


def store_heal(spark, sf_dir):
    """What a search may read of a store in which every seventh entry tells more chunks than it has, and how many entries healing drops."""
    rows, _ = _embeddings(spark, sf_dir)
    store = _stored(spark, rows, F.when(F.col("vec_id") % 7 == 0, 2).otherwise(1))
    sound = store.sound_vectors(rows.select("blob_sha"))
    dropped = rows.count() - store.known().count()
    return sound.select("blob_sha", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.lit(dropped).cast("bigint").alias("dropped"))


def store_gc(spark, sf_dir):
    """What is live after every fifth blob was removed, every tenth came back and the history was collapsed, and how many snapshots hold it."""
    rows, _ = _embeddings(spark, sf_dir)
    store = _stored(spark, rows)
    store.remove(rows.where("vec_id % 5 = 0").select("blob_sha"))
    again = rows.where("vec_id % 10 = 0")
    store.commit(again, again.select("blob_sha", F.lit(stores.VERSION).alias("version"), F.lit(DIM).alias("dim"), F.lit(1).alias("n_chunks")))
    store.gc(vacuum=True)
    return store.vectors().select("blob_sha", F.round(vectors.l2_norm(F.col("embedding")), 4).alias("norm"), F.lit(len(store.head().snaps)).cast("bigint").alias("snapshots"))


def store_payloads(spark, sf_dir):
    """The binary payloads of the even blobs: their bytes, and the header's magic, version, dim and count."""
    rows, _ = _embeddings(spark, sf_dir)
    found = _stored(spark, rows).payloads(rows.where("vec_id % 2 = 0").select("blob_sha"))
    return found.select("blob_sha", F.octet_length("payload").cast("bigint").alias("n_bytes"), F.lower(F.hex(F.substring("payload", 1, 12))).alias("header"))


def incremental_index(spark, sf_dir):
    """Index documents with even ids, then all, in a fresh store; the counts of both runs."""
    files = _docs(spark, sf_dir)
    even = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint") % 2 == 0
    store = Store(spark, _scratch(spark, "store"), f"hash-{DIM}", DIM)
    model = embedders.HashEmbedder(DIM)
    runs = [indexer.index(spark, files.where(even), store, model), indexer.index(spark, files, store, model)]
    entries = store.blobs().count()
    rows = [(i, s.files_total, s.blobs_unique, s.blobs_already_cached, s.blobs_embedded, s.blobs_skipped, s.chunks_embedded, entries) for i, s in enumerate(runs)]
    return spark.createDataFrame(rows, "run bigint, files_total bigint, blobs_unique bigint, blobs_already_cached bigint, blobs_embedded bigint, blobs_skipped bigint, chunks_embedded bigint, entries bigint")


def git_contents(spark, sf_dir):
    """Documents' contents from a git object store, by id: packs that tasks wrote, and an id for every tenth document that the store lacks."""
    docs = _docs(spark, sf_dir)
    path = gitobjects.new_repository(_scratch(spark, "objects"))
    gitobjects.write_packs(docs.select(F.lit("blob").alias("kind"), "content"), path)
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint")
    lost = docs.where(number % 10 == 0).select(F.sha1(F.concat(F.lit("lost "), number.cast("string")).cast("binary")).alias("id"))
    found = gitobjects.contents(docs.select(F.col("blob_sha").alias("id")).union(lost), path)
    return found.select(F.col("id").alias("blob_sha"), "kind", F.octet_length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("md5"))


def git_revision_files(spark, sf_dir):
    """Documents as files of a tree, two levels of folders deep, walked from its root without a work tree."""
    docs = _docs(spark, sf_dir)
    path = gitobjects.new_repository(_scratch(spark, "objects"))
    fan = F.sha1(F.col("path").cast("binary"))
    named = docs.select(F.concat_ws("/", F.substring(fan, 1, 2), F.substring(fan, 3, 1), F.substring_index("path", "/", -1)).alias("path"), "blob_sha", "content")
    trees, root = gitobjects.trees(named.select("path", F.lit(0o100644).alias("mode"), "blob_sha"))
    gitobjects.write_packs(named.select(F.lit("blob").alias("kind"), "content").unionByName(trees.select("kind", "content")), path)
    files = gitobjects.tree_files(spark, path, root)
    read = gitobjects.contents(files.withColumnRenamed("blob_sha", "id"), path)
    return read.select("path", F.col("id").alias("blob_sha"), F.octet_length("content").cast("bigint").alias("n_bytes"))


def notes_take_over(spark, sf_dir):
    """The even blobs' vectors, exported as payloads into a git tree at two digits, a slash and the rest of the id, and taken over into a fresh store."""
    rows, _ = _embeddings(spark, sf_dir)
    payloads = _stored(spark, rows).payloads(rows.where("vec_id % 2 = 0").select("blob_sha"))
    path = gitobjects.new_repository(_scratch(spark, "objects"))
    trees, root = gitobjects.trees(payloads.select(hashing.entry_path(F.col("blob_sha")).alias("path"), F.lit(0o100644).alias("mode"), hashing.git_blob_sha(F.col("payload")).alias("blob_sha")))
    gitobjects.write_packs(payloads.select(F.lit("blob").alias("kind"), F.col("payload").alias("content")).unionByName(trees.select("kind", "content")), path)
    store = Store(spark, _scratch(spark, "store"), f"vectors-{DIM}", DIM)
    taken = notes.take_over_tree(spark, path, root, store)
    return store.vectors().select("blob_sha", "chunk_idx", "start_line", "end_line", F.round(vectors.l2_norm(F.col("embedding")), 4).alias("norm"), F.lit(taken).cast("bigint").alias("taken"))


def push_and_pull(spark, sf_dir):
    """What a third store has after a first one was pushed, changed and pushed again, and pulled; and whether a push over foreign changes was refused."""
    rows, _ = _embeddings(spark, sf_dir)
    mine = _stored(spark, rows.where("vec_id % 3 = 0"))
    remote, third = _scratch(spark, "store"), _scratch(spark, "store")
    stores.push(spark, mine.location, remote)
    mine.remove(rows.where("vec_id % 6 = 0").select("blob_sha"))
    stores.push(spark, mine.location, remote)
    stores.pull(spark, third, remote)
    other = _stored(spark, rows.where("vec_id % 5 = 0"))
    try:
        stores.push(spark, other.location, remote)
        refused = False
    except stores.Diverged:
        refused = True
    return Store(spark, third, mine.model, DIM).vectors().select("blob_sha", F.round(vectors.l2_norm(F.col("embedding")), 4).alias("norm"), F.lit(refused).alias("refused"))


def search_stored(spark, sf_dir):
    """The ten best below a prefix, from a store in which every seventh entry is damaged and every fifth was removed."""
    rows, files = _embeddings(spark, sf_dir)
    store = _stored(spark, rows, F.when(F.col("vec_id") % 7 == 0, 2).otherwise(1))
    store.remove(rows.where("vec_id % 5 = 0").select("blob_sha"))
    hits = search.search_store(spark, store, files, _query_vector(spark, sf_dir), 10, PREFIX)
    return hits.select("path", "blob_sha", F.round("score", 6).alias("score"))


def chunk_windows(spark, sf_dir):
    """Line windows of pages by the table function, as SQL users call it."""
    udtf.register(spark)
    pages = tables.from_table(_table(spark, sf_dir, "pages"), F.col("page_id").cast("string"), F.col("html"))
    name = f"pages_{uuid.uuid4().hex}"
    pages.createOrReplaceTempView(name)
    return spark.sql(f"SELECT CAST(path AS BIGINT) AS page_id, CAST(w.chunk_idx AS BIGINT) AS chunk_idx, w.text FROM {name}, LATERAL chunk_windows(content) AS w")


def corpus_round_trip(spark, sf_dir):
    """The chunks of all documents, written as corpus files by tasks and read back in stretches."""
    chunks = interchange.with_seq(chunking.with_chunks(_blobs(_docs(spark, sf_dir))).select("blob_sha", "chunk_idx", "text"))
    path = _scratch(spark, "corpus")
    corpus.write(chunks, path)
    found = corpus.read(spark, path, splitbytes="1000000")
    totals = found.groupBy("file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("file", before.alias("base"))  # a row for each file
    return found.join(F.broadcast(base), "file").select((F.col("base") + F.col("seq")).alias("seq"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("md5"))


_QUERIES = [git_contents, git_revision_files, notes_take_over, push_and_pull, search_stored, chunk_windows, corpus_round_trip, scan_textual_files, git_blob_sha, distinct_blobs, canonical_path, paths_per_blob, modified_files, chunk_ranges, chunk_texts, chunk_stats, index_todo, index_cached, index_stats, checkpoint_groups, l2_norms, l2_normalize, hash_embed, topk_inner_product, topk_scan, topk_prefix_filter, topk_fanout_paths, topk_batch, search_documents, show_lines, hits_json, hits_text, store_stats, corpus_extract, compare_runs, merge_stores, store_heal, store_gc, store_payloads, incremental_index]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_SQL_KNOWN = "known AS (SELECT DISTINCT sha1('blob ' || strlen(text) || chr(0) || text) AS blob_sha FROM documents WHERE doc_id % 2 = 0)"
_SQL_HASHED = """
tokens AS (SELECT blob_sha, k, start_line, end_line, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM cut),
counts AS (SELECT blob_sha, k, start_line, end_line, CAST('0x' || substr(md5(w), 1, 4) AS INT) % 64 AS bucket, count(*) AS c FROM tokens GROUP BY ALL),
unit AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY blob_sha, k)) AS v FROM counts),
qt AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM benchmark WHERE item_id = 0),
qc AS (SELECT CAST('0x' || substr(md5(w), 1, 4) AS INT) % 64 AS bucket, count(*) AS c FROM qt GROUP BY ALL),
qu AS (SELECT bucket, CAST(c / sqrt(sum(c * c) OVER ()) AS FLOAT) AS qv FROM qc),
scored AS (SELECT blob_sha, k, start_line, end_line, sum(CAST(CAST(v AS FLOAT) AS DOUBLE) * CAST(qv AS DOUBLE)) AS score FROM unit JOIN qu USING (bucket) GROUP BY ALL),
winners AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, blob_sha, k LIMIT 10)"""
# the first bytes of a text that end with a whole character: cut at 1,000 bytes, less the bytes of a character that was cut through
_SQL_CUT = """cut AS (
  SELECT blob_sha, k, start_line, end_line, CASE WHEN strlen(b) <= 1000 THEN b ELSE b[:(SELECT max(n) FROM (SELECT unnest(range(250, 1001)) AS n) WHERE strlen(b[:n]) <= 1000)] END AS body
  FROM (SELECT *, {body} AS b FROM windows))""".format(body=_SQL_BODY)
_SQL_DOC_CHUNKS = f"{_SQL_DOCS}, blobs AS (SELECT blob_sha, any_value(text) AS text FROM docs GROUP BY blob_sha), {_SQL_LINES}"


def oracle_sql() -> dict[str, str]:
    textual = paths.sql_is_textual("path")
    top10 = f"WITH {_SQL_VECTORS}, s AS (SELECT blob_sha, {_SQL_SCORE} AS score FROM vecs, q) SELECT blob_sha, round(score, 6) AS score FROM s ORDER BY s.score DESC, blob_sha LIMIT 10"
    hits = f"WITH {_SQL_VECTORS}, s AS (SELECT blob_sha, {_SQL_SCORE} AS score FROM vecs, q), w AS (SELECT * FROM s ORDER BY score DESC, blob_sha LIMIT 10)"
    return {
        "scan_textual_files": f"""WITH {_SQL_FILES}, every AS (
            SELECT path, blob_sha FROM files UNION ALL SELECT 'x/node_modules/' || path, blob_sha FROM files
            UNION ALL SELECT path || '.lock', blob_sha FROM files UNION ALL SELECT path || '_README', blob_sha FROM files)
            SELECT path, blob_sha FROM every WHERE {textual}""",
        "git_blob_sha": "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob_sha, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents",
        "distinct_blobs": f"WITH {_SQL_FILES} SELECT count(*) AS files, count(DISTINCT blob_sha) AS blobs FROM files",
        "canonical_path": f"WITH {_SQL_FILES} SELECT blob_sha, min(path) AS path FROM files GROUP BY blob_sha",
        "paths_per_blob": f"WITH {_SQL_DOCS} SELECT blob_sha, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM docs GROUP BY blob_sha HAVING count(*) > 1",
        "modified_files": f"""WITH {_SQL_DOCS} SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha1('blob ' || (strlen(text) + 1) || chr(0) || text || chr(10)) ELSE blob_sha END AS blob_sha, doc_id % 7 = 0 AS raw_sha
            FROM docs WHERE doc_id % 49 <> 0""",
        "chunk_ranges": f"WITH {_SQL_FILES}, blobs AS (SELECT blob_sha, any_value(text) AS text FROM files GROUP BY blob_sha), {_SQL_LINES} SELECT blob_sha, k AS chunk_idx, start_line, end_line FROM windows",
        "chunk_texts": f"WITH {_SQL_DOC_CHUNKS}, {_SQL_CUT} SELECT blob_sha, k AS chunk_idx, body AS text FROM cut",
        "chunk_stats": f"WITH {_SQL_DOC_CHUNKS}, {_SQL_CUT} SELECT count(*) AS chunks, CAST(sum(strlen(body)) AS BIGINT) AS bytes, max(end_line) AS last_line FROM cut",
        "index_todo": f"WITH {_SQL_DOCS}, {_SQL_KNOWN} SELECT blob_sha, min(path) AS path FROM docs WHERE blob_sha NOT IN (SELECT blob_sha FROM known) GROUP BY blob_sha",
        "index_cached": f"WITH {_SQL_DOCS}, {_SQL_KNOWN} SELECT DISTINCT blob_sha FROM docs WHERE blob_sha IN (SELECT blob_sha FROM known)",
        "index_stats": f"""WITH {_SQL_DOC_CHUNKS}, {_SQL_KNOWN}
            SELECT (SELECT count(*) FROM docs) AS files_total, (SELECT count(DISTINCT blob_sha) FROM docs) AS blobs_unique,
              (SELECT count(*) FROM known) AS blobs_already_cached,
              (SELECT count(DISTINCT blob_sha) FROM docs WHERE blob_sha NOT IN (SELECT blob_sha FROM known)) AS blobs_embedded,
              (SELECT count(*) FROM windows WHERE blob_sha NOT IN (SELECT blob_sha FROM known)) AS chunks_embedded""",
        "checkpoint_groups": f"""WITH RECURSIVE {_SQL_DOC_CHUNKS}, sizes AS (SELECT blob_sha, count(*) AS n, row_number() OVER (ORDER BY blob_sha) AS i FROM windows GROUP BY blob_sha),
            walk AS (
              SELECT i, blob_sha, n, n AS held, CAST(0 AS BIGINT) AS g FROM sizes WHERE i = 1
              UNION ALL SELECT s.i, s.blob_sha, s.n, CASE WHEN w.held >= 64 OR w.held > 0 AND w.held + s.n > 64 THEN s.n ELSE w.held + s.n END,
                CASE WHEN w.held >= 64 OR w.held > 0 AND w.held + s.n > 64 THEN w.g + 1 ELSE w.g END
              FROM walk w JOIN sizes s ON s.i = w.i + 1)
            SELECT blob_sha, n, g AS "group" FROM walk""",
        "l2_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings",
        "l2_normalize": """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * label) AS v FROM embeddings),
            n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s)
            SELECT vec_id, CASE WHEN norm > 0 THEN 1.0 ELSE 0.0 END AS norm, round(CASE WHEN norm > 0 THEN list_sum(v) / norm ELSE 0 END, 4) AS total FROM n""",
        "hash_embed": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM documents),
            c AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 4) AS INT) % 64 AS bucket, count(*) AS c FROM t GROUP BY ALL)
            SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, round(CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM c""",
        "topk_inner_product": top10,
        "topk_scan": top10,
        "topk_prefix_filter": f"""WITH {_SQL_VECTORS}, s AS (SELECT blob_sha, {_SQL_SCORE} AS score FROM vecs, q WHERE blob_sha IN (SELECT blob_sha FROM paths WHERE starts_with(path, '{PREFIX}')))
            SELECT blob_sha, round(score, 6) AS score FROM s ORDER BY s.score DESC, blob_sha LIMIT 10""",
        "topk_fanout_paths": hits.replace("LIMIT 10", "LIMIT 12") + " SELECT path, blob_sha, round(score, 6) AS score FROM w JOIN paths USING (blob_sha)",
        "topk_batch": f"""WITH {_SQL_VECTORS}, b AS (SELECT vec_id AS qid, embedding AS qvec FROM vecs WHERE vec_id % 20 = 0),
            s AS (SELECT qid, blob_sha, {_SQL_SCORE} AS score FROM vecs, b),
            r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, blob_sha) AS rank FROM s)
            SELECT qid, rank, blob_sha, round(score, 6) AS score FROM r WHERE rank <= 5""",
        "search_documents": f"WITH {_SQL_DOC_CHUNKS}, {_SQL_CUT}, {_SQL_HASHED} SELECT path, start_line, end_line, round(score, 4) AS score FROM winners JOIN docs USING (blob_sha)",
        "show_lines": f"""WITH {_SQL_DOC_CHUNKS}, {_SQL_CUT}, {_SQL_HASHED}
            SELECT path, start_line, array_to_string(string_split(text, chr(10))[start_line:end_line], chr(10)) AS shown FROM winners JOIN docs USING (blob_sha)""",
        "hits_json": hits + """ SELECT path, '{"path":"' || path || '","start_line":1,"end_line":20,"score":' || CAST(round(score * 1000) AS BIGINT) || ',"blob_sha":"' || blob_sha || '","chunk_idx":0}' AS hit FROM w JOIN paths USING (blob_sha)""",
        "hits_text": hits + " SELECT path, printf('%.4f  %s:%d-%d', score, path, 1, 20) AS hit FROM w JOIN paths USING (blob_sha)",
        "store_stats": f"""WITH {_SQL_FILES}, blobs AS (SELECT blob_sha, any_value(text) AS text FROM files GROUP BY blob_sha), {_SQL_LINES}, {_SQL_KNOWN},
            cached AS (SELECT blob_sha, count(*) AS n FROM windows WHERE blob_sha IN (SELECT blob_sha FROM known) GROUP BY blob_sha),
            cur AS (SELECT path, blob_sha FROM files WHERE starts_with(path, '{PREFIX}') AND {textual}),
            cc AS (SELECT * FROM cached WHERE blob_sha IN (SELECT blob_sha FROM cur))
            SELECT (SELECT count(*) FROM cur) AS files, (SELECT count(DISTINCT blob_sha) FROM cur) AS blobs_current, (SELECT count(*) FROM cc) AS blobs_cached,
              CAST((SELECT coalesce(sum(n), 0) FROM cc) AS BIGINT) AS chunks, CAST((SELECT coalesce(sum(12 + 8 * n + 4 * n * 64), 0) FROM cc) AS BIGINT) AS payload_bytes, (SELECT count(*) FROM cached) AS entries""",
        "corpus_extract": f"WITH {_SQL_DOC_CHUNKS}, {_SQL_CUT} SELECT blob_sha, k AS chunk_idx, CAST(strlen(body) AS BIGINT) AS n_bytes FROM cut",
        "compare_runs": """WITH c AS (SELECT list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * (1 + label / 100.0) AS c FROM embeddings)
            SELECT round(avg(c), 5) AS mean, round(min(c), 5) AS worst, count(*) AS n FROM c""",
        "git_contents": f"""WITH {_SQL_DOCS} SELECT blob_sha, 'blob' AS kind, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS md5 FROM docs
            UNION ALL SELECT sha1('lost ' || doc_id), NULL, NULL, NULL FROM docs WHERE doc_id % 10 = 0""",
        "git_revision_files": f"""WITH {_SQL_DOCS} SELECT substr(sha1(path), 1, 2) || '/' || substr(sha1(path), 3, 1) || '/doc_' || doc_id || '.txt' AS path, blob_sha, CAST(strlen(text) AS BIGINT) AS n_bytes FROM docs""",
        "notes_take_over": """SELECT sha1(CAST(vec_id AS VARCHAR)) AS blob_sha, CAST(0 AS INT) AS chunk_idx, CAST(1 AS INT) AS start_line, CAST(20 AS INT) AS end_line,
            round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, count(*) OVER () AS taken FROM embeddings WHERE vec_id % 2 = 0""",
        "push_and_pull": """SELECT sha1(CAST(vec_id AS VARCHAR)) AS blob_sha, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, true AS refused
            FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 6 <> 0""",
        "search_stored": f"""WITH {_SQL_VECTORS}, s AS (SELECT blob_sha, {_SQL_SCORE} AS score FROM vecs, q WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND blob_sha IN (SELECT blob_sha FROM paths WHERE starts_with(path, '{PREFIX}'))),
            w AS (SELECT * FROM s ORDER BY score DESC, blob_sha LIMIT 10) SELECT path, blob_sha, round(score, 6) AS score FROM w JOIN paths USING (blob_sha) WHERE starts_with(path, '{PREFIX}')""",
        "chunk_windows": f"WITH blobs AS (SELECT page_id AS blob_sha, html AS text FROM pages), {_SQL_LINES}, {_SQL_CUT} SELECT blob_sha AS page_id, k AS chunk_idx, body AS text FROM cut",
        "corpus_round_trip": f"WITH {_SQL_DOC_CHUNKS}, {_SQL_CUT} SELECT row_number() OVER (ORDER BY blob_sha, k) - 1 AS seq, CAST(strlen(body) AS BIGINT) AS n_bytes, md5(body) AS md5 FROM cut",
        "merge_stores": "SELECT sha1(CAST(vec_id AS VARCHAR)) AS blob_sha, CAST(0 AS BIGINT) AS chunk_idx FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0",
        "store_heal": "SELECT sha1(CAST(vec_id AS VARCHAR)) AS blob_sha, CAST(0 AS BIGINT) AS chunk_idx, (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) AS dropped FROM embeddings WHERE vec_id % 7 <> 0",
        "store_gc": """SELECT sha1(CAST(vec_id AS VARCHAR)) AS blob_sha, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, CAST(1 AS BIGINT) AS snapshots
            FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 10 = 0""",
        "store_payloads": "SELECT sha1(CAST(vec_id AS VARCHAR)) AS blob_sha, CAST(12 + 8 + 4 * len(embedding) AS BIGINT) AS n_bytes, '56475250' || '0100' || '4000' || '01000000' AS header FROM embeddings WHERE vec_id % 2 = 0",
        "incremental_index": f"""WITH {_SQL_DOC_CHUNKS}, {_SQL_KNOWN}, ev AS (SELECT * FROM docs WHERE doc_id % 2 = 0)
            SELECT CAST(0 AS BIGINT) AS run, (SELECT count(*) FROM ev) AS files_total, (SELECT count(*) FROM known) AS blobs_unique, CAST(0 AS BIGINT) AS blobs_already_cached, (SELECT count(*) FROM known) AS blobs_embedded, CAST(0 AS BIGINT) AS blobs_skipped,
              (SELECT count(*) FROM windows WHERE blob_sha IN (SELECT blob_sha FROM known)) AS chunks_embedded, (SELECT count(DISTINCT blob_sha) FROM docs) AS entries
            UNION ALL SELECT 1, (SELECT count(*) FROM docs), (SELECT count(DISTINCT blob_sha) FROM docs), (SELECT count(*) FROM known), (SELECT count(DISTINCT blob_sha) FROM docs WHERE blob_sha NOT IN (SELECT blob_sha FROM known)), 0,
              (SELECT count(*) FROM windows WHERE blob_sha NOT IN (SELECT blob_sha FROM known)), (SELECT count(DISTINCT blob_sha) FROM docs)""",
    }
