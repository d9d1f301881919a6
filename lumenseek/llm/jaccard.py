"""Word-shingle Jaccard join by grouped prefixes.

A document's set is its distinct 5-word shingles. Equal sets are one node. The shingles stand in one global order, those
that many documents share last; two sets of Jaccard similarity t or more then share a shingle in their prefixes. Nodes with
the same prefix and size form a group, group pairs that share a prefix shingle are filtered by size and position, and
what is left is expanded to its members, filtered by parity bitmaps and verified on the 64-bit hashes of all shingles of the whole texts.

Only connectivity is asked for, so members of one component need no further comparison. Before the grouped join, nodes with an equal
min-hash or group are compared with one leader each, the one whose shingles are shared most: in a family of edited copies
that is the one closest to their origin. This ties large families together with one link a member; the join then only makes pairs of different components. Every step is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common, words
from lumenseek.llm.components import components

SHINGLE = 5
#: Similarity as a percentage, so that comparisons are exact.
PERCENT = 75
#: The order is by how many sets share a shingle, told approximately: by the top HASH_BITS of its hash, and sets are told
#: apart by TAG_BITS of their digest (so copies count once). Two bitmaps of 2**MAP_BITS places say which shingles are shared at all,
#: and which by many; they are filled up to MOST_MARKED. Any order gives the same result; a better one makes fewer pairs.
HASH_BITS, TAG_BITS, MAP_BITS = 32, 4, 26
LEVELS, MANY = (2, 3, 4, 6, 8, 12, 16), 8
MOST_MARKED = 1 << (MAP_BITS - 2)
CHUNK = 1_000_000
RANGE_BYTES = 4 << 20
#: Ranges are 2**MOST_RANGE_BITS at most; larger ones are counted in several passes of PASS_BYTES each.
MOST_RANGE_BITS = 18
PASS_BYTES = 8 << 20
MIN_HASHES = 3
#: Bytes up to which a table of ids is broadcast; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20
#: Pairs of one node that a task verifies in a row, and groups that share a shingle and meet in one task.
PAIRS_AT_ONCE = 100
GROUPS_AT_ONCE = 500
LEAST_BITS = 64
#: Nodes of a task and file of the tables of ids, pairs and links, at least, if there are FEW_FILES of them.
FILE_NODES, FEW_FILES = 20_000, 8
#: Text that a worker turns into shingles at once.
SLICE_BYTES = 400_000

_SEEDS = [np.uint64(x) for x in (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x6C62272E07BB0142, 0x9E3779B185EBCA87, 0x27D4EB2F165667C5)]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    found = words.of(column, words.BLACK)
    hashes, whole = words.grams(found, SHINGLE)
    sets = []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        if b - a >= SHINGLE:
            sets.append(words.distinct(hashes[a : b - SHINGLE + 1]))
        elif b > a:
            short = words.Words(found.hashes[a:b], np.array([0, b - a]))
            sets.append(words.mix(words.grams(short, b - a)[0][:1] + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(x) + len(y) - both)


def bitmap(s: np.ndarray) -> bytes:
    """Which of 2**k >= len(s) bits an odd number of the shingles fall on. Two bitmaps differ in no more bits than the sets do in shingles."""
    size = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    hit = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(n_a: int, a: bytes, n_b: int, b: bytes, percent: int = PERCENT) -> bool:
    """False only if the bitmaps prove that the sets differ in too many shingles."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # the low bits of a hash place it in every size
        longer = x if len(x) > len(y) else y
        folded = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :]
        x, y = (folded, y) if longer is x else (x, folded)
    apart = int(np.unpackbits(x ^ y).sum())
    both = (n_a + n_b - apart) // 2
    return 100 * both >= percent * (n_a + n_b - both)


def probe_length(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of n must be looked at: n - ceil(t n) + 1."""
    return n - -(-percent * n // 100) + 1


def size_bands(percent: int = PERCENT, most: int = 1 << 40) -> list[int]:
    """Least sizes of bands: of two sets of the similarity, the larger one is in the smaller one's band or the next. Bands widen by a quarter at least."""
    edges = [1, 2]
    while edges[-1] <= most:
        last = edges[-1] - 1
        edges.append(max(last + 1, last * 100 // percent, last * 5 // 4) + 1)
    return edges


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def digest(s: np.ndarray) -> bytes:
    """16 bytes that equal sets have in common."""
    return np.array([words.mix(s ^ seed).sum() for seed in _SEEDS[3:]], ">u8").tobytes()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values as 16-bit steps; 65,535 goes on with the next one."""
    steps = np.diff(values, prepend=np.uint64(0))
    more, rest = np.divmod(steps, np.uint64(65535))
    out = np.full(len(values) + int(more.sum()), 65535, "<u2")
    out[np.cumsum(more + np.uint64(1)).astype(np.int64) - 1] = rest
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, "<u2")
    return np.cumsum(steps, dtype=np.uint64)[steps != 65535]


class Marks(NamedTuple):
    """Bitmaps by the top MAP_BITS of a shingle's hash: shared by several sets, and by many."""

    some: np.ndarray
    many: np.ndarray

    def levels(self, s: np.ndarray) -> np.ndarray:
        """0, 1 or 2 for each shingle."""
        place = s >> np.uint64(64 - MAP_BITS)
        at, bit = (place >> np.uint64(3)).astype(np.int64), (place & np.uint64(7)).astype(np.uint8)
        return (self.some[at] >> bit & 1) + (self.many[at] >> bit & 1)


def shared_shingles(docs: DataFrame) -> Marks:
    """Which shingles several sets share.

    Tasks sort the hashes they see and deal them to ranges in packed form; the number of ranges follows the size of the input, and a range is
    counted pass by pass, so its memory is little more than its packed bytes. Each fills its own part of the bitmaps. The driver gets the bitmaps alone, 8 MB each at any size of input.
    """
    size = common.input_bytes(docs)
    ranges = 1 << max(4, min(MOST_RANGE_BITS, (-(-size // RANGE_BYTES) - 1).bit_length()))
    width = HASH_BITS + TAG_BITS - (ranges.bit_length() - 1)
    edges = np.arange(ranges + 1, dtype=np.uint64) << np.uint64(width)
    part = (1 << MAP_BITS) // ranges  # places of a range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def put() -> pa.RecordBatch:
            values = words.distinct(np.concatenate(held))
            at = np.searchsorted(values, edges)
            full = np.flatnonzero(np.diff(at))
            packed = [pack_sorted(values[at[i] : at[i + 1]] - edges[i]) for i in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(packed, pa.binary())], ["range", "data"])

        for batch in batches:
            for slice_ in common.slices(batch, "text", SLICE_BYTES):
                for s in shingle_sets(slice_.column("text")):
                    if len(s) > 1:
                        tag = np.uint64(digest(s)[0] & ((1 << TAG_BITS) - 1))
                        held.append((s >> np.uint64(64 - HASH_BITS)) << np.uint64(TAG_BITS) | tag)
                        n += len(s)
                if n >= CHUNK:
                    yield put()
                    held, n = [], 0
        if held:
            yield put()
        held.clear()
        common.release()

    def count(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        packed = [d.as_buffer() for c in table.column("data").chunks for d in c]
        passes = -(-sum(d.size for d in packed) // PASS_BYTES) or 1
        hits = {least: np.zeros(part, bool) for least in LEVELS}
        for k in range(passes):
            # a place is one pass's alone
            low, high = (np.uint64((part * j // passes) << (width - part.bit_length() + 1)) for j in (k, k + 1))
            found = (unpack_sorted(d) for d in packed)
            values = words.distinct(np.concatenate([v[slice(*np.searchsorted(v, [low, high]))] if passes > 1 else v for v in found]))
            if not len(values):
                continue
            tops = values >> np.uint64(TAG_BITS)
            first = np.flatnonzero(np.diff(tops, prepend=np.uint64(1 << 63)))
            sets = np.diff(np.append(first, len(values)))
            places = (tops[first] >> np.uint64(HASH_BITS - MAP_BITS)).astype(np.int64)
            for least, hit in hits.items():
                hit[places[sets >= least]] = True
        rows = [(number, least, int(hit.sum()), np.packbits(hit, bitorder="little").tobytes()) for least, hit in hits.items() if least == MANY or hit.any()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["range", "least", "n", "data"])

    dealt = docs.select("text").mapInArrow(deal, "range bigint, data binary")
    counted = common.materialize(dealt.groupBy("range").applyInArrow(count, "range bigint, least int, n bigint, data binary"), "shared", ranges)
    totals = {r["least"]: r["n"] for r in counted.groupBy("least").agg(F.sum("n").alias("n")).collect()}
    some = next((k for k in sorted(totals) if totals[k] <= MOST_MARKED), MANY)
    maps = []
    for least in (some, max(MANY, some)):
        whole = np.zeros((ranges, part // 8), np.uint8)
        for row in counted.where(F.col("least") == least).select("range", "data").collect():
            whole[row["range"]] = np.frombuffer(row["data"], np.uint8)
        maps.append(whole.ravel())
    return Marks(*maps)


def signatures(docs: DataFrame, marks: Marks, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key (hash of the text), node (digest of the set), n (its size), prefix (first shingles in the global order), gid (prefix and size), keys (min-hashes), shared (mean level of its shingles) and bits (bitmap) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column("text"))
                nodes, prefixes, groups, keys, shares, bits = [], [], [], [], [], []
                for s in sets:
                    n = len(s)
                    if not n:
                        nodes.append(None)
                        prefixes.append(None)
                        groups.append(None)
                        keys.append(None)
                        shares.append(None)
                        bits.append(None)
                        continue
                    nodes.append(digest(s))
                    keys.append(_signed(np.array([words.mix(s ^ seed).min() for seed in _SEEDS[:MIN_HASHES]])))
                    bits.append(bitmap(s))
                    level = marks.levels(s)
                    shares.append(float(level.mean()))
                    if level.any():
                        s = s[np.argsort(level, kind="stable")]
                    # a set of one shingle is similar to its equals only
                    s = s[: probe_length(n, percent)] if n > 1 else s[:0]
                    prefixes.append(_signed(s))
                    factors = words.powers(len(s) + 1)[0][: len(s)]
                    groups.append(int(_signed(words.mix(np.array([(s * factors).sum() + np.uint64(n)])))[0]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(groups, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(shares, pa.float64()), pa.array(bits, pa.binary())],
                    ["doc_id", "text_key", "node", "n", "prefix", "gid", "keys", "shared", "bits"],
                )
        common.release()

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, text_key bigint, node binary, n bigint, prefix array<bigint>, gid bigint, keys array<bigint>, shared double, bits binary")


def _sized(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows, of ids and digests, are checked to take ``BROADCAST_BYTES`` at most."""
    most = BROADCAST_BYTES // (24 + sum(40 if f.dataType.typeName() == "binary" else 8 for f in df.schema.fields))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _doc_key() -> F.Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_key")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int = PERCENT, files: int | None = None) -> DataFrame:
    """Those of the node pairs (a, b) whose sets are similar, compared on the whole texts.

    Bitmaps rule most others out first. Only texts of nodes that occur in a pair that is left are fetched, one for each.
    """
    sides = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b"))
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*x, percent) for x in zip(*columns)], pa.bool_()))

    told = pairs.join(next(sides), "a").join(next(sides), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    pairs = common.materialize(told.mapInArrow(plausible, "a binary, b binary"), "pairs", files)
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "doc_key", "text_key"), "node")
    asked_ids = common.materialize(asked, "asked", files)
    keyed = docs.select(_doc_key(), F.xxhash64("text").alias("text_key"), "text")
    texts = common.materialize(keyed.join(_sized(asked_ids), ["doc_key", "text_key"]).dropDuplicates(["node"]).select("node", "text"), "texts", files)
    # the pairs of one b are dealt to parts, and its text meets each part once; a task reads it before the texts that it is compared with
    sizes = pairs.groupBy("b").agg(F.floor((F.count("*") - 1) / PAIRS_AT_ONCE).cast("int").alias("last"))
    parts = sizes.select("b", F.explode(F.sequence(F.lit(0), "last")).alias("part"), (F.col("last") + 1).alias("parts"))
    parts = common.materialize(parts, "parts", files)
    many = _sized(parts.where("part = 0 AND parts > 1").select("b", "parts"))
    dealt = pairs.join(many, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
    others = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "text")
    leaders = parts.join(texts.withColumnRenamed("node", "b"), "b").select("b", "part", F.lit(None).cast("binary").alias("a"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, y = None, None
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column("text"))
                keys = list(zip(*(part.column(c).to_pylist() for c in ("b", "part", "a"))))
                kept = []
                for (b, number, a), x in zip(keys, sets):
                    if a is None:
                        at, y = (b, number), x
                    elif (b, number) == at and similar(x, y, percent):
                        kept.append((a, b))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*kept)], ["a", "b"])
        common.release()

    rows = others.union(leaders).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    links = common.materialize(rows.mapInArrow(run, "a binary, b binary"), "links", files)
    common.discard(pairs, asked_ids, texts, parts)
    return links


def leader_pairs(signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each node with the leader of its group and of each of its min-hashes, if their sizes allow the similarity."""
    keyed = signed.where("n > 1").select("node", "n", "shared", F.explode(F.concat(F.col("keys"), F.array("gid"))).alias("key")).distinct()
    leaders = keyed.groupBy("key").agg(F.max(F.struct("shared", "node", "n")).alias("b"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    leaders = leaders.select("key", F.col("b.node").alias("b"), F.col("b.n").alias("n_b"))
    fits = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    return keyed.join(leaders, "key").where((F.col("node") != F.col("b")) & fits).select(F.col("node").alias("a"), "b").distinct()


def group_pairs(signed: DataFrame, percent: int = PERCENT, files: int | None = None) -> DataFrame:
    """Pairs of nodes in different components that share a prefix shingle and pass the filters.

    signed: node, n, gid, prefix and comp (a hash of the component). Shingles that only one component has are dropped after a
    partial aggregation, so a shingle that a whole family of near copies shares makes no pairs.
    """
    # of two sets, each must be so small that the other's shingles from here on can make the similarity
    room = F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n")
    tokens = signed.where("n > 1").select("gid", "n", "comp", F.posexplode("prefix").alias("pos", "token"))
    several = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("token", "least")
    several = common.materialize(several, "shared-shingles", files)
    rows = tokens.join(_sized(several), "token").where(room >= F.col("least"))
    groups = rows.groupBy("token", "gid").agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    groups = common.materialize(groups, "groups", files)
    still = groups.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("token")
    groups = common.materialize(groups.join(still, "token", "left_semi").withColumn("room", room), "open-groups", files)
    # sizes in the ratio of the similarity lie in the same band or in neighbouring ones, so groups of a shingle meet band by band; the large meets of a hot one are dealt to parts
    edges = F.array(*(F.lit(e) for e in size_bands(percent)))
    groups = groups.withColumn("band", F.size(F.filter(edges, lambda e: e <= F.col("n"))))
    crowds = groups.groupBy("token", "band").agg(F.count("*").alias("size")).where(F.col("size") > GROUPS_AT_ONCE)
    crowds = _sized(common.materialize(crowds.select("token", "band", F.ceil(F.col("size") / GROUPS_AT_ONCE).cast("int").alias("parts")), "crowds", files))
    columns = ("gid", "n", "room", "lo", "hi")
    small = groups.select("token", *(F.col(c).alias(f"{c}_a") for c in columns), F.explode(F.array("band", F.col("band") + 1)).alias("band")).join(crowds, ["token", "band"], "left")
    small = small.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    large = groups.select("token", "band", *(F.col(c).alias(f"{c}_b") for c in columns)).join(crowds, ["token", "band"], "left")
    large = large.withColumn("part", F.coalesce(F.pmod(F.xxhash64("gid_b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    ordered = F.expr("n_a < n_b OR (n_a = n_b AND gid_a < gid_b)")
    apart = F.expr("NOT (lo_a = hi_a AND lo_b = hi_b AND lo_a = lo_b)")
    found = small.join(large, ["token", "band", "part"]).where(ordered & apart & F.expr("n_a <= room_b AND n_b <= room_a") & (100 * F.col("n_a") >= percent * F.col("n_b"))).select("gid_a", "gid_b").distinct()
    within = signed.where("n > 1").groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("gid").alias("gid_a"), F.col("gid").alias("gid_b"))
    members = signed.where("n > 1").select("gid", "node", "comp").distinct()
    first, second = (members.select(F.col("gid").alias(f"gid_{s}"), F.col("node").alias(s), F.col("comp").alias(f"comp_{s}")) for s in ("a", "b"))
    pairs = found.union(within).join(first, "gid_a").join(second, "gid_b")
    return pairs.where("comp_a <> comp_b AND (gid_a <> gid_b OR a < b)").select("a", "b").distinct()


class Classes(NamedTuple):
    signed: DataFrame  # the rows of ``signatures``
    nodes: DataFrame  # node, least (doc_id), copies, and the doc_key and text_key of one of its documents
    found: DataFrame  # node, component of every node with a link
    files: int  # of tables with a row for each node


def classes(docs: DataFrame, *, percent: int = PERCENT) -> Classes:
    """Sets, nodes and components of ``docs`` (columns doc_id and text). ``percent``: more than 50, as sets of one and two shingles are not compared.

    Null and empty texts are no nodes, repeated rows are one, and an empty table gives empty tables.
    """
    if not 50 < percent <= 100:
        raise ValueError(f"the similarity must be over 50 % and at most 100 %, not {percent} %")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = shared_shingles(rows)
    signed = common.materialize(signatures(rows, marks, percent), "signatures")
    linked = signed.where("n > 0")
    files = max(FEW_FILES, linked.count() // FILE_NODES)
    # copies cost nothing more: one document stands for each node
    nodes = linked.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct(_doc_key(), "text_key", "n", "bits")).alias("one"))
    nodes = common.materialize(nodes.select("node", "least", "copies", "one.doc_key", "one.text_key", "one.n", "one.bits"), "nodes", files)
    known = components(verified(leader_pairs(linked, percent), nodes, rows, percent, files), files)
    labelled = linked.select("node", "n", "gid", "prefix").join(_sized(known), "node", "left")
    labelled = labelled.withColumn("comp", F.xxhash64(F.coalesce("component", "node")))
    more = verified(group_pairs(labelled, percent, files), nodes, rows, percent, files)
    return Classes(signed, nodes, components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), files), files)


def join(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id that its links reach.

    docs: doc_id and text, other columns are ignored. Null and empty texts, and those without words, have no shingles and no links: their
    component is their own doc_id. Repeated rows are answered each and are equal sets. A null doc_id has the least doc_id of its
    component, null if there is none. An empty table gives no rows.
    """
    signed, nodes, found, files = classes(docs, percent=percent)
    named = nodes.join(found, "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    families = named.join(least, "component").select("node", "component_id")
    alone = nodes.where("copies > 1").join(found, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    names = common.materialize(families.union(alone), "names", files)
    return signed.select("doc_id", "n", "node").join(_sized(names), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each component: that with the smallest doc_id.

    Of rows that repeat its doc_id and text one stays; a null doc_id counts as the smallest. Texts without words are in no component and all stay.
    """
    signed, nodes, found, files = classes(docs, percent=percent)
    component = F.coalesce("component", "node")
    chosen = nodes.join(found, "node", "left").groupBy(component.alias("c")).agg(F.min(F.struct("doc_key", "text_key")).alias("one"))
    again = signed.where("n > 0").groupBy(_doc_key(), "text_key").count().where("count > 1").select("doc_key", "text_key", F.lit(True).alias("again"))
    kept = common.materialize(chosen.select("one.doc_key", "one.text_key").join(again, ["doc_key", "text_key"], "left"), "kept", files)
    key, text_key, twice = (common.free_name(docs, name) for name in ("doc_key", "text_key", "again"))
    kept = kept.select(F.col("doc_key").alias(key), F.col("text_key").alias(text_key), F.col("again").alias(twice))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    marked = docs.join(_sized(kept), (doc == F.col(key)) & (F.xxhash64(text) == F.col(text_key)))
    once = marked.where(F.col(twice).isNull()).drop(key, text_key, twice)
    repeated = marked.where(F.col(twice)).dropDuplicates([key, text_key]).drop(key, text_key, twice)
    wordless = docs.where(F.translate(text, " \t\n\v\f\r", "") == "")
    return once.union(repeated).union(wordless)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (
  SELECT a.r AS x, b.r AS y
  FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r
  GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(e.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.x = d.r JOIN d e ON e.r = reach.y
GROUP BY d.r, d.doc_id
"""
