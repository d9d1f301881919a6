r"""Phrase collocations by Suffix-sigma.

From every word of a piece on, the next words up to ``MOST_WORDS_OF_A_PHRASE`` are a suffix; a phrase occurs as often as it begins a suffix. Suffixes are
dealt by language and first word, sorted in reverse lexicographic order, and one pass counts all their prefixes: the stack of prefixes that are
open at a row is told by the depth at which the row differs from the one before, where the deeper ones are closed and counted.

- Words that occur less often than phrases must cannot be in one, so they end a suffix, as the end of a piece does.
- Words are numbered by language, the most frequent first; tasks sort and add up equal suffixes and hand on packed blocks, one for each cell of first words.
- A first word that is too frequent for a cell is dealt by its second word too, and so is a pair by its third, and so on, as far as they are that frequent; what
  the tasks that count the words see often enough in a stretch of text is known by then. Prefixes
  that lie in several cells are counted in each and added up; all others are complete where they are and only those that are frequent enough leave the task.
- The counts of a phrase's parts are joined afterwards. Words that hold a thousandth of all occurrences, 1,000 at most, are broadcast in these joins, so
  no key gathers many rows.

Counts cover all texts. The driver holds the ``LISTED`` most frequent words and their counts, and one total for each language.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenseek.llm import common, words

MOST_WORDS_OF_A_PHRASE = 5
LEAST_COUNT = 100
MOST_ROWS = 2000
UNKNOWN = "und"
#: Words that tasks know by number, of so many bytes at most (the 1,000 at most that hold a thousandth of all occurrences: HOT_BYTES); suffixes carry other frequent words as they are.
LISTED, LISTED_BYTES, HOT_BYTES = 300_000, 64, 10_000
#: Distinct words that a task counts before it hands them on, words whose suffixes it sorts together, and bytes of text that it splits at once.
COUNTED, SORTED, SLICE_BYTES = 300_000, 1_000_000, 1_000_000
#: Word occurrences of a cell; cells are 2**MOST_CELL_BITS at most and grow beyond that.
CELL_WORDS = 250_000
MOST_CELL_BITS = 18
#: Phrases of two to four words that hold such a share of the words of a stretch of text, and so often at least, may be too frequent for a cell.
#: They decide where suffixes are counted, never what is found.
OFTEN, OFTEN_LEAST = 1000, 20
#: The driver gets those that hold such a share of all words.
HEAVY = 20_000
#: Languages up to which their totals are broadcast.
FEW_LANGUAGES = 100_000

SCHEMA = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
#: A-Z folded, blanks between words, line feeds between pieces.
_PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" " + b"\n" * 9))


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The batch's texts by language, folded, with line feeds between pieces."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        texts.setdefault(lang, []).append((text or "").encode())
    for lang, found in texts.items():
        yield lang, b"\n".join(found).translate(_PLAIN)


def often(tokens: list[bytes], counts: Counter) -> Counter:
    """Phrases of two to four words that are frequent in a stretch of text, whose words ``counts`` has; pieces do not matter here."""
    least = max(OFTEN_LEAST, len(tokens) // OFTEN)
    names = [w for w, n in counts.items() if n >= least]
    out: Counter = Counter()
    if not names:
        return out
    numbers = np.fromiter(map({w: i for i, w in enumerate(names, 1)}.get, tokens, repeat(0)), np.int64, len(tokens))
    at, spelt = numbers, [b"", *names]
    for length in range(2, MOST_WORDS_OF_A_PHRASE):
        head, following = at[: max(0, len(numbers) - length + 1)], numbers[length - 1 :]
        both = np.flatnonzero((head > 0) & (following > 0))
        codes, which, n = np.unique(head[both] << 32 | following[both], return_inverse=True, return_counts=True)
        kept = np.flatnonzero(n >= least)
        if not len(kept):
            break
        spelt = [b"", *(spelt[c >> 32] + b" " + names[(c & 0xFFFFFFFF) - 1] for c in codes[kept].tolist())]
        out.update(dict(zip(spelt[1:], n[kept].tolist())))
        place = np.zeros(len(codes), np.int64)
        place[kept] = np.arange(1, len(kept) + 1)
        at = np.zeros(len(numbers), np.int64)
        at[both] = place[which]
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n of every word; a row with a null word for each language's total; and rows of several words for some phrases that are very frequent, with a lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        heavy: dict[str, Counter] = {}

        def put() -> pa.RecordBatch:
            rows = [(lang, word.decode(), n) for found in (counts, heavy) for lang, c in found.items() for word, n in c.items()] + [(lang, None, c.total()) for lang, c in counts.items()]
            counts.clear()
            heavy.clear()
            langs, found, n = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                for lang, data in by_language(part):
                    tokens = data.split()
                    mine = Counter(tokens)
                    counts.setdefault(lang, Counter()).update(mine)
                    heavy.setdefault(lang, Counter()).update(often(tokens, mine))
                if sum(map(len, counts.values())) >= COUNTED:
                    yield put()
        if counts:
            yield put()
        common.release()

    return docs.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Lexicon(NamedTuple):
    """The listed words, numbered from 1 by falling frequency; 0 ends a suffix.

    heavy has, for each length from 2 on, the phrases that are too frequent for a cell, ascending, and their counts. A phrase is the place of its beginning
    among those of the length before (a word: its number) << 32 | the number of its last word.
    """

    langs: list[str]
    words: list[str]
    counts: np.ndarray  # by number
    complete: bool  # all words that can be in a phrase are listed
    cell_words: int
    cells: int
    heavy: list[tuple[np.ndarray, np.ndarray]]


def heavy_phrases(rows: list[tuple[str, str, int]], langs: list[str], listed: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``Lexicon.heavy`` of phrases (lang, phrase, n); those whose beginning is not among them are left out."""
    numbers = {(lang, word): i for i, (lang, word) in enumerate(zip(langs, listed), 1)}
    known, out = dict(numbers), []
    for length in range(2, MOST_WORDS_OF_A_PHRASE):
        codes = {}
        for lang, phrase, n in rows:
            head, _, last = phrase.rpartition(" ")
            if phrase.count(" ") == length - 1 and (lang, head) in known and (lang, last) in numbers:
                codes[known[lang, head] << 32 | numbers[lang, last]] = lang, phrase, n
        order = sorted(codes)
        known = {codes[c][:2]: i for i, c in enumerate(order)}
        out.append((np.array(order, np.int64), np.array([codes[c][2] for c in order], np.int64)))
    return out


class Numbers(dict):
    """Numbers of one language's words. Unlisted ones end a suffix or, if they may be in a phrase, get the next number, for all languages in ``others``."""

    def __init__(self, lang: str, lexicon: Lexicon, others: dict[str, int]) -> None:
        super().__init__((w.encode(), i) for i, (of, w) in enumerate(zip(lexicon.langs, lexicon.words), 1) if of == lang)
        self[b"\n"], self[b""] = 0, -1
        self.lang, self.others, self.base, self.complete = lang, others, len(lexicon.words) + 1, lexicon.complete

    def __missing__(self, word: bytes) -> int:
        if self.complete:
            return 0
        return self.others.setdefault(f"{word.decode()}\t{self.lang}", self.base + len(self.others))


def suffixes(numbers: np.ndarray) -> np.ndarray:
    """The suffixes of two words and more, a column for each place, filled up with 0."""
    n = len(numbers)
    padded = np.concatenate((numbers, np.zeros(MOST_WORDS_OF_A_PHRASE - 1, numbers.dtype)))
    columns = [numbers]
    for j in range(1, MOST_WORDS_OF_A_PHRASE):
        columns.append(np.where(columns[-1] > 0, padded[j : j + n], 0))
    return np.stack(columns)[:, columns[1] > 0]


def added_up(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes in reverse lexicographic order and how often each occurs."""
    pairs = columns.astype(np.uint64)
    keys = [pairs[j] << np.uint64(32) | pairs[j + 1] if j + 1 < len(pairs) else pairs[j] for j in range(0, len(pairs), 2)]
    order = np.lexsort(keys[::-1])[::-1]
    columns, counts = columns[:, order], counts[order]
    first = np.ones(len(order), bool)
    first[1:] = (columns[:, 1:] != columns[:, :-1]).any(0)
    return columns[:, first], np.add.reduceat(counts, np.flatnonzero(first)) if len(order) else counts


def prefixes(columns: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from 2 on: the prefixes of sorted distinct suffixes, as columns, and how often each occurs.

    ``depth`` is the first place where a row differs from the row before: prefixes that reach so deep are taken off the stack there.
    """
    n = columns.shape[1]
    if not n:
        return
    depth = np.zeros(n, np.int64)
    depth[1:] = (columns[:, 1:] != columns[:, :-1]).argmax(0)
    for length in range(2, len(columns) + 1):
        begins = np.flatnonzero(depth < length)
        whole = columns[length - 1, begins] > 0
        yield length, columns[:length, begins[whole]], np.add.reduceat(counts, begins)[whole]


def too_frequent(columns: np.ndarray, lexicon: Lexicon) -> list[np.ndarray]:
    """For the prefixes of each length from 1 on, up to one less than the columns: how often each occurs if that is too often for a cell, else 0."""
    counts = np.concatenate(([0], lexicon.counts, [0]))  # other words are not too frequent
    first = counts[np.minimum(columns[0], len(counts) - 1)]
    out = [np.where(first > lexicon.cell_words, first, 0)]
    place = columns[0]
    for (codes, ns), column in zip(lexicon.heavy, columns[1:-1]):
        here = np.zeros(len(column), np.int64)
        if len(codes):
            wanted = place << 32 | column
            at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            found = (codes[at] == wanted) & (out[-1] > 0)
            here[found] = ns[at[found]]
            place = at
        out.append(here)
    return out


def dealt(columns: np.ndarray, codes: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """The cell of each suffix: by its first word, and as long as the words so far are too frequent, by the next one, which chooses one of as many cells as they need."""
    key = words.mix(codes[columns[0]])
    for n, column in zip(too_frequent(columns, lexicon), columns[1:]):
        cells = (n // lexicon.cell_words + 1).astype(np.uint64)
        key = np.where(n > 0, words.mix(key + np.uint64(1) + words.mix(codes[column]) % cells), key)
    return (key % np.uint64(lexicon.cells)).astype(np.int64)


def blocks(numbers: np.ndarray, lexicon: Lexicon, others: list[str]) -> Iterator[tuple[int, bytes, int, list[str]]]:
    """cell, packed suffixes and counts, how many, and the other words that they number, of a stretch of text."""
    columns, counts = added_up(found := suffixes(numbers), np.ones(found.shape[1], np.int64))
    if not len(counts):
        return
    codes = words.mix(np.arange(len(lexicon.words) + 1, dtype=np.uint64) + np.uint64(1))
    codes = np.concatenate((codes, np.array([_code(w) for w in others], np.uint64)))
    cell = dealt(columns, codes, lexicon)
    order = np.argsort(cell, kind="stable")
    firsts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    for a, b in zip(firsts, [*firsts[1:], len(order)]):
        rows = np.vstack((columns[:, order[a:b]], counts[order[a:b]])).astype(np.int64)
        mine: list[str] = []
        high = rows[:-1] > len(lexicon.words)
        if high.any():
            used = np.unique(rows[:-1][high])
            mine = [others[i - len(lexicon.words) - 1] for i in used.tolist()]
            rows[:-1][high] = len(lexicon.words) + 1 + np.searchsorted(used, rows[:-1][high])
        yield int(cell[order[a]]), pack(rows), b - a, mine


def _code(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def pack(rows: np.ndarray) -> bytes:
    """Numbers of 32 bits by column and byte: the high bytes are mostly 0 and vanish when the shuffle is compressed."""
    return np.ascontiguousarray(rows, "<u4").view(np.uint8).reshape(len(rows), -1, 4).transpose(0, 2, 1).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(MOST_WORDS_OF_A_PHRASE + 1, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0].astype(np.int64)


def counted(held: list[tuple[bytes, int, list[str]]], lexicon: Lexicon, least: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, size, n and whether n is only this cell's part, of the blocks of one cell."""
    base, numbers, parts = len(lexicon.words) + 1, {}, []
    for data, n, others in held:
        rows = unpack(data, n)
        if others:
            new = np.array([numbers.setdefault(w, base + len(numbers)) for w in others])
            high = rows[:-1] >= base
            rows[:-1][high] = new[rows[:-1][high] - base]
        parts.append(rows)
    rows = np.concatenate(parts, axis=1)
    columns, counts = added_up(rows[:-1], rows[-1])
    told = [w.split("\t", 1) for w in numbers]
    spelt, langs = pa.array(["", *lexicon.words, *(w for w, _ in told)]), pa.array(["", *lexicon.langs, *(lang for _, lang in told)])
    for length, found, n in prefixes(columns, counts):
        # what is dealt by further words lies in other cells too
        shared = too_frequent(np.vstack((found, found[-1:])), lexicon)[-1] > 0 if length < MOST_WORDS_OF_A_PHRASE else np.zeros(len(n), bool)
        kept = np.flatnonzero(shared | (n >= least))
        if len(kept):
            phrase = pc.binary_join_element_wise(*(spelt.take(pa.array(c[kept])) for c in found), " ")
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(found[0][kept])), phrase, pa.array(np.full(len(kept), length), pa.int32()), pa.array(n[kept], pa.int64()), pa.array(shared[kept])], ["lang", "phrase", "size", "n", "part"])


def phrase_counts(docs: DataFrame, lexicon: Lexicon, least: int = LEAST_COUNT) -> DataFrame:
    """lang, phrase, size and n of the phrases of two words and more that occur at least ``least`` times."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        others: dict[str, int] = {}
        tables: dict[str, Numbers] = {}
        held, size = [], 0

        def put() -> pa.RecordBatch:
            rows = list(zip(*blocks(np.concatenate(held), lexicon, list(others)))) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.string())))], ["cell", "data", "n", "others"])

        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                for lang, data in by_language(part):
                    if lang not in tables:
                        tables[lang] = Numbers(lang, lexicon, others)
                    tokens = (data.replace(b"\n", b" \n ") + b" \n").split(b" ")
                    numbers = np.fromiter(map(tables[lang].__getitem__, tokens), np.int64, len(tokens))
                    held.append(numbers[numbers >= 0])
                    size += len(held[-1])
                if size >= SORTED:
                    yield put()
                    held, size = [], 0
                    others.clear()
        if size:
            yield put()
        common.release()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, at, held = shared.value, None, []
        for batch in batches:
            for cell, data, n, others in zip(*(batch.column(c).to_pylist() for c in ("cell", "data", "n", "others"))):
                if cell != at and held:
                    yield from counted(held, lexicon, least)
                    held = []
                at = cell
                held.append((data, n, others))
        if held:
            yield from counted(held, lexicon, least)
        common.release()

    dealt = docs.mapInArrow(deal, "cell int, data binary, n int, others array<string>").repartition("cell").sortWithinPartitions("cell")
    told = common.materialize(dealt.mapInArrow(count, "lang string, phrase string, size int, n bigint, part boolean"), "phrases")
    summed = told.where("part").groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.sum("n").alias("n")).where(F.col("n") >= least)
    return told.where("NOT part").drop("part").union(summed)


def _looked_up(rows: DataFrame, part: str, name: str, hot: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with the count of the phrase in ``part`` as ``name``: from the few words that are everywhere, or else from all counts."""
    told = rows.join(F.broadcast(hot.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))), ["lang", part], "left")
    rest = told.where(F.col(name).isNull()).drop(name).join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    return told.where(F.col(name).isNotNull()).unionByName(rest)


def score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    a, n, l, r = (x.cast("decimal(19,0)") for x in (a, n, l, r))
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * a * n, l * r)


def collocations(docs: DataFrame, *, least: int = LEAST_COUNT, most_rows: int = MOST_ROWS) -> DataFrame:
    """The ``most_rows`` phrases of each language by the score of their lowest-scoring cut: lang, rank, phrase, a, l, r, n, score.

    docs: lang and text, other columns are ignored. A null lang is ``und``, null and empty texts have no words; rows that repeat count as often as they occur.
    Languages without a phrase that occurs ``least`` times have no rows, nor has an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    frequent = common.materialize(word_counts(docs).where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = frequent.where("word IS NULL").select("lang", F.col("n").alias("total"))
    usable = frequent.where("NOT contains(word, ' ')")
    total = totals.agg(F.sum("total")).first()[0] or 0
    size = F.octet_length("word")
    short = (size <= LISTED_BYTES) | ((F.col("n") >= max(1, total // 1000)) & (size <= HOT_BYTES))
    listed = usable.where(short).orderBy(F.desc("n"), "lang", "word").limit(LISTED).collect()
    cells = 1 << min(MOST_CELL_BITS, max(4, (total // CELL_WORDS).bit_length()))
    cell_words = max(1, total // cells)
    heavy = frequent.where(F.contains("word", F.lit(" ")) & (F.col("n") > max(cell_words, total // HEAVY))).select("lang", "word", "n").collect()
    langs, spelt = [r["lang"] for r in listed], [r["word"] for r in listed]
    lexicon = Lexicon(langs, spelt, np.array([r["n"] for r in listed], np.int64), usable.count() == len(listed), cell_words, cells, heavy_phrases([tuple(r) for r in heavy], langs, spelt))
    found = common.materialize(phrase_counts(docs, lexicon, least), "candidates")
    counts = usable.select("lang", F.col("word").alias("phrase"), "n").union(found.select("lang", "phrase", "n"))
    hot = usable.where(F.col("n") >= max(1, total // 1000)).select("lang", F.col("word").alias("phrase"), "n")
    # a candidate goes if a longer phrase, of which it is a part, occurs as often
    each = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(each, i, k), " "))))
    parts = found.where("size > 2").select("lang", "n", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    open_ = found.join(parts, ["lang", "phrase"], "left").where("longer IS NULL OR longer < n").select("lang", "phrase", "size", F.col("n").alias("a"))
    words_ = F.split("phrase", " ")
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = common.materialize(cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words_, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words_, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right")), "cuts")
    cuts = _looked_up(_looked_up(cuts, "left", "l", hot, counts), "right", "r", hot, counts)
    cuts = cuts.join(F.broadcast(totals) if totals.limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES else totals, "lang")
    scored = cuts.withColumn("score", score(F.col("a"), F.col("total"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = lowest.withColumn("rank", rank).where(F.col("rank") <= most_rows)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), range(1, 6) t(k) WHERE i + k - 1 <= len(w))
  GROUP BY ALL HAVING count(*) >= 100),
kept AS (
  SELECT * FROM f c WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM f o WHERE o.lang = c.lang AND o.k > c.k AND o.f >= c.f AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS x, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS y
  FROM kept, range(1, 5) t(j) WHERE j < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, l.f AS l, r.f AS r, n.n, (CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y JOIN n ON n.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM lowest)
WHERE rank <= 2000
"""
