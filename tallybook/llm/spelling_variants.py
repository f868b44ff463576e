"""Spelling variants: frequent words, the words one edit away from them, and the form that each should have.

A word is a multiset of letters for its front and one for its back half: a binary vector over (half, letter,
occurrence). Words that differ by one replaced letter are at Hamming distance two, all of it within one half, and
words that differ by one inserted letter at distance one. So one half's multiset is equal, and the letters of the
other half are partitioned: of PARTS groups of letters at most two (one for an insertion) differ, and every choice of
the groups that may differ gives one signature of the rest. Words that share a signature are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tallybook.llm.batches import Memo, id_and_text, quoted, slices
from tallybook.llm.conversation_repair import crc32_sql
from tallybook.sources.staging import stage

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
DAMAGE = 97
# groups of letters where one letter is replaced, and where one is inserted
PARTS, PARTS_OF_LONGER = 4, 2
# distinct runs that a task counts before it passes the counts on
TABLE = 400_000

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# what shares a signature: words of one length, or a word and those with one letter more
SAME, SHORTER, LONGER = 0, 1, 2


def _counts(batches: Iterator[pa.RecordBatch], damage: int | None) -> Iterator[Counter]:
    """Counts of lower-cased words, passed on whenever many distinct ones are held."""
    # a shorter run cannot give a word, not even before a letter is lost
    runs_of = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}").findall
    lower = Memo(lambda runs: [r.translate(_LOWER).encode() for r in runs], limit=TABLE)
    runs, lost = Counter(), Counter()

    def words() -> Counter:
        total = Counter(lost)
        for run, n in runs.items():
            total[run.translate(_LOWER)] += n
        return total

    for batch in slices(batches):
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = runs_of(text)
            runs.update(found)
            if damage:
                distinct = set(found)
                lower.learn(distinct)
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run in [r for r in distinct if not zlib.crc32(lower[r], start) % damage]:
                    n, word = found.count(run), run.translate(_LOWER)
                    at = zlib.crc32(lower[run], start) % len(word)
                    runs[run] -= n
                    if len(word) > LEAST_LENGTH:
                        lost[word[:at] + word[at + 1 :]] += n
        if len(runs) + len(lost) > TABLE:
            yield words()
            runs.clear(), lost.clear()
    yield words()


def vocabulary(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """word, n: lower-cased runs of letters of at least LEAST_LENGTH code points that occur LEAST_COUNT times or more.

    With `damage`, runs whose crc32 with their document is divisible by it lose one letter first.
    """
    schema = _parse_datatype_string("word string, n long")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in _counts(batches, damage):
            rows = [(w, n) for w, n in counts.items() if n]
            for k in range(0, len(rows), 50_000):
                some = rows[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*some, strict=True), out, strict=True)], schema=out
                )

    counted = id_and_text(docs).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# every letter has a random number; a multiset is the sum of its letters' numbers, whatever their order
_NUMBERS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
# letters are dealt to the parts by how common they are in European languages, so that the parts are alike
_COMMON = "eanirtosldhcumpgfbvzykqwjxéèêçàüäößñíóúá"
_PLACE = np.array([_COMMON.find(chr(c)) if chr(c) in _COMMON else c for c in range(256)])


def _signatures(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Role and signatures for words of one length, given as a matrix of Latin-1 letters."""
    length = letters.shape[1]
    numbers, places = _NUMBERS[letters], _PLACE[letters]

    def keys(kind: int, short: int, cut: int, half: int, parts: int, differ: int) -> Iterator[np.ndarray]:
        """One half may differ in so many of the parts; each choice of the others makes a signature with the other half."""
        ends = (slice(None, cut), slice(cut, None))
        equal = numbers[:, ends[1 - half]].sum(axis=1, dtype=np.uint64)
        own, place = numbers[:, ends[half]], places[:, ends[half]] % parts
        sums = [np.where(place == k, own, np.uint64(0)).sum(axis=1, dtype=np.uint64) for k in range(parts)]
        for kept in combinations(range(parts), parts - differ):
            mixed = _mix(equal + np.uint64(zlib.crc32(repr((kind, short, half, kept)).encode())))
            for k in kept:
                mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + sums[k])
            yield mixed

    for half in (0, 1):
        for key in keys(0, length, length // 2, half, PARTS, 2):
            yield SAME, key
        for key in keys(1, length, length // 2, half, PARTS_OF_LONGER, 1):
            yield SHORTER, key
        # as the longer word, cut so that the half without the inserted letter is that of the shorter word
        for key in keys(1, length - 1, (length - 1) // 2 + (1 - half), half, PARTS_OF_LONGER, 1):
            yield LONGER, key


def signed(words: DataFrame) -> DataFrame:
    """signature, role, word, n: every word with all its signatures."""
    schema = _parse_datatype_string("signature long, role tinyint, word string, n long")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                letters = np.frombuffer(b"".join([coded[i] for i in rows]), np.uint8).reshape(len(rows), length)
                own = [batch.column(k).take(pa.array(rows)) for k in (0, 1)]
                for role, keys in _signatures(letters):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.full(len(rows), role, np.int8)), *own], schema=out
                    )

    return words.select("word", "n").mapInArrow(run, schema)


def near_words(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every pair of words, once, that differ by exactly one inserted, deleted or replaced code point."""
    # both sides are one exchange: no condition on one side alone, which would be pushed below it
    dealt = signed(words).repartition("signature")
    left = dealt.select("signature", F.col("role").alias("a_role"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = dealt.select("signature", F.col("role").alias("b_role"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    roles = F.col("a_role") * 3 + F.col("b_role")
    # Spark would judge the size by the words, of which each has many signatures
    met = left.join(right.hint("merge"), "signature").filter(
        (roles == SHORTER * 3 + LONGER) | ((roles == SAME * 3 + SAME) & (F.col("a") < F.col("b")))
    )
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms ends, for every word with a form.

    A form occurs at least RATIO times as often as its word, so that chains are short; each round doubles the steps.
    """
    found = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(
            found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        found = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return found


def variants(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary.

    The form is the near word of largest n (ties: the smallest in code-point order), if that is RATIO times the word's
    n or more; the root is where following forms ends, the word itself if it has none. Null texts have no words, a
    null doc_id counts as empty text where damage is done, repeated rows count as often as they occur; an empty table
    gives no rows. Other columns are not read.
    """
    words = stage(vocabulary(docs, damage))
    pairs = near_words(words)
    to_b = F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    to_a = F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    per_word = (
        pairs.select(F.inline(F.array(to_b, to_a)))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    )
    common = F.col("best.near_n") >= RATIO * F.col("n")
    joined = stage(
        words.join(per_word, "word", "left").select(
            "word", F.when(common, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("best.near_n")).alias("form_n"),
        )
    )
    roots = _roots(joined.filter("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def respelled(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the documents with every word that has a root replaced by it; capitals are kept only as the root has them.

    The words of a document are joined to the roots in Spark, so that the table of roots may have any size.
    """
    letters = "[A-Za-z\\u00c0-\\u00ff]+"
    upper, lower = "".join(map(chr, _LOWER)), "".join(map(chr, _LOWER.values()))
    roots = found.filter(F.col("root") != F.col("word")).select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    keyed = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = stage(keyed)
    marked = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"({letters})", "\u0001$1\u0001"), "\u0001")
    pieces = rows.select("_row", F.posexplode(marked).alias("_at", "_piece"))
    joined = pieces.withColumn("_word", F.translate("_piece", upper, lower)).join(roots, "_word", "left")
    rebuilt = joined.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_root", "_piece").alias("_piece")))).alias("_all")
    )
    new = F.when(F.col(text).isNotNull(), F.array_join("_all._piece", "")).alias(text)
    return rows.join(rebuilt, "_row").select(*[new if c == text else F.col(q) for c, q in zip(docs.columns, quoted(docs.columns), strict=True)])


def variants_sql() -> str:
    """The same for DuckDB, with near words by equal deletions and equal gaps."""
    upper, lower = "".join(map(chr, _LOWER)), "".join(map(chr, _LOWER.values()))
    return f"""
    WITH RECURSIVE runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, '{upper}', '{lower}') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
        WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
    hashed AS (SELECT run, n, {crc32_sql("id || ':' || run")} AS h FROM runs),
    words AS (
        SELECT word, sum(n)::BIGINT AS n
        FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n
              FROM hashed)
        WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    gaps AS (
        SELECT DISTINCT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
        SELECT a.word AS word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b USING (rest, i) WHERE a.word != b.word
        UNION SELECT w.word, g.word, g.n FROM words w JOIN gaps g ON g.rest = w.word
        UNION SELECT g.word, w.word, w.n FROM words w JOIN gaps g ON g.rest = w.word),
    ranked AS (
        SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
               row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place
        FROM near),
    formed AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form,
               CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
        FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
    chain AS (
        SELECT word, word AS root, form AS onward FROM formed
        UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.onward)
    SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
    FROM formed f JOIN chain c ON c.word = f.word AND c.onward IS NULL"""
