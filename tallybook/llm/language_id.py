"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled words answers how far a text can be matched. A text is parsed
greedily into longest matches with each automaton; the language that needs the fewest bits, phrases times the
bits that point into its automaton, wins. Phrases end with words, so that each task parses a distinct word once
and adds the phrases of a text's words up.
"""

from __future__ import annotations

import math
import re
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.batches import Memo, add_columns, held, id_and_text, id_digest, whole_text

UNDETERMINED = "und"
FOLDS, HELD_OUT = 4, 2
# bounds of the labelled sample that the automata are built from
SAMPLE_DOCS = 400
SAMPLE_TEXT_CHARS = 20_000
AUTOMATON_CHARS = 30_000

_WORD = re.compile(r"[^\W\d_]+")
_FIELD = 44


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. What is no letter, such as a fraction or a number in a circle, parts them."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for w in found for c in (*w, " ")).split()


class SuffixAutomaton:
    """All substrings of the words it is given, each with a space on both sides.

    A state is the map from a next character to the next state.
    """

    def __init__(self, words):
        text = " ".join(["", *words, ""]) if words else ""
        links, lengths, edges, last = [-1], [0], [{}], 0
        for c in text:
            links.append(0), lengths.append(lengths[last] + 1), edges.append({})
            new, p = len(links) - 1, last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = links[p]
            if p >= 0:
                q = edges[p][c]
                if lengths[q] == lengths[p] + 1:
                    links[new] = q
                else:
                    links.append(links[q]), lengths.append(lengths[p] + 1), edges.append(dict(edges[q]))
                    copy = len(links) - 1
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = links[p]
                    links[q] = links[new] = copy
            last = new
        for e in edges:
            for c, to in e.items():
                e[c] = edges[to]
        self.size, self.root, self.nothing = len(text), edges[0], {}

    def phrases(self, text: str) -> int:
        """Greedy longest matches that cover the text; a character that never occurs is a phrase of its own."""
        n, root, nothing = 0, self.root, self.nothing
        state = nothing
        for c in text:
            to = state.get(c)
            if to is None:
                n += 1
                to = root.get(c, nothing)
            state = to
        return n


def learn(docs: DataFrame) -> dict[str, tuple[str, ...]]:
    """The words of each language's automaton, from a bounded sample: SAMPLE_DOCS labelled texts of at most
    SAMPLE_TEXT_CHARS characters each, chosen by digest, and AUTOMATON_CHARS of their distinct words."""
    labelled = (
        docs.select(
            F.col("lang").cast("string").alias("lang"),
            whole_text(docs).alias("text"),
            id_digest(F.col("doc_id")).alias("d"),
        )
        .filter(
            F.col("lang").isNotNull() & (F.col("d") % FOLDS != HELD_OUT) & (F.length("text") <= SAMPLE_TEXT_CHARS)
        )
        .withColumn("h", F.xxhash64("d", "text"))
    )
    # digests choose the rows, so that each task passes on few of them, and no texts but the chosen ones
    order = Window.partitionBy("lang").orderBy("h")
    digests = labelled.select("lang", "h").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE_DOCS)
    # SAMPLE_DOCS rows of two short columns per language
    chosen = labelled.join(F.broadcast(digests.select("lang", "h").distinct()), ["lang", "h"])
    texts: dict[str, list[str]] = {}
    for row in chosen.dropDuplicates(["lang", "h"]).orderBy("lang", "h").select("lang", "text").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    learned = {}
    for lang, sample in texts.items():
        words, size = {}, 0
        for word in (w for t in sample for w in words_of(t)):
            if word not in words and size + len(word) < AUTOMATON_CHARS:
                words[word] = None
                size += len(word) + 1
        if words:
            learned[lang] = tuple(words)
    return learned


class Parser:
    """Prediction and score of whole texts."""

    def __init__(self, learned: dict[str, tuple[str, ...]]):
        self.langs = sorted(learned)
        self.automata = [SuffixAutomaton(learned[lang]) for lang in self.langs]
        self.bits = [math.log2(a.size) for a in self.automata]
        # an entry is a number of some hundred bits
        self.known = Memo(lambda chunks: list(map(self._count, chunks)), limit=100_000)

    def _count(self, chunk: str) -> int:
        """Letters and phrases of a run of non-blanks, in fields of one number that add up without carries."""
        packed = 0
        for word in words_of(chunk):
            packed += len(word)
            for k, automaton in enumerate(self.automata, 1):
                packed += automaton.phrases(f" {word} ") << (_FIELD * k)
        return packed

    def __call__(self, texts: list[str]) -> list[list]:
        """Columns: language and score."""
        split = [t.split() for t in texts]
        self.known.learn(chain.from_iterable(split))
        found = [self._best(sum(map(self.known.__getitem__, chunks))) for chunks in split]
        return [[f[0] for f in found], [f[1] for f in found]]

    def _best(self, packed: int) -> tuple[str, float]:
        field = (1 << _FIELD) - 1
        letters = packed & field
        if not letters or not self.langs:
            return UNDETERMINED, 0.0
        cost = sorted(
            ((packed >> (_FIELD * k) & field) * self.bits[k - 1] / letters, lang) for k, lang in enumerate(self.langs, 1)
        )
        return cost[0][1], 1.0 - cost[0][0] / cost[1][0] if len(cost) > 1 else 1.0


def _parser(learned: tuple[tuple[str, tuple[str, ...]], ...]) -> Parser:
    """One for each Python worker, for all of its tasks."""
    return held(("language_id", hash(learned)), lambda: Parser(dict(learned)))


def _predicted(rows: DataFrame, keep: list[str], docs: DataFrame, text: str = "text") -> DataFrame:
    learned = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def make():
        parse = _parser(tuple(sorted(learned.value.items())))
        return lambda texts: parse([t or "" for t in texts])

    return add_columns(rows, make, "lang_pred string, score double", keep, text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Null texts and texts without a letter, and all texts where nothing was labelled, are `und` with score 0. The
    score is the share of bits saved against the second best language; ties go to the smaller name. A null id
    counts as empty text in the split; other columns are not read.
    """
    out = _predicted(id_and_text(docs), ["doc_id"], docs)
    return out.select(
        "doc_id", (id_digest(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language could be told, with all their columns, whatever these are called.

    A null text has no language, so that its row goes; repeated rows share their fate.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    rows = rows.withColumn(text, rows[text].cast("string"))
    told = _predicted(rows, names, docs, text).filter(F.col("lang_pred") != UNDETERMINED)
    return told.select(*names).toDF(*docs.columns)
