"""Token counts of whole texts without their ids (sentencepiece models).

No piece of such a vocabulary has a word mark after another character, so a text falls apart at each run of
spaces into pre-tokens whose pieces never meet. A task counts the pieces of each distinct pre-token once and
joins the counts to the pre-tokens of every document; ids are never built for a text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.batches import Memo, add_columns, id_and_text

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LIMIT = 4096
# a run of spaces with the word after it, or the spaces that end the text
_PRE_TOKEN = re.compile(" +[^ ]*|^[^ ]+")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens, each without the one space that the library puts before a text."""
    if not text:
        return []
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [t[1:] for t in _PRE_TOKEN.findall(" " + text)]


def counter(path: str):
    """For a task: the function from texts to (bytes, tokens) columns."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def pieces(words: list[str]) -> list[int]:
        # the library gives nothing for an empty text; here it stands for the mark alone
        return [len(ids) if w else 1 for w, ids in zip(words, model.encode(words, num_threads=1), strict=True)]

    counts = Memo(pieces)

    def count(texts: list[str]) -> list[list]:
        # a literal word mark in a text is a space to the library
        split = [pre_tokens(t.replace(MARK, " ") if MARK in t else t) for t in texts]
        counts.learn(chain.from_iterable(split))
        return [[len(t.encode()) for t in texts], [sum(map(counts.__getitem__, words)) for words in split]]

    return count


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows and null ids are kept as they are; other columns are
    not read. Ties do not occur.
    """
    path = os.path.abspath(public_tokenizers.path(model))
    counted = add_columns(id_and_text(docs), lambda: counter(path), "n_bytes long, n_tokens long", ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
