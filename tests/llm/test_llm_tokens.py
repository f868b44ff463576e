"""Encoding, counting and packing against the public libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from llm_fixtures import SMALL, edge_rows, plain
from llm_brute import check_packing
from tokenizers import Tokenizer

from tallybook.llm import byte_bpe, packing, queries, token_counts

PIECES = "a B the of , . ! ' 's 12 É 日 😀 é ́ İ Σ <|endoftext|> <s> ▁".split(" ") + [" ", "  ", "\n", "\r\n", "\x1c", "\xa0", "\x00"]


def random_texts(n: int) -> list[str]:
    r = random.Random(4)
    return ["".join(r.choices(PIECES, k=r.randint(0, 14))) for _ in range(n)]


def test_bpe_matches_library_and_round_trips(spark, edge, nothing):
    path = public_tokenizers.path(byte_bpe.RANKS)
    ranks = byte_bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.Coder(path, public_tokenizers.PATTERN)
    texts = random_texts(3000)
    ids = coder.encode(texts)
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert [coder.decode(i).decode() for i in ids] == texts

    def expected(text):
        found = library.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()
        return len(found), digest, hashlib.sha256((text or "").encode()).hexdigest()

    assert plain(byte_bpe.encode_digests(edge).collect()) == plain((i, *expected(t)) for i, t, *_ in edge_rows())
    assert plain(byte_bpe.encode(edge).select("doc_id", "ids").collect()) == plain(
        (i, library.encode_ordinary(t or "")) for i, t, *_ in edge_rows()
    )
    assert byte_bpe.encode_digests(nothing).count() == 0


def test_bpe_keeps_runs_of_spaces_and_other_blanks_together():
    path = public_tokenizers.path(byte_bpe.RANKS)
    ranks = byte_bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(9)
    texts = ["a \xa0 \xa0 b"] + ["".join(r.choices("ab    \xa0\xa0\n\t\u3000\x1c\x85.", k=9)) for _ in range(3000)]
    assert byte_bpe.Coder(path, public_tokenizers.PATTERN).encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_merges_go_by_rank_and_from_the_left():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    assert byte_bpe.fold_merges(b"aaab", ranks) == [2, 3]
    assert byte_bpe.fold_merges(b"aab", {**ranks, b"aa": 3, b"ab": 2}) == [4]
    assert byte_bpe.fold_merges(b"", ranks) == []


def test_words_are_folded_together_in_rounds(monkeypatch):
    """As many look-ups of ranks as the longest word has merges, not as all words have."""
    path = public_tokenizers.path(byte_bpe.RANKS)
    ranks = byte_bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(12)
    words = ["".join(r.choices("aehinorst\u00e9\u65e5*", k=r.randint(0, 14))) for _ in range(4000)]
    merges, calls = byte_bpe.Merges(ranks), []
    ranked = merges._ranked
    monkeypatch.setattr(merges, "_ranked", lambda *pair: calls.append(1) or ranked(*pair))
    found = merges.fold([w.encode() for w in words])
    assert len(calls) <= 2 * max(len(w.encode()) for w in words)
    assert [merges.fold([w.encode()])[0] for w in words[:200]] == found[:200]
    assert found == [library._core_bpe.encode_single_piece(w.encode()) if w else [] for w in words]


def test_counts_match_library(spark, edge, nothing):
    path = public_tokenizers.path(token_counts.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = random_texts(3000)
    assert token_counts.counter(path)(texts)[1] == [len(library.encode(t)) for t in texts]
    found = token_counts.count_tokens(edge, limit=100).collect()
    sizes = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in edge_rows()]
    assert plain(found) == plain((*s, s[2] > 100) for s in sizes)
    assert token_counts.count_tokens(nothing).count() == 0


def test_ids_for_packing_match_library():
    path = public_tokenizers.path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = random_texts(3000)
    # stops after letters, quotes and digits, special strings in other cases, letters of two characters in lower case
    texts += ["Don't. 'S, it's.' a'.", "a., b.. c. .d 1. 2,3", "<|ENDOFTEXT|> A.", "<|endoftext|> a.", "\u0130. \u017f? \u00c9!", "WORD word. Word,"]
    found = [np.frombuffer(b, "<u4").tolist() for b in packing.Ids(path)(texts)]
    assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_of_letters_are_encoded_together_whatever_signs_follow():
    path = public_tokenizers.path(packing.TOKENIZER)
    ids, single = packing.Ids(path), []
    encode = ids._encode
    ids._encode = lambda words: single.extend(words) or encode(words)
    texts = ["Heat*** the heat, the### \u00e9t\u00e9$$$ it's&&&", "heat***\n", "", "the.%%% 2,"]
    found = [np.frombuffer(b, "<u4").tolist() for b in ids(texts)]
    assert found == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sorted(w for w in single if w and not w[0].isalpha()) == ["###", "$$$", "&&&", "***", ",", ".%%%", "2,"]
    assert [w for w in single if w[:1].isalpha()] == ["it's"]


def test_plan_places_every_piece_once_and_fills_exactly_where_it_can():
    r = random.Random(8)
    for n in (1, 3, 50, 3000):
        counts = Counter(min(2048, max(1, int(r.lognormvariate(5, 1.5)))) for _ in range(n))
        placed = Counter()
        for p in packing.plan(counts):
            assert sum(p.lengths) <= 2048
            for length in p.lengths:
                placed[length] += p.times
        assert placed == counts
    assert [p.lengths for p in packing.plan({6: 2, 4: 1, 3: 1, 1: 1}, 10)] == [(6, 4), (6, 3, 1)]
    assert [p.lengths for p in packing.plan({7: 1, 1: 3}, 10)] == [(7, 1, 1, 1)]
    full = packing.plan({1000: 10, 1048: 10, 700: 9, 648: 3}, 2048)
    assert all(sum(p.lengths) == 2048 for p in full[:2])
    assert packing.plan({}) == []


def test_packing(spark, edge, nothing):
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack(edge).collect()
    expected = []
    for i, t, *_ in edge_rows():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            cut = ids[k : k + 2048]
            expected.append((i, k // 2048, k, len(cut), zlib.crc32(cut.tobytes())))
    assert plain(tuple(r)[:5] for r in rows) == plain(expected)
    check_packing(rows, 2048)
    assert packing.pack(nothing).count() == 0


def test_packing_of_all_documents_is_tight(spark):
    rows = queries.queries()["op9_packing"](spark, SMALL).collect()
    check_packing(rows, 2048)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len({r["sequence_id"] for r in rows}) <= least + 2
