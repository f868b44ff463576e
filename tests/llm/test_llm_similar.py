"""Joins of similar texts, repeated passages and nearest vectors against brute force."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import MEDIUM, SMALL, edge_rows, plain, prose
from llm_brute import classes, repeats

from tallybook.llm import jaccard_join, nearest, queries, substring_dedup
from tallybook.llm.components import components
from tallybook.llm.shingles import Hasher, exact_ids


def expected_classes(rows):
    """(doc_id, class_id, n_links, class_size) of rows (id, text)."""
    found = classes(rows)
    members = defaultdict(list)
    for i, root, _ in found:
        members[root].append(rows[i][0])
    first = {root: min((m for m in ids if m is not None), default=None) for root, ids in members.items()}
    return plain((rows[i][0], first[root], links, len(members[root])) for i, root, links in found)


def test_join_matches_brute_force_on_edge_rows(spark, edge, nothing):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    assert plain(jaccard_join.join(edge).collect()) == expected_classes(rows)
    kept = jaccard_join.keep_one_per_class(edge)
    assert kept.dtypes == edge.dtypes
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([1, 4, 5, 6, None, 7, 7, 8, 9, 10, 11, 13, 14, 15])
    assert jaccard_join.join(nothing).count() == jaccard_join.keep_one_per_class(nothing).count() == 0


def test_join_matches_brute_force_on_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    assert plain(queries.queries()["op10_jaccard_join"](spark, MEDIUM).collect()) == expected_classes(rows)


def test_join_splits_large_buckets(spark, monkeypatch):
    """Many like texts, and many unlike ones with a common opening, in buckets that must be split or linked whole."""
    monkeypatch.setattr(jaccard_join, "SMALL", 12)
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 7)
    r, base, opening = random.Random(3), prose(20, 90).split(), prose(21, 16)
    rows = []
    for i in range(60):
        words = list(base)
        for k in range(i % 4):
            words[r.randrange(len(words))] = f"new{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, f"{opening} {prose(100 + i, 12)}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert plain(jaccard_join.join(docs).collect()) == expected_classes(rows)


def test_more_recall_takes_more_runs():
    assert jaccard_join.runs_for(0.9, 0.8) < jaccard_join.runs_for(0.999, 0.8) < jaccard_join.runs_for(0.999, 0.5)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 140)] + [(100, 100), (101, 100)]
    links = spark.createDataFrame(chain + star + [(201, 200)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(links.filter("a < 0")).count() == 0


def test_shingles_are_exact():
    texts = ["a b c d e f", "b c d e f g", "a b", "a b c", "", "a b c d e"]
    ids = exact_ids(texts)
    assert [len(i) for i in ids] == [2, 2, 1, 1, 0, 1]
    assert ids[0][1] == ids[1][0] and ids[0][0] == ids[5][0] and ids[2][0] != ids[3][0]
    hashed = [Hasher()(t).tolist() for t in texts]
    assert hashed[0][1] == hashed[1][0] and hashed[0][0] == hashed[5][0] and len(set(sum(hashed, []))) == 5
    assert exact_ids([]) == []


def test_compact_windows_against_brute_force():
    random_ = np.random.default_rng(0)
    for _ in range(300):
        n, size = int(random_.integers(0, 50)), int(random_.integers(1, 12))
        h = random_.integers(0, 25, n).astype(np.uint64) << np.uint64(40)
        expected = set()
        for c in range(n):
            left = right = c
            while left > 0 and h[left - 1] > h[c]:
                left -= 1
            while right < n - 1 and h[right + 1] >= h[c]:
                right += 1
            if right - left + 1 >= size:
                expected.add((c, left, right))
        assert set(zip(*[x.tolist() for x in substring_dedup.compact_windows(h, size)], strict=True)) == expected


def covered(rows) -> dict:
    out = defaultdict(set)
    for r in rows:
        out[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    return out


def test_passages_of_edge_rows(spark, edge, nothing):
    rows = substring_dedup.passages(edge).collect()
    words = covered(rows)
    assert set(words) == {1, 2, 3, None, 9, 10}
    assert words[1] == words[2] == set(range(80))
    assert set(range(30, 90)) <= words[9] and set(range(10, 70)) <= words[10]
    assert {(r["start_word"], r["end_word"]) for r in rows if r["doc_id"] == 9} <= {(30, 90)}
    left = substring_dedup.remove_repeats(edge)
    assert left.dtypes == edge.dtypes
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in left.collect()}
    same = {(i, t, n) for i, t, _, _, n in edge_rows() if i in (4, 5, 6, 7, 8, 11, 12, 13, 14, 15)}
    assert same <= got and all(len(t or "") == n for _, t, n in got)
    assert not any(repeats({k: t for k, (_, t, _) in enumerate(got)}).values())
    assert substring_dedup.passages(nothing).count() == substring_dedup.remove_repeats(nothing).count() == 0


def test_changed_passages_are_found(spark):
    passage = prose(30, 90).split()
    changed = list(passage)
    changed[45] = "other"
    far = list(passage)
    for i in range(0, 90, 9):
        far[i] = f"x{i}"
    rows = [
        (1, f"{prose(31, 40)} {' '.join(passage)} {prose(32, 40)}"),
        (2, f"{prose(33, 25)} {' '.join(changed)} {prose(34, 55)}"),
        (3, f"{prose(35, 25)} {' '.join(far)} {prose(36, 55)}"),
        (4, f"{prose(37, 30)} {' '.join(passage[:49])} {prose(38, 30)}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = covered(substring_dedup.passages(docs).collect())
    assert set(words) == {1, 2}
    assert set(range(25, 115)) <= words[2] and set(range(40, 130)) <= words[1]


def unique_words(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def test_repeated_phrases_do_not_break_a_passage():
    u = unique_words
    passage = u("w", 60)
    passage[40:45] = passage[15:20]
    mine = " ".join(u("a", 30) + passage + u("b", 30))
    assert substring_dedup.common_passages(mine, " ".join(u("c", 20) + passage + u("d", 30))) == [(30, 90, 20, 80)]
    earlier = u("c", 20) + passage[15:20] + u("e", 9) + passage + u("d", 30)
    assert substring_dedup.common_passages(mine, " ".join(earlier)) == [(30, 90, 34, 94)]
    lines = u("l", 12) * 5
    mine, other = " ".join(u("a", 30) + lines + u("b", 30)), " ".join(u("c", 20) + lines + u("d", 30))
    assert substring_dedup.common_passages(mine, other) == [(30, 90, 20, 80)]
    assert substring_dedup.common_passages("same " * 3000, "same " * 3000) == [(0, 3000, 0, 3000)]


def test_exact_passages_of_repetitive_texts_against_brute_force(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BAND_MATCHES", 500)
    r = random.Random(1)
    for _ in range(150):
        kinds = r.choice([2, 3, 6, 50])
        core, *texts = ([str(r.randrange(kinds)) for _ in range(r.randrange(50, 120))] for _ in range(3))
        for words in texts:
            at = r.randrange(len(words))
            words[at:at] = core
        got = substring_dedup.common_passages(*map(" ".join, texts))
        starts = repeats({k: " ".join(words) for k, words in enumerate(texts)})
        for k in (0, 1):
            words = set().union(*(range(row[2 * k], row[2 * k + 1]) for row in got))
            assert {w for i in starts[k] for w in range(i, i + 50)} <= words


def test_short_passages_with_a_changed_word_share_enough_windows():
    hasher, u, trials, missed = Hasher(), unique_words, 1500, 0
    for k in range(trials):
        passage = u(f"w{k}x", 50)
        changed = [*passage[:25], "other", *passage[26:]]
        texts = [u(f"a{k}x", 60) + passage + u(f"b{k}x", 60), u(f"c{k}x", 60) + changed + u(f"d{k}x", 60)]
        hashes = [hasher(" ".join(t)) for t in texts]
        shared = 0
        for salt in substring_dedup._SALTS:
            own = [substring_dedup.mix(h ^ salt) for h in hashes]
            tokens = [set(x[substring_dedup.compact_windows(x, 46)[0]].tolist()) for x in own]
            shared += bool(tokens[0] & tokens[1])
        missed += shared < substring_dedup.ENOUGH
    assert missed <= 0.001 * trials


def test_similar_parts_of_a_stretch_that_is_not_similar():
    passage = unique_words("w", 140)
    changed = list(passage)
    changed[30] = "x"
    for i in range(66, 140, 8):
        changed[i] = f"y{i}"
    assert substring_dedup.common_passages(" ".join(passage), " ".join(changed)) == [(0, 66, 0, 66)]


def test_every_place_of_a_passage_is_found(spark):
    u = unique_words
    shared = u("w", 60)
    rows = [
        (1, " ".join(u("a", 30) + shared + u("b", 300) + shared + u("c", 30))),
        (2, " ".join(u("d", 20) + shared + u("e", 40))),
    ]
    for swapped in (rows, [(i, t + " end") for i, t in rows], [(i, "begin " + t) for i, t in rows]):
        words = covered(substring_dedup.passages(spark.createDataFrame(swapped, "doc_id long, text string")).collect())
        at = 30 + swapped[0][1].startswith("begin")
        assert words[1] == set(range(at, at + 60)) | set(range(at + 360, at + 420))


def test_pairs_of_windows_find_changed_passages():
    hasher, u, trials = Hasher(), unique_words, 1500
    salts = substring_dedup._SALTS.reshape(substring_dedup.PAIRS, 2)
    missed = {True: 0, False: 0}
    for k in range(trials):
        passage = u(f"w{k}x", 50)
        for equal in missed:
            other = passage if equal else [*passage[:25], "other", *passage[26:]]
            texts = [u(f"a{k}x", 60) + passage + u(f"b{k}x", 60), u(f"c{k}x", 60) + other + u(f"d{k}x", 60)]
            hashes = [hasher(" ".join(t)) for t in texts]
            keys = [
                {
                    key
                    for one, two in salts
                    for key in substring_dedup.joined_windows(
                        substring_dedup.mix(h ^ one), substring_dedup.mix(h ^ two), 46, one ^ two
                    )[0].tolist()
                }
                for h in hashes
            ]
            missed[equal] += not keys[0] & keys[1]
    # by chance 0.36^6 = 0.0022 of the changed ones
    assert missed[True] == 0 and missed[False] <= 0.006 * trials


def test_joined_windows_against_every_stretch():
    rng = np.random.default_rng(4)
    for size, n in ((3, 2), (3, 3), (4, 30), (5, 41)):
        x, y = (rng.integers(0, 1 << 62, n, np.uint64) for _ in range(2))
        expected = {(int(np.argmin(x[i : i + size])) + i, int(np.argmin(y[i : i + size])) + i) for i in range(n - size + 1)}
        key, left, right = substring_dedup.joined_windows(x, y, size, np.uint64(9))
        assert len(key) == len(expected)
        # the least of an overlap under each function are its two tokens
        met = {(int(np.argmin(x[i : j + 1])) + i, int(np.argmin(y[i : j + 1])) + i) for i, j in zip(left, right, strict=True)}
        assert met == expected and all(right - left + 1 >= size)


@pytest.mark.parametrize("holders", [1, 4, 12])
@pytest.mark.parametrize("change", [False, True])
def test_passages_of_common_phrases_are_found(spark, holders, change):
    """Every phrase of 19 words of a shared passage of 55 also stands in other texts, which repeat no more than that."""
    r = random.Random(holders + 100 * change)
    u, texts, shared = unique_words, [], []
    for k in range(200):
        phrases = [u(f"p{k}x{i}x", 19) for i in range(3)]
        passage = sum(phrases, [])[:55]
        other = [*passage[:27], "other", *passage[28:]] if change else passage
        pair = [u(f"a{k}x", 30) + passage + u(f"b{k}x", 30), u(f"c{k}x", 40) + other + u(f"d{k}x", 20)]
        shared.append({(tuple(pair[0]), 30), (tuple(pair[1]), 40)})
        texts += pair
        for i, phrase in enumerate(phrases):
            texts += [u(f"e{k}x{i}x{j}x", 40) + phrase + u(f"f{k}x{i}x{j}x", 40) for j in range(holders)]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(i, " ".join(texts[k])) for i, k in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = covered(substring_dedup.passages(docs).collect())
    ids = {tuple(texts[k]): i for i, k in enumerate(order)}
    found = [all(set(range(at, at + 55)) <= words.get(ids[t], set()) for t, at in pair) for pair in shared]
    print(f"{holders} texts per phrase, changed {change}: {200 - sum(found)} of 200 lost")
    # aimed at is none; a pair is lost by chance where all six keys lie within phrases, or no key survives the change
    assert sum(found) >= (197 if change else 199)
    # texts that only hold a phrase repeat nothing
    assert set(words) <= {ids[t] for pair in shared for t, _ in pair}


@pytest.mark.parametrize("block", [1000, 7])
def test_passages_are_found_beyond_the_first_text_of_their_keys(spark, monkeypatch, block):
    """Both ends of a shared passage, 45 words each, also stand in a dozen other texts, which repeat no passage."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    u, rows, expected = unique_words, [], {}
    for k in range(20):
        passage = u(f"w{k}x", 55)
        other = [*passage[:27], "other", *passage[28:]] if k % 2 else passage
        for at, words in ((30, passage), (40, other)):
            expected[len(rows)] = set(range(at, at + 55))
            rows.append((len(rows), " ".join(u(f"a{k}x{at}x", at) + words + u(f"b{k}x{at}x", 30))))
        for j in range(12):
            for i, part in enumerate((other[:45], passage[10:])):
                rows.append((len(rows), " ".join(u(f"c{k}x{i}x{j}x", 40) + part + u(f"d{k}x{i}x{j}x", 40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = covered(substring_dedup.passages(docs).collect())
    assert all(expected[k] <= words.get(k, set()) for k in expected)
    # with a word changed, its shorter side is at the similarity with the end of the passage that others hold
    assert {k for k in words if k not in expected} <= {i for i, t in rows if any(f"c{k}x" in t for k in range(1, 20, 2))}


def test_a_passage_that_has_a_nearer_twin_repeats_other_texts_too(spark):
    """Two texts have a passage, two others have it with a changed word: each is nearest to its twin, and all but one repeat another."""
    u, rows = unique_words, []
    for k in range(20):
        passage = u(f"w{k}x", 60)
        for n in range(4):
            words = [*passage[:30], "other", *passage[31:]] if n < 2 else passage
            rows.append((len(rows), " ".join(u(f"a{k}x{n}x", 30) + words + u(f"b{k}x{n}x", 30))))
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    repeated = covered([r for r in found if not r["kept"]])
    for k in range(0, len(rows), 4):
        assert sum(set(range(30, 90)) <= repeated.get(i, set()) for i in range(k, k + 4)) == 3
    assert all(set(range(30, 90)) <= words for words in covered(found).values()) and len(covered(found)) == len(rows)


def test_partners_mark_all_that_any_other_text_could_mark():
    """Places of texts with random changes: linked ones leave out no token of a stretch that an unlinked one has at the similarity."""
    random_ = np.random.default_rng(4)
    near, size, least = substring_dedup._REACH, substring_dedup._SPAN, substring_dedup.ALIKE
    passage = random_.integers(1, 1 << 16, 2 * near + 1).astype(np.uint16)
    changed = random_.integers(1, 1 << 16, (120, 2 * near + 1)).astype(np.uint16)
    context = np.where(random_.random(changed.shape) < random_.choice([0.02, 0.05, 0.1], (120, 1)), changed, passage)
    context[:, near - 10 : near + 11] = passage[near - 10 : near + 11]
    context[:, : near - 30][::3] = 0
    ids, one = np.arange(120), np.zeros(120, np.int64)
    linked = np.zeros((120, 120), bool)
    for i, j in substring_dedup._partners(context, ids, one + 2, one, one > 0):
        linked[i, j] = linked[j, i] = True
    assert 0 < linked.sum() < linked.size - 120
    equal = (context[:, None] == context) & (context != 0)[:, None]
    alike = np.stack([equal[:, :, s : s + size].sum(axis=2) >= least for s in range(size)], axis=2)
    alike &= equal[:, :, :size] & equal[:, :, near:]
    alike[ids, ids] = False
    for smaller in (True, False):
        there = (ids < ids[:, None] if smaller else ids != ids[:, None])[:, :, None]
        marked = [substring_dedup._reached((alike & there & x).any(axis=1)) for x in (True, linked[:, :, None])]
        assert (marked[0] == marked[1]).all() and marked[0].any()


def test_stretches_in_which_no_token_stands_twice():
    random_ = np.random.default_rng(5)
    size = substring_dedup._SPAN
    context = random_.integers(0, 3000, (200, 2 * substring_dedup._REACH + 1)).astype(np.uint16)
    expected = [[len(set(row[s : s + size])) == size for s in range(size)] for row in context.tolist()]
    assert substring_dedup._distinct(context).tolist() == expected


def test_texts_in_which_a_key_repeats_are_linked_as_wholes(spark, monkeypatch):
    """Texts of one line that repeats between lines of their own; some share two lines in a row, or the line with a changed word."""
    u, line, next_ = unique_words, unique_words("l", 30), unique_words("n", 25)
    rows = [(k, " ".join(sum((line + u(f"t{k}x{j}x", 25) for j in range(40)), []))) for k in range(8)]
    shared = [(100 + k, rows[k][1] + " " + " ".join(line + (next_ if k else [*next_[:20], "other", *next_[21:]]))) for k in range(3)]
    docs = spark.createDataFrame(rows + shared, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "_nearest", lambda *_: pytest.fail("places were compared one by one"))
    keys = substring_dedup.shared(substring_dedup.windows(substring_dedup._texts(docs))).filter(substring_dedup._repeats())
    found = substring_dedup.whole_links(keys).select("text_id", "other").distinct().count()
    assert found == 11 * 10 / 2
    monkeypatch.undo()
    words = covered(substring_dedup.passages(docs.filter("doc_id < 8 OR doc_id > 100")).collect())
    for k in (101, 102):
        n = len(dict(shared)[k].split())
        assert set(range(n - 55, n)) <= words[k]
    assert not set(words) & set(range(3, 8))


def test_runs_of_a_word_are_told_by_their_ends(spark):
    """A word that follows itself has one key at every place; the ends of a run are enough to find what two texts share."""
    u, rows, expected = unique_words, [], {}
    for k in range(300):
        rows.append((k, " ".join(u(f"a{k}x", 30) + ["la"] * (26 + k % 20) + u(f"b{k}x", 30))))
    # shared up to and beyond a run of another length, one long enough by itself, one of two words in turn
    lines = [u("p", 30) + ["la"] * 30, ["la"] * 30 + u("q", 30), ["la"] * 70, ["do", "re"] * 40, u("s", 10) + ["so", "la", "mi"] * 20]
    for j, line in enumerate(lines):
        for i, more in enumerate((9, 20)):
            left, right = (["la"] * more if end == "la" else [] for end in (line[0], line[-1]))
            words = u(f"c{j}x{i}x", 20) + left + line + right + u(f"d{j}x{i}x", 20)
            expected[len(rows)] = set(range(20 + len(left), 20 + len(left) + len(line)))
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.windows(substring_dedup._texts(docs)).groupBy("token", "text_id").count()
    assert found.agg({"count": "max"}).first()[0] <= 4
    words = covered(substring_dedup.passages(docs).collect())
    assert all(expected[k] <= words.get(k, set()) for k in expected)
    assert not any(k in words for k in range(300))


def test_texts_without_a_long_stretch_of_common_tokens_are_not_compared():
    r = random.Random(6)
    for _ in range(300):
        base = [f"w{r.randint(0, 60)}" for _ in range(120)]
        one, two = (" ".join(w if r.random() > 0.06 else f"x{r.random()}" for w in base[r.randint(0, 40) :]) for _ in range(2))
        may = substring_dedup._may_repeat(Hasher()(one), Hasher()(two))
        assert may or not substring_dedup.common_passages(one, two)
    line = " ".join(unique_words("l", 40))
    assert not substring_dedup._may_repeat(Hasher()(f"{line} {' '.join(unique_words('a', 60))}"), Hasher()(f"{' '.join(unique_words('b', 60))} {line}"))


def test_passages_against_brute_force(spark):
    """All stretches of two texts with a similarity of 0.8, by comparing every pair of stretches of 50 words."""
    r = random.Random(8)
    texts = []
    for k in range(30):
        passage = unique_words(f"w{k}x", 60)
        other = list(passage)
        for i in r.sample(range(60), r.choice([0, 1, 1, 2, 3, 6, 12])):
            other[i] = f"o{k}x{i}"
        texts.append(unique_words(f"a{k}x", r.randrange(10, 40)) + passage + unique_words(f"b{k}x", r.randrange(10, 40)))
        texts.append(unique_words(f"c{k}x", r.randrange(10, 40)) + other + unique_words(f"d{k}x", r.randrange(10, 40)))

    def alike(x: list[str], y: list[str]) -> bool:
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        return 5 * len(a & b) >= 4 * len(a | b)

    expected = set()
    for k in range(0, len(texts), 2):
        one, two = texts[k], texts[k + 1]
        if any(alike(one[i : i + 50], two[j : j + 50]) for i in range(len(one) - 49) for j in range(len(two) - 49)):
            expected |= {k, k + 1}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert set(covered(substring_dedup.passages(docs).collect())) == expected


def test_repetitive_texts_are_verified_in_little_time():
    def lines(seed: int) -> list[str]:
        r = random.Random(seed)
        return sum((unique_words(r.choice("ab"), 7) for _ in range(1000)), [])

    one, two = lines(1), lines(2)
    start = time.perf_counter()
    got = substring_dedup.common_passages(" ".join(one), " ".join(two))
    # 7,000 words took some 20 s when every run was held against all near its diagonal
    assert time.perf_counter() - start < 10
    starts = repeats({0: " ".join(one), 1: " ".join(two)})
    for k in (0, 1):
        words = set().union(*(range(row[2 * k], row[2 * k + 1]) for row in got))
        assert {w for i in starts[k] for w in range(i, i + 50)} <= words


def test_repeats_of_all_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = covered(queries.queries()["op3_substring_dedup"](spark, MEDIUM).collect())
    exact = repeats(texts)
    flagged = {k for k, starts in exact.items() if starts}
    assert flagged <= set(words)
    missing = sum(not set(range(i, i + 50)) <= words[k] for k, starts in exact.items() for i in starts)
    assert missing <= 0.002 * sum(map(len, exact.values()))
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert sum(map(len, repeats(left).values())) == 0
    clean = set(texts) - set(words)
    assert all(left[k] == texts[k] for k in clean)


def test_words_are_cut_with_the_blanks_after_them():
    assert substring_dedup.without_words("a  b\nc d", [(1, 3)]) == "a  d"
    assert substring_dedup.without_words(" a b ", [(0, 2)]) == " "
    assert substring_dedup.without_words("a b c d", [(1, 3), (2, 4)]) == "a "


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(np.ndindex(*[1 << bits] * d)))
        key = nearest.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(1 << bits * d))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def brute_nearest(rows, k):
    """query, rank, vec_id, score of usable rows (id, vector)."""
    v = np.array([x for _, x in rows], float)
    out = []
    for i, (query, x) in enumerate(rows):
        if query % 20 == 0:
            scores = (v * v[i]).sum(axis=1)
            order = sorted((-s, rows[j][0]) for j, s in enumerate(scores) if j != i)[:k]
            out += [(query, rank, id_, -s) for rank, (s, id_) in enumerate(order, 1)]
    return out


@pytest.mark.parametrize("sf_dir", [SMALL, MEDIUM])
def test_nearest_vectors_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    expected = brute_nearest([(r["vec_id"], [np.float32(x) for x in r["embedding"]]) for r in table], 20)
    got = [tuple(r) for r in queries.queries()["op7_nearest_neighbours"](spark, sf_dir).collect()]
    assert len(got) == len(expected)
    truth = {(q, i): s for q, _, i, s in expected}
    hits = [(q, i) for q, _, i, _ in got if (q, i) in truth]
    assert len(hits) >= 0.9 * len(truth)
    assert all(abs(truth[q, i] - s) < 1e-12 for q, _, i, s in got if (q, i) in truth)
    by_query = defaultdict(list)
    for q, rank, i, s in sorted(got):
        by_query[q].append((rank, -s, i))
    for rows in by_query.values():
        assert [r for r, *_ in rows] == list(range(1, len(rows) + 1))
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_nearest_vectors_of_odd_rows(spark):
    good = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(100 + i, [3.0, 4.0, 0.0]) for i in range(60)]
    odd = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [float("nan"), 1.0, 1.0])]
    odd += [(280, [float("inf"), 1.0, 1.0]), (300, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (20, [6.0, 1.0, 2.0])]
    vectors = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest.search(vectors).collect()]
    expected = brute_nearest(good, 20)
    assert plain(got) == plain(expected)
    assert nearest.search(vectors.filter("vec_id IN (1, 2)")).count() == 0
    assert [tuple(r)[:3] for r in nearest.search(vectors.filter("vec_id IN (40, 1)")).collect()] == [(40, 1, 1)]
    assert nearest.search(vectors.filter("vec_id IN (40)")).count() == 0
    assert nearest.search(vectors.filter("false")).columns == ["query_id", "rank", "vec_id", "score"]


def test_many_stars_over_the_same_nodes_leave_few_links(spark):
    """Runs link nearly the same 300 texts from centres of their own; a chain and a pair stand beside them."""
    from tallybook.llm.components import components, fewer_links

    rng = np.random.default_rng(4)
    stars = []
    for _ in range(40):
        nodes = np.sort(rng.choice(300, 240, replace=False)).tolist()
        stars += [(nodes[0], n) for n in nodes[1:]]
    links = stars + [(1000 + i, 1001 + i) for i in range(20)] + [(2001, 2000), (7, 7)]
    table = spark.createDataFrame(links, "a long, b long")
    fewer = fewer_links(table)
    assert fewer.count() < 400 < len(stars) / 20
    assert {tuple(r) for r in components(fewer).collect()} == {tuple(r) for r in components(table).collect()}
