"""Quality rules, quality scores, languages and placement."""

import zlib
from collections import Counter

import pytest
from llm_fixtures import MEDIUM, edge_rows, plain
from llm_brute import quality

from tallybook.llm import language_id, quality_classifier, quality_rules, queries, sharding


def test_rules_match_brute_force(spark, edge, nothing):
    found = quality_rules.judge(edge).drop("broken").collect()
    assert plain(found) == plain((i, *quality(t)) for i, t, *_ in edge_rows())
    kept = quality_rules.keep_good(edge)
    assert kept.dtypes == edge.dtypes
    assert plain((r["doc_id"], r["text"]) for r in kept.collect()) == plain(
        (i, t) for i, t, *_ in edge_rows() if quality(t)[-1]
    )
    assert quality_rules.judge(nothing).count() == quality_rules.keep_good(nothing).count() == 0


def test_rules_at_their_thresholds(spark):
    rules = (quality_rules.Rule("symbols", "n_symbols", "n_words", high=10),)
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w + "#" * (i < 4) for i, w in enumerate(words)))]
    rows += [(2, " ".join(w + "#" * (i < 5) for i, w in enumerate(words))), (3, " ".join(words[:19]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"], r["broken"]) for r in quality_rules.judge(docs, rules).collect()}
    assert got == {1: (False, True, ""), 2: (False, False, "symbols"), 3: (True, False, "")}


def test_rules_keep_clean_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = [r for r in queries.queries()["op2_quality_rules"](spark, MEDIUM).collect() if r["doc_id"] in labels]
    clean = [r for r in rows if labels[r["doc_id"]] == 1 and not r["base_failed"]]
    junk = [r for r in rows if labels[r["doc_id"]] == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert sum(r["kept"] for r in junk) <= 0.05 * len(junk)


def test_quality_scores_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = queries.queries()["op5_quality_classifier"](spark, MEDIUM).collect()
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in tested) >= 0.97 * len(tested)


def test_quality_scores_of_odd_tables(spark, edge, nothing):
    def labelled(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    scored = quality_classifier.classify(edge, labelled([(1, 1, 0), (1, 0, 0), (3, None, 0), (None, 1, 0), (8, 1, 0), (15, 0, 0)]))
    rows = scored.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in edge_rows())
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality_classifier.classify(edge, labelled([])).collect()} == {0.5 * 0.999 + 0.001 / 2}
    assert quality_classifier.classify(nothing, labelled([(1, 1, 0)])).count() == 0
    assert all(r["predicted"] == 1 for r in quality_classifier.classify(edge, labelled([(1, 1, 0), (8, 1, 0)])).collect())


def test_isotonic_curve_rises_and_keeps_the_mean():
    import numpy as np

    y = quality_classifier.isotonic(np.zeros(6), np.array([1.0, 2, 1, 1, 4, 1]), np.array([0.1, 0.5, 0.2, 0.6, 0.3, 0.9]))
    assert all(np.diff(y) >= 0)
    assert np.isclose(y @ [1, 2, 1, 1, 4, 1], 0.1 + 1 + 0.2 + 0.6 + 1.2 + 0.9)


@pytest.mark.parametrize("words", [["banana", "bandana", "ana"], ["aaaa"], ["x"]])
def test_suffix_automaton_against_substrings(words):
    automaton, all_ = language_id.SuffixAutomaton(words), " ".join(["", *words, ""])
    for text in (" banana ", " bananas ", " q ", "", " aaaaa ", " anaban xx"):
        phrases, at = 0, 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in all_:
                size += 1
            at, phrases = at + size, phrases + 1
        assert automaton.phrases(text) == phrases


def test_languages_of_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = queries.queries()["op6_language_id"](spark, MEDIUM).collect()
    tested = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.98 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(spark, edge, nothing):
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(edge).collect()]
    assert Counter(i for i, _ in got) == Counter(i for i, *_ in edge_rows())
    assert {lang for i, lang in got if i in (4, 5, 6, 14)} == {"und"}
    assert {lang for i, lang in got if i not in (4, 5, 6, 14)} == {"en"}
    kept = language_id.keep_identified(edge)
    assert kept.dtypes == edge.dtypes
    assert kept.count() == len(edge_rows()) - 4
    assert language_id.identify(nothing).count() == language_id.keep_identified(nothing).count() == 0
    unlabelled = edge.withColumn("lang", edge["lang"].substr(9, 1)).replace({"": None}, subset="lang")
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_placement_is_even_and_stable(spark, edge, nothing):
    shards = sharding.SHARDS
    table = sharding.lookup_table(shards)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1])
    kept = [(a, b) for a, b in zip(table, fewer, strict=True) if a != len(shards) - 1]
    assert sum(a != b for a, b in kept) <= 0.15 * len(kept)
    assert sharding.lookup_table(("one",), 5) == [0] * 5
    for bad in ((shards, 4098), (("a", "a"), 7), ((), 7), (("a", "b", "c"), 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)
    rows = sharding.shard(edge).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in edge_rows())
    assert all(r["shard"] == shards[table[r["slot"]]] for r in rows)
    assert sharding.shard(nothing).count() == 0


def test_texts_without_a_letter_have_no_language(spark):
    from tallybook.llm import language_id

    texts = ["½ ²", "①", "12 ³ _ ٣", "½a", "Ⅷ", "the ½cup and①or"]
    known = [(100 + i, "the cat and the dog sat on a mat", "en") for i in range(20)]
    known += [(200 + i, "der hund und die katze sind im haus", "de") for i in range(20)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + known
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert [got[i] == "und" for i in range(6)] == [not any(map(str.isalpha, t)) for t in texts]
    assert got[5] == "en"
    assert language_id.words_of("½Cup①Or x2") == ["cup", "or", "x"]


def test_a_worker_holds_the_tables_of_one_operator():
    from tallybook.llm import batches

    made = []
    for key in ("a", "a", "b", "a"):
        batches.held((key,), lambda k=key: made.append(k) or k)
    assert made == ["a", "b", "a"]
