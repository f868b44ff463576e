"""Recommendations against brute force, with hot products, copies of customers and ties."""

import math
import os
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallybook.operators import recommend as rec
from tallybook.sources.staging import CLEANS_UP, stage

COLUMNS = "InvoiceNo string, StockCode string, Description string, Quantity int, CustomerID bigint"


def make_lines(seed):
    """40 customers over 25 products: P0 is bought by nearly all, 8 customers buy P0 only, some sets repeat."""
    rng = random.Random(seed)
    lines, invoice = [], 0
    for customer in range(1, 41):
        if customer <= 8:
            carts = [["P00"]]
        elif customer <= 14:
            carts = [["P00", "P03", "P07"]]
        else:
            carts = [
                sorted({"P00"} | {f"P{min(rng.randrange(25), rng.randrange(25)):02d}" for _ in range(rng.randrange(1, 5))})
                if rng.random() < 0.8
                else [f"P{rng.randrange(25):02d}"]
                for _ in range(rng.randrange(1, 4))
            ]
        for cart in carts:
            invoice += 1
            lines += [(str(invoice), code, f"name {code}", rng.randrange(1, 5), customer) for code in cart]
    return lines


def brute_items(lines, k):
    carts, owned = defaultdict(set), defaultdict(set)
    for inv, code, _, _, customer in lines:
        carts[inv].add(code)
        owned[customer].add(code)
    pairs = Counter((a, b) for cart in carts.values() for a in cart for b in cart if a != b)
    out = set()
    for customer, codes in owned.items():
        score = Counter()
        for (a, b), n in pairs.items():
            if a in codes and b not in codes:
                score[b] += n
        ranked = sorted(score.items(), key=lambda t: (-t[1], t[0]))[:k]
        out |= {(customer, i + 1, code, n) for i, (code, n) in enumerate(ranked)}
    return out


def brute_similar(lines, k):
    owned = defaultdict(set)
    for _, code, _, _, customer in lines:
        owned[customer].add(code)
    out = set()
    for c, mine in owned.items():
        others = [(len(mine & theirs), len(theirs), o) for o, theirs in owned.items() if o != c and mine & theirs]
        ranked = sorted(others, key=lambda t: (-t[0] ** 2 / t[1], t[2]))[:k]
        out |= {
            (c, i + 1, o, round(common / math.sqrt(len(mine) * size), 9)) for i, (common, size, o) in enumerate(ranked)
        }
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [2, 9, 1000])
def test_item_recommendations(spark, seed, hot):
    lines = make_lines(seed)
    tx = spark.createDataFrame(lines, COLUMNS)
    got = rec.item_recommendations(tx, k=4, hot_owners=hot).select("CustomerID", "Rank", "StockCode", "Score").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_items(lines, 4)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [2, 9, 1000])
def test_similar_customers(spark, seed, hot):
    lines = make_lines(seed)
    tx = spark.createDataFrame(lines, COLUMNS)
    got = rec.similar_customers(tx, k=3, hot_owners=hot).collect()
    assert len(got) == len(set(got))
    assert {(r.CustomerID, r.Rank, r.SimilarID, round(r.Similarity, 9)) for r in got} == brute_similar(lines, 3)


def test_lists_filled_with_zero_scores(spark):
    # customer 1 shares nothing with anyone; A-B go together, C and D stand alone
    lines = [("1", "D", "", 1, 1), ("2", "A", "", 1, 2), ("2", "B", "", 1, 2), ("3", "A", "", 1, 3), ("4", "C", "", 1, 4)]
    tx = spark.createDataFrame(lines, COLUMNS)
    items = rec.item_recommendations(tx, k=2, include_zero=True).select("CustomerID", "Rank", "StockCode", "Score")
    assert {tuple(r) for r in items.collect()} == {
        (1, 1, "A", 0), (1, 2, "B", 0), (2, 1, "C", 0), (2, 2, "D", 0), (3, 1, "B", 1), (3, 2, "C", 0), (4, 1, "A", 0), (4, 2, "B", 0),
    }
    near = rec.similar_customers(tx, k=2, include_zero=True).collect()
    assert {(r.CustomerID, r.Rank, r.SimilarID) for r in near} == {
        (1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1), (4, 1, 1), (4, 2, 2),
    }
    assert {r.Similarity for r in near if r.CustomerID in (1, 4)} == {0.0}
    chosen = spark.createDataFrame([(4,)], "CustomerID bigint")
    few = rec.similar_customers(tx, k=2, selected=chosen, include_zero=True).collect()
    assert {(r.CustomerID, r.Rank, r.SimilarID) for r in few} == {(4, 1, 1), (4, 2, 2)}


def test_selected_customers_get_the_same_answers(spark):
    lines = make_lines(3)
    tx = spark.createDataFrame(lines, COLUMNS)
    chosen = spark.createDataFrame([(3,), (11,), (30,)], "CustomerID bigint")
    ids = {3, 11, 30}
    similar = rec.similar_customers(tx, k=3, selected=chosen).collect()
    assert {(r.CustomerID, r.Rank, r.SimilarID, round(r.Similarity, 9)) for r in similar} == {
        t for t in brute_similar(lines, 3) if t[0] in ids
    }
    items = rec.item_recommendations(tx, k=4, selected=chosen).select("CustomerID", "Rank", "StockCode", "Score")
    assert {tuple(r) for r in items.collect()} == {t for t in brute_items(lines, 4) if t[0] in ids}


@pytest.mark.parametrize("chunk", [2, 1000])
def test_co_occurrence_of_a_large_basket(spark, chunk):
    lines = [("1", f"P{i:02d}", None, 1, 1) for i in range(30)] + [("2", "P00", None, 1, 2), ("2", "P01", None, 1, 2)]
    tx = spark.createDataFrame(lines + [("2", "P01", None, 3, 2)], COLUMNS)
    counts = {(r.A, r.B): r.n for r in rec.co_occurrence(rec.basket(tx), chunk).collect()}
    assert len(counts) == 30 * 29
    assert all(counts[b, a] == n for (a, b), n in counts.items())
    assert counts["P00", "P01"] == 2 and counts["P02", "P03"] == 1


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_spread_join_equals_join(spark, part):
    left = spark.createDataFrame([(k, i) for k in "aab" for i in range(4)] + [("z", 9)], "k string, l int")
    right = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1), ("c", 2)], "k string, r int")
    got = sorted(map(tuple, rec.spread_join(left, right, "k", part).select("k", "l", "r").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "l", "r").collect()))


def test_one_description_or_all(spark):
    lines = [("1", "A", "old", 1, 1), ("2", "A", "new", 1, 1), ("3", "A", "new", 1, 1), ("4", "B", None, 1, 1)]
    tx = spark.createDataFrame(lines, COLUMNS).selectExpr("*", "CAST(1 AS DECIMAL(18,4)) AS TotalPrice")
    wanted = spark.createDataFrame([("A",), ("B",)], "StockCode string")
    one = {(r.StockCode, r.Description) for r in rec.describe_products(wanted, tx).collect()}
    assert one == {("A", "new"), ("B", None)}
    every = {(r.StockCode, r.Description) for r in rec.describe_products(wanted, tx, fanout=True).collect()}
    assert every == {("A", "new"), ("A", "old"), ("B", None)}


def test_popularity_shares_ranks_on_ties(spark):
    lines = [("1", c, c, 1, 1) for c in "AABBC"]
    tx = spark.createDataFrame(lines, COLUMNS).selectExpr("*", "CAST(1 AS DECIMAL(18,4)) AS TotalPrice")
    got = {r.StockCode: round(r.Popularity, 9) for r in rec.product_metrics(tx).collect()}
    assert got == {"A": round(2.5 / 3, 9), "B": round(2.5 / 3, 9), "C": round(1 / 3, 9)}


def test_user_recommendations(spark):
    lines = make_lines(5)
    tx = spark.createDataFrame(lines, COLUMNS)
    owned = defaultdict(set)
    for _, code, _, _, customer in lines:
        owned[customer].add(code)
    neighbours = rec.similar_customers(tx, k=5)
    near = defaultdict(list)
    for r in neighbours.collect():
        near[r.CustomerID].append((r.SimilarID, round(r.Similarity / rec.SCORE_STEP)))
    expected = set()
    for c, others in near.items():
        score = Counter()
        for other, weight in others:
            for code in owned[other] - owned[c]:
                score[code] += weight
        ranked = sorted(score.items(), key=lambda t: (-t[1], t[0]))[:3]
        expected |= {(c, i + 1, code, round(w * rec.SCORE_STEP, 9)) for i, (code, w) in enumerate(ranked)}
    got = rec.user_recommendations(tx, neighbours, k=3).collect()
    assert {(r.CustomerID, r.Rank, r.StockCode, round(r.Score, 9)) for r in got} == expected


def test_spread_join_divides_a_key_that_is_large_on_the_left(spark):
    left = spark.range(600).selectExpr("1 AS k", "id AS x").union(spark.createDataFrame([(2, 1), (3, 1)], "k int, x long"))
    right = spark.range(30).selectExpr("1 AS k", "id AS y").union(spark.createDataFrame([(2, 5), (4, 1)], "k int, y long"))
    # small test data would be broadcast, or gathered in one task
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = rec.spread_join(left, right, "k", part=20)
        assert joined.columns == ["k", "x", "y"]
        per_task = [n for n in joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert sum(per_task) == 600 * 30 + 1
        assert len(per_task) >= 4 and max(per_task) < 0.6 * sum(per_task)
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_similar_customers_make_few_pair_rows(spark, capsys):
    """Pairs of customers that become rows, against the pairs that share a product (each a row in a plain self-join)."""
    import __spark_entry__ as registry

    owned = rec.stage(rec.owned_products(registry.transactions(spark, "/root/testdata/sf0.01")))
    sets = owned.withColumnRenamed("CustomerID", "Profile")
    facts = sets.groupBy("Profile").count().selectExpr("Profile", "count AS Size", "0L AS Hot")
    owners = [r["count"] for r in sets.groupBy("StockCode").count().collect()]
    pairs = sum(n * (n - 1) // 2 for n in owners)
    probes = rec.light_probes(sets, facts)
    lists, rows = probes.count(), rec._best_overlaps(probes, "Profile", 11, hot=False, among=True).count()
    with capsys.disabled():
        print(f"\n{pairs} pairs share a product: {rows} become rows ({rows / pairs:.1%}), from {lists} lists read")
    # no pair is a row before it is counted: a profile reads one list per product it owns
    assert lists == sets.count()
    assert rows < 0.1 * pairs


@pytest.mark.parametrize("at_once", [3, 50])
def test_a_customer_of_very_many_partners_is_read_in_parts(spark, at_once):
    lines = make_lines(4)
    owned = spark.createDataFrame(lines, COLUMNS).select("CustomerID", "StockCode").distinct()
    sets = rec.stage(owned.withColumnRenamed("CustomerID", "Profile"))
    facts = sets.groupBy("Profile").count().selectExpr("Profile", "count AS Size", "0L AS Hot")
    parted = rec.light_probes(sets, facts, at_once)
    assert parted.filter("Part > 0").count() > 0
    met = rec._best_overlaps(parted, "Profile", 1000, hot=False, among=True).collect()
    got = {(r.Profile, r.Other, r.Common, r.OtherSize) for r in met}
    assert len(got) == len(met)
    by = defaultdict(set)
    for r in sets.collect():
        by[r.Profile].add(r.StockCode)
    assert got == {(a, b, len(by[a] & by[b]), len(by[b])) for a in by for b in by if a != b and by[a] & by[b]}


def test_hot_products_are_read_by_bands_of_sizes(spark):
    """Customers of two hot products and very different numbers of rare ones; ties at every size."""
    rng = random.Random(11)
    lines = []
    for customer in range(1, 61):
        hot = [f"H{h}" for h in range(3) if rng.random() < 0.7] or ["H0"]
        rare = [f"R{customer}_{i}" for i in range(rng.choice([0, 0, 1, 3, 7, 20]))]
        lines += [(str(customer), code, "", 1, customer) for code in hot + rare]
    tx = spark.createDataFrame(lines, COLUMNS)
    got = rec.similar_customers(tx, k=4, hot_owners=10).collect()
    assert len(got) == len(set(got))
    assert {(r.CustomerID, r.Rank, r.SimilarID, round(r.Similarity, 9)) for r in got} == brute_similar(lines, 4)


def test_item_recommendations_make_few_rows(spark, capsys):
    """Rows that scoring makes, against one for each partner of each owned product."""
    import __spark_entry__ as registry

    tx = registry.transactions(spark, "/root/testdata/sf0.001")
    numbers = rec.numbered_products(rec.basket(tx))
    codes = [r.StockCode for r in numbers.orderBy("Number").collect()]
    assert codes == sorted(codes) and len(codes) == len(set(codes))

    def numbered(pairs, key):
        return rec.stage(pairs.join(numbers, "StockCode").selectExpr(key, "Number AS StockCode"))

    owned = numbered(rec.owned_products(tx), "CustomerID")
    counts = rec.stage(rec.co_occurrence(numbered(rec.basket(tx), "InvoiceNo")))
    partners = owned.join(counts.withColumnRenamed("A", "StockCode"), "StockCode").count()
    probes = rec._in_parts(owned, rec._partner_lists(counts), "CustomerID", 1 << 22)
    rows = rec._item_scores(probes, "CustomerID", 10, False).count()
    with capsys.disabled():
        print(f"\n{partners} partners of owned products: {rows} become rows ({rows / partners:.1%})")
    assert rows < 0.1 * partners


def test_only_the_invoices_of_a_chosen_customer_are_paired(spark):
    lines = make_lines(6)
    baskets = spark.createDataFrame(lines, COLUMNS).select("InvoiceNo", "StockCode").distinct()
    products = spark.createDataFrame([("P03",), ("P07",)], "StockCode string")
    got = {tuple(r) for r in rec._partners_of(baskets, products, part=2).select("A", "B", "n").collect()}
    every = {tuple(r) for r in rec.co_occurrence(baskets).select("A", "B", "n").collect()}
    assert got == {t for t in every if t[0] in ("P03", "P07")}


@pytest.mark.parametrize("at_once", [40, 1 << 22])
def test_scores_in_parts_equal_scores(spark, at_once, monkeypatch):
    monkeypatch.setattr(rec, "OWNERS_AT_ONCE", at_once)
    monkeypatch.setattr(rec, "LIST", 7)
    lines = make_lines(8)
    tx = spark.createDataFrame(lines, COLUMNS)
    got = rec.item_recommendations(tx, k=4, hot_owners=9).select("CustomerID", "Rank", "StockCode", "Score").collect()
    assert {tuple(r) for r in got} == brute_items(lines, 4)


@pytest.mark.parametrize("few", [0, 60])
def test_blocks_and_signatures_give_the_same_results(spark, few, monkeypatch):
    """Many blocks, merged a few entries at a time, with all customers by signature or only those who meet many entries."""
    for name, value in {"FEW": few, "BLOCK": 90, "AT_ONCE": 25, "LIST": 9}.items():
        monkeypatch.setattr(rec, name, value)
    lines = make_lines(9)
    tx = spark.createDataFrame(lines, COLUMNS)
    got = rec.item_recommendations(tx, k=4, hot_owners=9).select("CustomerID", "Rank", "StockCode", "Score").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_items(lines, 4)
    similar = rec.similar_customers(tx, k=4, hot_owners=9).collect()
    assert len(similar) == len(set(similar))
    assert {(r.CustomerID, r.Rank, r.SimilarID, round(r.Similarity, 9)) for r in similar} == brute_similar(lines, 4)


def test_customers_who_meet_few_entries_need_no_signatures(spark, monkeypatch):
    """Scores of every signature became rows before: as many as customers times partners where sets hardly repeat."""
    made = []
    signatures = rec._signatures
    monkeypatch.setattr(rec, "_signatures", lambda pairs, entity, item: made.append(entity) or signatures(pairs, entity, item))
    lines = make_lines(3)
    tx = spark.createDataFrame(lines, COLUMNS)
    got = rec.item_recommendations(tx, k=4, hot_owners=1).select("CustomerID", "Rank", "StockCode", "Score").collect()
    assert {tuple(r) for r in got} == brute_items(lines, 4) and not made
    similar = rec.similar_customers(tx, k=4, hot_owners=1).collect()
    # one grouping of equal sets, none of hot products
    assert {(r.CustomerID, r.Rank, r.SimilarID, round(r.Similarity, 9)) for r in similar} == brute_similar(lines, 4)
    assert made == ["CustomerID"]


def test_lists_take_few_bytes_and_go_once_to_a_block(spark):
    import numpy as np
    import pyarrow as pa

    pairs = spark.range(2000).selectExpr("id % 5 AS A", "id + 70000 AS B", "id % 7 + 1 AS n")
    packed = rec._pack_partners(rec._partners(pairs), pairs)
    rows = packed.lists.collect()
    assert packed.widths == [1, 3] and sum(r.Entries for r in rows) == 2000
    assert sum(len(r.List) for r in rows) == 4 * 2000
    # two keys read the same two lists, of which one row each is sent
    sent = pa.table({"Sent": [r.StockCode for r in rows if r.StockCode < 2], "List": [bytes(r.List) for r in rows if r.StockCode < 2]})
    held = pa.table(
        [[8, 9, 9, 8], [0, 1, 0, 1], [True] * 4, [1] * 4, [70000, 70001, -1, 3], [-100, -100, 50, 0]],
        ["Key", "Item", "Reads", "Weight", "Other", "Value"],
    )
    want = {i + 70000: i % 7 + 1 for i in range(2000) if i % 5 < 2}
    for weights in ([1] * 4, [2] * 4):
        held = held.set_column(3, "Weight", pa.array(weights))
        got = {k: dict(zip(*np.asarray(e).tolist(), strict=True)) for k, e in rec._merged_entries(held, sent, packed.fields, packed.widths)}
        for key, own in ((8, {70000: -100}), (9, {70001: -100, -1: 50})):
            assert got[key] == {o: weights[0] * want.get(o, 0) + own.get(o, 0) for o in want | own}


def _lines_frame(spark, seed):
    return spark.createDataFrame(
        [(f"{i}", s, "d", q, c, "1.5") for i, s, q, c in _plain_lines(seed)],
        "InvoiceNo string, StockCode string, Description string, Quantity int, CustomerID long, TotalPrice string",
    )


def _plain_lines(seed):
    r = random.Random(seed)
    return [(r.randrange(60), f"p{r.randrange(25)}", r.randrange(1, 4), 1 + r.randrange(12)) for _ in range(400)]


def test_tables_that_no_later_step_reads_are_gone(spark, monkeypatch):
    """Pairs of products are kept in one order only, and the baskets behind them not at all."""
    staged = []
    monkeypatch.setattr(rec, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    found = rec.item_recommendations(_lines_frame(spark, 3), k=4)
    assert found.count()
    pairs = [df for df in staged if df.columns == ["A", "B", "n"]]
    assert len(pairs) == 1 and pairs[0].filter("A >= B").isEmpty()
    files = [f for df in staged if "InvoiceNo" in df.columns for f in df.inputFiles()]
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_shuffle_files_go_with_the_step_that_made_them(spark):
    def held():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {blocks.apply(i).toString() for i in range(blocks.size())}

    before, setting = held(), spark.conf.get(CLEANS_UP)
    counted = stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("x")).agg(F.count("id").alias("n")))
    until = time.time() + 10
    while (left := {b for b in held() - before if b.startswith("shuffle_")}) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert counted.count() == 100 and spark.conf.get(CLEANS_UP) == setting


def test_a_block_holds_few_rows_of_its_keys_own(spark, monkeypatch):
    """Twenty keys that read one entry each, but hold fifty rows of their own, do not go to one task."""
    monkeypatch.setattr(rec, "BLOCK", 1000)
    monkeypatch.setattr(rec, "FEW", 1000)
    placed, blocks = [], rec._blocks
    monkeypatch.setattr(rec, "_blocks", lambda *a: placed.append(blocks(*a)) or placed[-1])
    lists = spark.createDataFrame([(1, [(7,)])], "StockCode long, List array<struct<Other:long>>")
    packed = rec._pack(lists, spark.createDataFrame([(7,)], "Other long"))
    rows = [(k, 1, True, 1, 0, 0) for k in range(20)] + [(k, -1, False, 0, 100 + n, -1) for k in range(20) for n in range(50)]
    held = spark.createDataFrame(rows, "Key long, Item long, Reads boolean, Weight long, Other long, Value long")
    found = rec._from_blocks(held, packed, "Key", ["Other", "Sum"], lambda _, e: [e[0], e[1]], lambda keys: keys)
    assert {(r["Key"], r["Other"]) for r in found.collect() if r["Sum"] > 0} == {(k, 7) for k in range(20)}
    assert placed[0].select("Block").distinct().count() >= 10
