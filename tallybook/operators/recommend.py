"""Co-purchase counts, customer similarity, and product recommendations for all customers at once.

Wide matrices never appear: baskets and purchases stay (row, column) pairs. Groups that may be
huge are handled in three exact ways:

* the pairs of one large basket are spread over several tasks by a salt;
* customers who own the same set of products are compared once, as one profile;
* products with very many owners ("hot") do not take part in the pairwise work. What they add to a
  score depends only on which hot products a customer owns, so it is computed once for each such
  combination (a "signature"), ranked there, and merged with the scores of the other products.

Similar customers come from an index of products, rarest first: a profile reads the lists of owners of
its rare products, counts them in place, and knows from its k-th best what any other must reach. Only
pairs that may reach it get their hot products counted, and the owners of hot products are read in
order of the size of their sets, until none that is left can reach it.

Whoever meets few entries in all the lists reads them all: signatures are for those who meet many. Lists are
packed into a few bytes an entry and go to blocks of neighbouring customers, once to each block, however many
of its customers read them.

Why merging is exact: take a customer's list ranked by the hot products alone. A candidate that the
other products do not touch keeps its hot score, while everything ahead of it can only gain. So if
it belongs to the true best k, it is among the first k of the hot list (not counting entries the
customer may not be given). The candidates that the other products do touch are all scored in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.expressions import money
from tallybook.sources.staging import stage, unstage


# entries of lists that a task merges for one key; beyond, they are divided into parts
OWNERS_AT_ONCE = 4_000_000
# about so many entries make one list
LIST = 1 << 16
# whoever meets no more entries reads all lists, hot ones too
FEW = 1 << 15
# entries that the keys of one block read, a list counted for each of them
BLOCK = 1 << 24
# as many entries as take the room of a row that says what a key reads or has itself
ROW = 24
# entries that are merged at once within a block
AT_ONCE = 1 << 20


def basket(tx: DataFrame) -> DataFrame:
    """Distinct (InvoiceNo, StockCode) with units above zero."""
    return _pairs(tx, "InvoiceNo")


def owned_products(tx: DataFrame) -> DataFrame:
    """Distinct (CustomerID, StockCode) with units above zero."""
    return _pairs(tx, "CustomerID")


def _pairs(tx: DataFrame, key: str) -> DataFrame:
    return (
        tx.filter(F.col(key).isNotNull() & F.col("StockCode").isNotNull())
        .groupBy(key, "StockCode")
        .agg(F.sum("Quantity").alias("Units"))
        .filter(F.col("Units") > 0)
        .select(key, "StockCode")
    )


def spread_join(left: DataFrame, right: DataFrame, key: str, part: int = 2_000) -> DataFrame:
    """Inner join on `key` that divides the rows of a large key, on either side, into parts of about `part` rows.

    Every part of the left meets every part of the right, so that the matches of such a key are made by many tasks.
    Adaptive execution does not help there: it looks at the bytes that go in, not at the rows that
    come out.
    """

    def large(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / part).alias(name)).filter(F.col(name) > 1)

    sizes = large(left, "Lefts").join(large(right, "Rights"), key, "full")
    one = F.lit(1).cast("bigint")
    lefts, rights = F.coalesce("Lefts", one), F.coalesce("Rights", one)

    def own(side: DataFrame, parts: Column) -> Column:
        return F.pmod(F.xxhash64(*side.columns), parts)

    def each(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))

    divided_left = left.join(sizes, key, "left").select(
        *left.columns, own(left, lefts).alias("LeftPart"), each(rights).alias("RightPart")
    )
    divided_right = right.join(sizes, key, "left").select(
        *right.columns, each(lefts).alias("LeftPart"), own(right, rights).alias("RightPart")
    )
    return divided_left.join(divided_right, [key, "LeftPart", "RightPart"]).drop("LeftPart", "RightPart")


def co_occurrence(baskets: DataFrame, part: int = 2_000) -> DataFrame:
    """In how many invoices two products appear together, for every pair that does, in both orders.

    One invoice never yields more pairs than the result has rows, an invoice with more than `part`
    products is paired in parts by several tasks, and counts are combined before the shuffle: the
    work follows the baskets and the result.
    """
    return _both_ways(_co_occurrence_halves(baskets, part), "A", "B", "n")


def _co_occurrence_halves(baskets: DataFrame, part: int = 2_000) -> DataFrame:
    return (
        spread_join(
            baskets.select("InvoiceNo", F.col("StockCode").alias("A")),
            baskets.select("InvoiceNo", F.col("StockCode").alias("B")),
            "InvoiceNo",
            part,
        )
        .filter(F.col("A") < F.col("B"))
        .groupBy("A", "B")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _both_ways(halves: DataFrame, left: str, right: str, value: str) -> DataFrame:
    swapped = F.struct(F.col(right).alias(left), F.col(left).alias(right), value)
    return halves.select(F.inline(F.array(F.struct(left, right, value), swapped)))


def product_lookup(tx: DataFrame) -> DataFrame:
    """Distinct (StockCode, Description); a code may have several descriptions."""
    return tx.select("StockCode", "Description").distinct()


def _per_description(tx: DataFrame) -> DataFrame:
    """Counts and sums per (StockCode, Description), from which descriptions and metrics follow."""
    return (
        tx.filter(F.col("StockCode").isNotNull())
        .groupBy("StockCode", "Description")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("Quantity").alias("Lines"),
            F.sum("Quantity").alias("Quantity"),
            F.sum("TotalPrice").alias("TotalPrice"),
        )
    )


def product_descriptions(tx: DataFrame) -> DataFrame:
    """One description per code: the one on most lines, then the alphabetically first."""
    counted = tx.filter(F.col("StockCode").isNotNull()).groupBy("StockCode", "Description")
    return _main_description(counted.agg(F.count(F.lit(1)).alias("n")))


def _main_description(per_description: DataFrame) -> DataFrame:
    return (
        per_description.filter(F.col("Description").isNotNull())
        .groupBy("StockCode")
        .agg(F.min_by("Description", F.struct(-F.col("n"), F.col("Description"))).alias("Description"))
    )


def top_units(tx: DataFrame, n: int = 20) -> DataFrame:
    return (
        tx.filter(F.col("StockCode").isNotNull())
        .groupBy("StockCode")
        .agg(F.sum("Quantity").alias("Quantity"))
        .orderBy(F.desc("Quantity"), "StockCode")
        .limit(n)
    )


def top_co_occurrence(tx: DataFrame, n: int = 20) -> DataFrame:
    """The co-occurrence grid of the n products with most units, zeros included, with display labels.

    The log is cut to these products before pairing, so an invoice contributes at most n codes.
    """
    top = stage(top_units(tx, n).select("StockCode"))  # n rows, whose size Spark reads from the file
    counts = co_occurrence(basket(tx.join(top, "StockCode", "left_semi")))
    codes = top.agg(F.sort_array(F.collect_list("StockCode")).alias("codes"))  # n codes
    grid = codes.select("codes", F.explode("codes").alias("A")).select("A", F.explode("codes").alias("B"))
    labels = product_descriptions(tx.join(top, "StockCode", "left_semi")).select(
        "StockCode", label(F.col("StockCode"), F.col("Description")).alias("Label")
    )

    def labelled(axis: str) -> DataFrame:
        return labels.select(F.col("StockCode").alias(axis), F.col("Label").alias(f"Given_{axis}"))

    return (
        grid.join(counts, ["A", "B"], "left")
        .join(labelled("A"), "A", "left")
        .join(labelled("B"), "B", "left")
        .select(
            "A",
            F.coalesce("Given_A", "A").alias("Label_A"),
            "B",
            F.coalesce("Given_B", "B").alias("Label_B"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def label(code: Column, description: Column) -> Column:
    """Code and the start of the description, as shown beside the grid."""
    return F.concat(code, F.lit(" - "), F.substring(description, 1, 20), F.lit("..."))


def customers(tx: DataFrame) -> DataFrame:
    return tx.select("CustomerID").distinct()


def customer_lines(tx: DataFrame, customer_id: int) -> DataFrame:
    """The lines of one customer; the filter reaches the scan."""
    return tx.filter(F.col("CustomerID") == customer_id)


def customer_kpis(tx: DataFrame) -> DataFrame:
    """Spend, orders and distinct products of each customer; a missing number counts as one value."""
    return tx.groupBy("CustomerID").agg(
        money(F.sum("TotalPrice")).alias("TotalPurchases"),
        F.count_distinct(F.coalesce("InvoiceNo", F.lit(""))).alias("Orders"),
        F.count_distinct(F.coalesce("StockCode", F.lit(""))).alias("UniqueProducts"),
    )


def customer_top_products(tx: DataFrame, k: int = 5) -> DataFrame:
    """Each customer's k products with most units, with revenue and the first description seen."""
    rank = F.row_number().over(Window.partitionBy("CustomerID").orderBy(F.desc("Quantity"), "StockCode"))
    return (
        tx.filter(F.col("StockCode").isNotNull())
        .groupBy("CustomerID", "StockCode")
        .agg(
            F.sum("Quantity").alias("Quantity"),
            money(F.sum("TotalPrice")).alias("TotalPrice"),
            F.min_by(
                "Description",
                F.when(F.col("Description").isNotNull(), F.struct("InvoiceDate", "InvoiceNo", "Description")),
            ).alias("Description"),
        )
        .withColumn("Rank", rank)
        .filter(F.col("Rank") <= k)
    )


def product_metrics(tx: DataFrame) -> DataFrame:
    """Units, revenue and popularity of each product.

    Popularity is the percentile rank of the line count, ties sharing their mean rank, in (0, 1].
    """
    return _metrics(_per_description(tx))


def _metrics(per_description: DataFrame) -> DataFrame:
    """Ranks are summed over distinct line counts: these are at most sqrt(2 * lines) rows, so the
    global window stays small, however many products there are."""
    products = stage(
        per_description.groupBy("StockCode").agg(
            F.sum("Quantity").alias("Quantity"),
            money(F.sum("TotalPrice")).alias("TotalPrice"),
            F.sum("Lines").alias("Lines"),
        )
    )
    up_to_here = Window.orderBy("Lines").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = (
        products.groupBy("Lines")
        .agg(F.count(F.lit(1)).alias("Peers"))
        .select(
            "Lines",
            (
                (F.sum("Peers").over(up_to_here) - (F.col("Peers") - 1) / 2) / F.sum("Peers").over(Window.partitionBy())
            ).alias("Popularity"),
        )
    )
    return products.join(ranks, "Lines").select("StockCode", "Quantity", "TotalPrice", "Popularity")


def describe_products(
    recommended: DataFrame, tx: DataFrame, popularity: bool = True, fanout: bool = False
) -> DataFrame:
    """Add description and product metrics to rows with a StockCode.

    With `fanout`, a code with several descriptions repeats its row for each of them.
    """
    per_description = stage(_per_description(tx))
    if fanout:
        descriptions = per_description.select("StockCode", "Description")
    else:
        descriptions = _main_description(per_description)
    metrics = _metrics(per_description)
    if not popularity:
        metrics = metrics.drop("Popularity")
    return recommended.join(descriptions, "StockCode", "left").join(metrics, "StockCode", "left")


def _signatures(pairs: DataFrame, entity: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Group entities that hold the same set of items.

    Returns (entity, Signature, Size) and the items of each signature (Signature, item). A
    signature is named after its smallest entity. Sets are compared by their size and two
    independent 64-bit hashes, combined item by item, so no set is gathered in one place.
    """
    prints = pairs.groupBy(entity).agg(
        F.count(F.lit(1)).alias("Size"),
        F.bit_xor(F.xxhash64(F.col(item))).alias("H1"),
        F.bit_xor(F.xxhash64(F.lit("second"), F.col(item))).alias("H2"),
    )
    names = prints.groupBy("Size", "H1", "H2").agg(F.min(entity).alias("Signature"))
    members = stage(prints.join(names, ["Size", "H1", "H2"]).select(entity, "Signature", "Size"))
    copies = members.filter(F.col(entity) != F.col("Signature"))
    items = pairs if copies.isEmpty() else pairs.join(copies.select(entity), entity, "left_anti")
    return members, items.select(F.col(entity).alias("Signature"), item)


def _hot_items(pairs: DataFrame, item: str, limit: int) -> DataFrame | None:
    """The items that are held more than `limit` times, if there are any."""
    hot = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("Holders")).filter(F.col("Holders") > limit).select(item)
    return None if hot.isEmpty() else stage(hot)


def _split_hot(pairs: DataFrame, item: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of other items, and the pairs of hot ones."""
    light = stage(pairs.join(hot, item, "left_anti").select(*pairs.columns))
    return light, stage(pairs.join(hot, item, "left_semi").select(*pairs.columns))


def _reads_many(pairs: DataFrame, hot: DataFrame, lengths: DataFrame, key: str) -> DataFrame | None:
    """The keys with a hot item that meet more than FEW entries in the lists of their items, if there are any."""
    marked = lengths.join(hot.withColumn("Hot", F.lit(True)), "StockCode", "left")
    met = pairs.join(marked, "StockCode").groupBy(key).agg(F.sum("Entries").alias("Met"), F.max("Hot").alias("Hot"))
    many = stage(met.filter(F.col("Hot") & (F.col("Met") > FEW)).select(key))
    return None if many.isEmpty() else many


def _partners_of(baskets: DataFrame, products: DataFrame, part: int = 2_000) -> DataFrame:
    """(A, B, n) as in `co_occurrence`, for the products A of a table: only their invoices are paired."""
    asked = baskets.join(products, "StockCode", "left_semi").select("InvoiceNo", F.col("StockCode").alias("A"))
    theirs = baskets.join(asked.select("InvoiceNo").distinct(), "InvoiceNo", "left_semi")
    return (
        spread_join(asked, theirs.select("InvoiceNo", F.col("StockCode").alias("B")), "InvoiceNo", part)
        .filter(F.col("A") != F.col("B"))
        .groupBy("A", "B")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# in a product's own list, which is read by its owners: below all sums of counts
OWNED = -(1 << 50)
# marks the entry that says how much the hot products of a customer can add at most
HOT_BOUND = -1


def _lists(entries: DataFrame, item: str, *fields: Column) -> DataFrame:
    """(StockCode, List): the entries of each item, of which the first field is Other. Long lists are divided by it."""
    sizes = entries.groupBy(item).agg(F.ceil(F.count(F.lit(1)) / LIST).alias("Lists"))
    return (
        entries.join(sizes, item)
        .select(F.col(item).alias("StockCode"), F.struct(*fields).alias("Entry"), "Lists")
        .groupBy("StockCode", F.pmod(F.xxhash64("Entry.Other"), F.col("Lists")).alias("Chunk"))
        .agg(F.collect_list("Entry").alias("List"))
        .select("StockCode", "List")
    )


def _partners(pair_counts: DataFrame) -> DataFrame:
    return _lists(pair_counts, "A", F.col("B").alias("Other"), F.col("n").alias("Value"))


def _with_itself(partners: DataFrame) -> DataFrame:
    return partners.select("StockCode", F.array_append("List", _entry(F.col("StockCode"), OWNED)).alias("List"))


def _partner_lists(pair_counts: DataFrame) -> DataFrame:
    """(StockCode, List): the partners of a product with their counts, and the product itself as owned."""
    return _with_itself(_partners(pair_counts))


def _entry(other: Column, value: Column | int) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.struct(other.cast("bigint").alias("Other"), value.cast("bigint").alias("Value"))


def _first(scores: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, in order; ties go to the smaller other."""
    ahead = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    return ahead[np.lexsort((others[ahead], -scores[ahead]))[:k]]


def _choose_items(k: int | None, hot: bool) -> Callable[[int, np.ndarray], list]:
    """(StockCode, Score): the k first by score and number, or all without k.

    With `hot`, all that could be among the first k if the hot products added as much as the bound says.
    """

    def choose(_: int, entries: np.ndarray) -> list:
        products, scores = entries
        more = scores[products == HOT_BOUND].max(initial=0) if hot else 0
        free = (scores > 0) & (products != HOT_BOUND)
        products, scores = products[free], scores[free]
        if k is None:
            return [products, scores]
        if hot:
            enough = np.partition(scores, -k)[-k] if len(scores) > k else 0
            chosen = np.flatnonzero(scores + more >= enough)
        else:
            chosen = _first(scores, products, k)
        return [products[chosen], scores[chosen]]

    return choose


def _item_scores(probes: DataFrame, key: str, k: int | None, hot: bool) -> DataFrame:
    """(key, StockCode, Score): summed counts of the products that a key does not own, chosen as `_choose_items` says."""
    return _from_lists(probes, key, ["StockCode", "Score"], _choose_items(k, hot))


def _item_scores_of(
    holdings: DataFrame, partners: DataFrame, packed: _Packed, key: str, k: int | None, facts: DataFrame | None = None
) -> DataFrame:
    """As `_item_scores`, of the products that a key holds; `facts` has further entries (key, List) of a key."""
    held = holdings.select(
        key, F.col("StockCode").alias("Item"), F.lit(True).alias("Reads"), *_weighs(1, F.col("StockCode"), OWNED)
    )
    if facts is not None:
        more = facts.select(key, F.explode("List").alias("e"))
        held = held.unionByName(
            more.select(key, F.col("e.Other").alias("Item"), F.lit(False).alias("Reads"), *_weighs(0, F.col("e.Other"), F.col("e.Value")))
        )

    def wide(keys: DataFrame) -> DataFrame:
        asking = holdings.join(keys, key, "left_semi")
        probes = _in_parts(asking, stage(_with_itself(partners)), key, OWNERS_AT_ONCE)
        if facts is not None:
            probes = probes.unionByName(probes.select(key, "Part").distinct().join(facts, key))
        return _item_scores(probes, key, k, facts is not None)

    return _from_blocks(held, packed, key, ["StockCode", "Score"], _choose_items(k, facts is not None), wide)


def item_scores(holdings: DataFrame, pair_counts: DataFrame, key: str) -> DataFrame:
    """Sum over the held products (numbers) of their co-occurrence with each product that is not held."""
    partners = _partners(pair_counts)
    return _item_scores_of(holdings, partners, _pack_partners(partners, pair_counts), key, None)


def _pack_partners(partners: DataFrame, pair_counts: DataFrame) -> _Packed:
    return _pack(partners, pair_counts.select(F.col("B").alias("Other"), F.col("n").alias("Value")))


def numbered_products(products: DataFrame) -> DataFrame:
    """(StockCode, Number): numbers in the order of the codes, without gathering the codes anywhere.

    They leave no gaps, so that they take few bytes: what a task numbers follows on the task before.
    """
    ordered = stage(products.select("StockCode").distinct().orderBy("StockCode").withColumn("Id", F.monotonically_increasing_id()))
    task = F.shiftright("Id", 33)
    before = Window.orderBy("Task").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks
    starts = ordered.groupBy(task.alias("Task")).agg(F.count(F.lit(1)).alias("n")).select(
        "Task", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("Start")
    )
    place = F.col("Id").bitwiseAND((1 << 33) - 1)
    return stage(ordered.withColumn("Task", task).join(F.broadcast(starts), "Task").select("StockCode", (F.col("Start") + place).alias("Number")))


def _by_number(pairs: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    return pairs.join(numbers, "StockCode").select(key, F.col("Number").alias("StockCode"))


def item_recommendations(
    tx: DataFrame,
    k: int = 10,
    selected: DataFrame | None = None,
    include_zero: bool = False,
    hot_owners: int = 10_000,
) -> DataFrame:
    """For each customer the k products not owned that go best with the owned ones.

    `selected` (a table of CustomerID) limits the customers asked for. With `include_zero`, lists
    shorter than k are filled up with products of score 0, by code. Products owned by more than
    `hot_owners` of these customers are scored by signature, for customers who would otherwise read many
    partners; the result does not depend on it.
    """
    baskets, owned = stage(basket(tx)), owned_products(tx)
    numbers = numbered_products(baskets)

    in_baskets = stage(_by_number(baskets, numbers, "InvoiceNo"))
    if selected is None:
        # each pair is kept once and turned round when it is read
        pair_counts = _both_ways(stage(_co_occurrence_halves(in_baskets)), "A", "B", "n")
    else:
        owned = owned.join(selected.select("CustomerID"), "CustomerID", "left_semi").select(*owned.columns)
        asked = _by_number(owned, numbers, "CustomerID").select("StockCode").distinct()
        pair_counts = stage(_partners_of(in_baskets, stage(asked)))
    if include_zero:
        owned = stage(owned)
    numbered = stage(_by_number(owned, numbers, "CustomerID"))
    unstage(in_baskets)
    if not include_zero:
        unstage(baskets)
    best = _best_items(numbered, pair_counts, k, hot_owners)
    coded = numbers.select("StockCode", F.col("Number").alias("Of"))
    best = best.join(coded, best["StockCode"] == coded["Of"]).select(
        "CustomerID", coded["StockCode"], "Score", "Rank"
    )
    if include_zero:
        best = _fill_with_products(stage(best), owned, baskets.select("StockCode").distinct(), k)
    return best


def _fill_with_products(best: DataFrame, owned: DataFrame, products: DataFrame, k: int) -> DataFrame:
    """Fill lists shorter than k with the first products that are neither owned nor listed."""
    taken = owned.unionByName(best.select("CustomerID", "StockCode"))
    listed = best.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("Listed"))
    short = stage(
        taken.groupBy("CustomerID")
        .agg(F.count(F.lit(1)).alias("Taken"))
        .join(listed, "CustomerID", "left")
        .fillna(0, ["Listed"])
        .filter(F.col("Listed") < k)
    )
    reach = short.agg(F.max("Taken")).first()[0]
    if reach is None:
        return best
    # what is missing lies within the first k + (number taken) products
    first = products.orderBy("StockCode").limit(reach + k)
    numbered = first.withColumn("Place", F.row_number().over(Window.orderBy("StockCode")).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("CustomerID").orderBy("StockCode"))
    filling = (
        short.select("CustomerID", "Listed", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("Taken") + k)).alias("Place"))
        .join(numbered, "Place")
        .join(taken, ["CustomerID", "StockCode"], "left_anti")
        .withColumn("Place", rank)
        .filter(F.col("Place") <= k)
        .withColumn("Rank", (F.col("Listed") + F.col("Place")).cast("int"))
        .filter(F.col("Rank") <= k)
    )
    return best.unionByName(filling.select("CustomerID", "StockCode", F.lit(0).cast("bigint").alias("Score"), "Rank"))


def _best_items(owned: DataFrame, pair_counts: DataFrame, k: int, hot_owners: int) -> DataFrame:
    """Products are numbers here, in the order of their codes."""
    partners = _partners(pair_counts)
    packed = _pack_partners(partners, pair_counts)
    hot = _hot_items(owned, "StockCode", hot_owners)
    many = None if hot is None else _reads_many(owned, hot, _lengths(packed.lists), "CustomerID")
    if many is None:
        return _best(_item_scores_of(owned, partners, packed, "CustomerID", k), k)
    few = stage(owned.join(many, "CustomerID", "left_anti"))
    by_lists = _best(_item_scores_of(few, partners, packed, "CustomerID", k), k)
    return by_lists.unionByName(_best_by_signature(stage(owned.join(many, "CustomerID", "left_semi")), hot, partners, packed, k))


def _best_by_signature(owned: DataFrame, hot: DataFrame, partners: DataFrame, packed: _Packed, k: int) -> DataFrame:
    light, hot = _split_hot(owned, "StockCode", hot)
    members, signature_items = _signatures(hot, "CustomerID", "StockCode")
    signature_of = members.select("CustomerID", "Signature")
    hot_scores = stage(
        _item_scores_of(signature_items, partners, packed, "Signature", None).withColumnRenamed("Score", "HotScore")
    )

    # candidates that light products lead to: whatever the hot ones add at most must lift them to the k-th
    bound = signature_of.join(hot_scores.groupBy("Signature").agg(F.max("HotScore").alias("Most")), "Signature")
    facts = (
        bound.select("CustomerID", _entry(F.lit(HOT_BOUND), F.col("Most")).alias("e"))
        .unionByName(hot.select("CustomerID", _entry(F.col("StockCode"), OWNED).alias("e")))
        .groupBy("CustomerID")
        .agg(F.collect_list("e").alias("List"))  # a customer's hot products
    )
    in_full = _item_scores_of(light, partners, packed, "CustomerID", k, stage(facts))
    in_full = (
        in_full.join(signature_of, "CustomerID", "left")
        .join(hot_scores, ["Signature", "StockCode"], "left")
        .select("CustomerID", "StockCode", (F.col("Score") + F.coalesce("HotScore", F.lit(0))).alias("Score"))
    )

    # candidates by hot products alone: the first k that are not owned lie within the first
    # k + (number of owned products) places of the signature's list
    best_first = Window.partitionBy("Signature").orderBy(F.desc("HotScore"), "StockCode")
    hot_list = hot_scores.withColumn("Place", F.row_number().over(best_first).cast("bigint"))
    places = signature_of.join(owned.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("Owned")), "CustomerID").select(
        "CustomerID", "Signature", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("Owned") + k)).alias("Place")
    )
    from_hot = (
        places.join(hot_list, ["Signature", "Place"])
        .join(owned, ["CustomerID", "StockCode"], "left_anti")
        .select("CustomerID", "StockCode", F.col("HotScore").alias("Score"))
    )
    return _merge_best(in_full, from_hot, k)


def _merge_best(in_full: DataFrame, at_least: DataFrame, k: int) -> DataFrame:
    """The k best of two candidate lists, where scores in the second may be too low.

    Each list is cut to its k best first: a candidate cut from the first list has k better ones
    there, so its lower score in the second cannot bring it back.
    """
    both = _best(in_full, k).unionByName(_best(at_least, k))
    merged = both.groupBy("CustomerID", "StockCode").agg(F.max("Score").alias("Score"))
    return _best(merged, k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    """Each customer's k best products; ties go to the smaller code."""
    rank = F.row_number().over(Window.partitionBy("CustomerID").orderBy(F.desc("Score"), "StockCode"))
    return scored.withColumn("Rank", rank).filter(F.col("Rank") <= k)


def _closeness(common: Column, other_size: Column) -> Column:
    """Orders the neighbours of one customer as the cosine does.

    common^2 / size is the same double for equal cosines, while rounding may tell them apart.
    """
    return (common * common) / other_size


def similar_customers(
    tx: DataFrame,
    k: int = 10,
    selected: DataFrame | None = None,
    include_zero: bool = False,
    hot_owners: int = 2_000,
) -> DataFrame:
    """The k customers with the most similar set of products: common / sqrt(products * products).

    Customers without a common product are no neighbours, but with `include_zero` they fill up
    lists shorter than k, by their number. `selected` limits the customers asked for; use it for a
    handful of them. Products in more than `hot_owners` distinct product sets are compared by
    signature, for customers who would otherwise read many owners; the result does not depend on it.
    """
    owned = stage(owned_products(tx))
    if selected is None:
        asked = owned.select("CustomerID").distinct()
        found = _similar_to_all(owned, k, hot_owners)
    else:
        asked = owned.join(selected.select("CustomerID"), "CustomerID", "left_semi").select("CustomerID").distinct()
        found = _similar_to_few(owned, selected, k)
    if include_zero:
        found = _fill_with_customers(stage(found), asked, owned.select("CustomerID").distinct(), k)
    return found


def _fill_with_customers(found: DataFrame, asked: DataFrame, everyone: DataFrame, k: int) -> DataFrame:
    """Fill lists shorter than k with the first customers that are not listed, at similarity 0."""
    listed = found.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("Listed"), F.collect_list("SimilarID").alias("Known")  # k at most
    )
    # fewer than k are known and one is the customer: the first 2k hold all that can be missing
    first = everyone.orderBy("CustomerID").limit(2 * k).agg(F.sort_array(F.collect_list("CustomerID"))).scalar()
    short = asked.join(listed, "CustomerID", "left").filter(F.coalesce("Listed", F.lit(0)) < k)
    known = F.array_append(F.coalesce("Known", F.array().cast("array<bigint>")), F.col("CustomerID"))
    return found.unionByName(
        short.select("CustomerID", "Listed", F.array_except(first, known).alias("Free"))
        .select("CustomerID", "Listed", F.posexplode("Free").alias("Place", "SimilarID"))
        .select(
            "CustomerID",
            (F.coalesce("Listed", F.lit(0)) + F.col("Place") + 1).cast("int").alias("Rank"),
            "SimilarID",
            F.lit(0.0).alias("Similarity"),
        )
        .filter(F.col("Rank") <= k)
    )


def _read_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """For each key and part its entries, merged: Other, the sum of Value, and whatever else belongs to Other.

    Rows are (key, Part, List), where those of one key and part follow one another. What is held is merged every
    million entries, so that memory follows the distinct others.
    """

    def merged(pieces: list[np.ndarray]) -> np.ndarray:
        met = np.concatenate(pieces, axis=1)
        others, first, inverse = np.unique(met[0], return_index=True, return_inverse=True)
        sums = np.bincount(inverse, weights=met[1], minlength=len(others)).astype(np.int64)
        return np.vstack([others, sums, met[2:, first]])

    now: tuple | None = None
    pieces: list[np.ndarray] = []
    held = 0
    for batch in batches:
        keys, parts = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(keys):
            continue
        flat = batch.column(2).flatten()
        entries = np.vstack([np.asarray(flat.field(i)) for i in range(flat.type.num_fields)])
        ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column(2).value_lengths()))])
        starts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0)) + 1
        for i, j in pairwise([0, *starts.tolist(), len(keys)]):
            if (group := (int(keys[i]), int(parts[i]))) != now:
                if now is not None:
                    yield now[0], merged(pieces)
                now, pieces, held = group, [], 0
            pieces.append(entries[:, ends[i] : ends[j]])
            held += ends[j] - ends[i]
            if held > 1_000_000:
                pieces, held = [merged(pieces)], 0
    if now is not None:
        yield now[0], merged(pieces)


def _from_lists(probes: DataFrame, key: str, names: list[str], choose: Callable[[int, np.ndarray], list]) -> DataFrame:
    """The columns that `choose` makes of the merged entries of each key and part, after the key."""
    schema = ", ".join(f"{c} bigint" for c in [key, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []

        def table() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([d[i] for d in done]), pa.int64()) for i in range(len(names) + 1)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[key, *names])

        rows = 0
        for x, entries in _read_lists(batches):
            chosen = choose(x, entries)
            done.append([np.full(len(chosen[0]), x), *chosen])
            rows += len(chosen[0])
            if rows > 100_000:
                yield table()
                rows = 0
        if done:
            yield table()

    ordered = probes.select(key, "Part", "List").repartition(key, "Part").sortWithinPartitions(key, "Part")
    return ordered.mapInArrow(run, schema)


class _Packed(NamedTuple):
    """Lists in bytes: (StockCode, Entries, List), and the names and bytes of an entry's fields, of which Other is the last."""

    lists: DataFrame
    fields: list[str]
    widths: list[int]


def _pack(lists: DataFrame, entries: DataFrame) -> _Packed:
    """Lists (StockCode, List) with each field in as many bytes as its largest value in `entries` needs, little end first.

    `entries` has a column for each field; Other comes last in an entry, so that entries read as numbers are in its order.
    """
    fields = [c for c in entries.columns if c != "Other"] + ["Other"]
    edges = entries.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in fields for f in (F.min, F.max)]).first()
    widths = [
        8 if (edges[f"min_{c}"] or 0) < 0 else max(1, -(-int(edges[f"max_{c}"] or 0).bit_length() // 8)) for c in fields
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # lists of LIST entries at most: few enough for one binary column
            for at in range(0, batch.num_rows, 1000):
                codes, listed = batch.column(0)[at : at + 1000], batch.column(1)[at : at + 1000]
                flat = listed.flatten()
                parts = [
                    np.ascontiguousarray(flat.field(c), "<i8").view(np.uint8).reshape(-1, 8)[:, :w]
                    for c, w in zip(fields, widths, strict=True)
                ]
                counts = np.asarray(listed.value_lengths()).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(counts)]) * sum(widths)
                buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.hstack(parts).tobytes())]
                packed = pa.Array.from_buffers(pa.binary(), len(counts), buffers)
                yield pa.RecordBatch.from_arrays([codes, pa.array(counts), packed], names=["StockCode", "Entries", "List"])

    packed = lists.select("StockCode", F.col("List").cast("array<struct<" + ",".join(f"{c}:bigint" for c in _fields(lists)) + ">>"))
    return _Packed(stage(packed.mapInArrow(run, "StockCode bigint, Entries bigint, List binary")), fields, widths)


def _fields(lists: DataFrame) -> list[str]:
    return lists.schema["List"].dataType.elementType.names


def _lengths(lists: DataFrame) -> DataFrame:
    return lists.groupBy("StockCode").agg(F.sum("Entries").alias("Entries"))


def _weighs(weight: Column | int, other: Column | int = 0, value: Column | int = 0) -> list[Column]:
    """What the values of an item's list count, and an entry of the key's own; one of value 0 is none."""
    columns = [c if isinstance(c, Column) else F.lit(c) for c in (weight, other, value)]
    return [c.cast("bigint").alias(name) for c, name in zip(columns, ("Weight", "Other", "Value"), strict=True)]


def _blocks(met: DataFrame, key: str, at_block: int) -> DataFrame:
    """(key, Block): neighbouring keys in blocks that take the room of about `at_block` entries, by running sums within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sums = before + np.cumsum(np.asarray(batch.column(1)))
            if len(sums):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(task + (sums - 1) // at_block)], names=[key, "Block"])
                before = int(sums[-1])

    ordered = met.select(key, "Room").repartitionByRange(key).sortWithinPartitions(key)
    return ordered.mapInArrow(run, f"{key} bigint, Block bigint")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _merged_entries(
    held: pa.Table, sent: pa.Table, fields: list[str], widths: list[int]
) -> Iterator[tuple[int, np.ndarray]]:
    """For each key of a block its entries, merged as by `_read_lists`.

    `held` has (key, Item, Reads, Weight, Other, Value), `sent` the lists of all items (Sent, List). About AT_ONCE
    entries are merged at once.
    """
    size, wide = sum(widths), 8 * (sum(widths) - widths[-1])
    shifts = np.concatenate([[0], np.cumsum(widths)]) * 8
    listed = sent.column("List").combine_chunks()
    listed = listed if isinstance(listed, pa.Array) else listed.chunk(0)
    ends = np.frombuffer(listed.buffers()[1], np.int32)[listed.offset : listed.offset + len(listed) + 1].astype(np.int64)
    raw = np.frombuffer(listed.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, size)
    firsts, lengths = (ends[:-1] - ends[0]) // size, np.diff(ends) // size
    codes = None
    if size <= 8:
        codes = np.zeros((len(raw), 8), np.uint8)
        codes[:, :size] = raw
        codes = codes.view("<u8").ravel()

    by_item = np.argsort(np.asarray(sent.column("Sent")), kind="stable")
    items = np.asarray(sent.column("Sent"))[by_item]
    order = np.argsort(np.asarray(held.column(0)), kind="stable")
    keys, item, reads, weight, other, value = (np.asarray(held.column(i))[order] for i in range(6))
    low = np.searchsorted(items, item, "left")
    count = np.where(reads, np.searchsorted(items, item, "right") - low, 0)
    list_of = by_item[_ranges(low, count)]
    # where the lists of a held row begin, and how many entries its lists have
    first_list = np.cumsum(count) - count
    entries_before = np.concatenate([[0], np.cumsum(lengths[list_of])])
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    stops = np.append(begin[1:], len(keys))
    read_until = entries_before[(first_list + count)[stops - 1]]
    read_from = entries_before[first_list[begin]]
    turn = read_from // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(begin)]
    plain = bool((weight[reads] == 1).all())

    for a, b in pairwise(cuts):
        rows = slice(begin[a], stops[b - 1])
        lists = list_of[first_list[rows.start] : first_list[rows.stop - 1] + count[rows.stop - 1]]
        n = lengths[lists]
        at = _ranges(firsts[lists], n)
        who = np.repeat(np.arange(a, b) - a, read_until[a:b] - read_from[a:b])
        room = 8 * size + int(b - a).bit_length()
        if plain and room <= 63:
            both = np.sort((who.astype(np.uint64) << np.uint64(8 * size)) | codes[at])
            group = both >> np.uint64(wide)
            new = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
            cells = [
                ((both >> np.uint64(s)) & np.uint64((1 << 8 * w) - 1)).astype(np.int64)
                for s, w in zip(shifts, widths, strict=False)
            ]
            who = (both >> np.uint64(8 * size)).astype(np.int64)
            counts = cells[fields.index("Value")] if "Value" in fields else None
        else:
            whole, cells = raw[at], []
            for s, w in zip(shifts // 8, widths, strict=False):
                cell = np.zeros((len(whole), 8), np.uint8)
                cell[:, :w] = whole[:, s : s + w]
                cells.append(cell.view("<i8").ravel())
            counts = np.repeat(np.repeat(weight[rows], count[rows]), n)
            if "Value" in fields:
                counts = counts * cells[fields.index("Value")]
            sorted_ = np.lexsort((cells[-1], who))
            who, counts, cells = who[sorted_], counts[sorted_], [c[sorted_] for c in cells]
            new = np.flatnonzero(np.append(True, (np.diff(who) != 0) | (np.diff(cells[-1]) != 0))[: len(who)])
        sums = np.diff(np.append(new, len(who))) if counts is None else np.add.reduceat(counts, new) if len(new) else counts
        who = who[new]
        facts = [c[new] for c, f in zip(cells, fields, strict=True) if f not in ("Value", "Other")]
        merged = np.vstack([cells[-1][new], sums, *facts])
        own = np.flatnonzero(value[rows] != 0)
        if len(own):
            # entries of the keys' own are added to the sum of the same other, or follow the key's other entries
            whose = np.repeat(np.arange(a, b) - a, stops[a:b] - begin[a:b])[own]
            others, values = other[rows][own], value[rows][own]
            span = max(int(merged[0].max(initial=0)), int(others.max())) + 2
            there = np.append(who * span + merged[0] + 1, np.iinfo(np.int64).max)
            spot = np.searchsorted(there, whose * span + others + 1)
            met = there[spot] == whose * span + others + 1
            np.add.at(merged[1], spot[met], values[met])
            after = np.searchsorted(who, whose[~met], "right")
            merged = np.insert(merged, after, np.vstack([others, values])[:, ~met], axis=1)
            who = np.insert(who, after, whose[~met])
        places = np.searchsorted(who, np.arange(b - a + 1))
        for x in range(b - a):
            if places[x] < places[x + 1]:
                yield int(keys[begin[a + x]]), merged[:, places[x] : places[x + 1]]


def _from_blocks(
    held: DataFrame, packed: _Packed, key: str, names: list[str], choose: Callable[[int, np.ndarray], list], wide: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """As `_from_lists`, with each list sent once to a block of keys, and not to each key that reads it.

    `held` has (key, Item, Reads, Weight, Other, Value). Keys that meet more than OWNERS_AT_ONCE entries are read
    in parts, by what `wide` makes of a table of such keys.
    """
    spark = held.sparkSession
    lengths = _lengths(packed.lists).select(F.col("StockCode").alias("Item"), "Entries")
    reading = held.filter("Reads").join(lengths, "Item").groupBy(key).agg(F.sum("Entries").alias("Met"), F.count(F.lit(1)).alias("Rows"))
    own = held.filter("NOT Reads").groupBy(key).agg(F.count(F.lit(1)).alias("Own"))
    rows = F.col("Rows") + F.coalesce("Own", F.lit(0).cast("bigint"))
    met = stage(reading.join(own, key, "left").select(key, "Met", F.greatest("Met", ROW * rows).alias("Room")))
    narrow = F.col("Met") <= OWNERS_AT_ONCE
    sizes = met.agg(F.sum(F.when(narrow, F.col("Room"))).alias("All"), F.max("Met").alias("Most")).first()
    at_block = min(BLOCK, max(FEW, (sizes["All"] or 0) // (2 * spark.sparkContext.defaultParallelism)))
    placed = stage(_blocks(met.filter(narrow), key, at_block))
    blocks = max(1, placed.select("Block").distinct().count())
    mine = held.join(placed, key)
    needed = mine.filter("Reads").select("Block", "Item").distinct()
    lists = packed.lists.select(F.col("StockCode").alias("Item"), "List")
    longest = lengths.agg(F.max("Entries")).first()[0] or 0
    if longest * blocks > 100 * LIST:
        sent = spread_join(stage(needed), lists, "Item", 64)
    else:
        sent = needed.join(lists, "Item")

    fields, widths = packed.fields, packed.widths

    def run(held_rows: pa.Table, sent_rows: pa.Table) -> pa.Table:
        columns = [held_rows.column(c) for c in (key, "Item", "Reads", "Weight", "Other", "Value")]
        done: list[list] = [[np.empty(0, np.int64)] * (len(names) + 1)]
        if held_rows.num_rows and sent_rows.num_rows:
            for x, entries in _merged_entries(pa.table(columns, [key, "Item", "Reads", "Weight", "Other", "Value"]), sent_rows, fields, widths):
                chosen = choose(x, entries)
                done.append([np.full(len(chosen[0]), x), *chosen])
        return pa.table([pa.array(np.concatenate([d[i] for d in done]), pa.int64()) for i in range(len(names) + 1)], [key, *names])

    schema = ", ".join(f"{c} bigint" for c in [key, *names])
    going = sent.select(F.col("Block").alias("To"), F.col("Item").alias("Sent"), "List").repartition(blocks, "To")
    found = (
        mine.repartition(blocks, "Block")
        .groupBy("Block")
        .cogroup(going.groupBy("To"))
        .applyInArrow(run, schema)
    )
    if (sizes["Most"] or 0) > OWNERS_AT_ONCE:
        found = found.unionByName(wide(met.filter(~narrow).select(key)).select(key, *names))
    return found


def _choose_overlaps(k: int, hot: bool, among: bool) -> Callable[[int, np.ndarray], list]:
    """(Other, Common, OtherSize): the best of those met most often in the lists that a key reads.

    An entry is (Other, Value, Size, Hot) with a Value of one. Without `hot`, exactly the k first by closeness and
    number are returned; with it, all that could be among them if every hot product of the smaller holder were shared.
    Keys that are `among` the others are not compared with themselves.
    """

    def choose(x: int, entries: np.ndarray) -> list:
        hot_items = 0
        if among:
            itself = entries[0] == x
            hot_items = int(entries[3][itself][0]) if hot else 0
            entries = entries[:, ~itself]
        others, common, size = entries[:3]
        sure = common * common / size
        if hot:
            enough = np.partition(sure, -k)[-k] if len(sure) > k else 0.0
            possible = common + np.minimum(entries[3], hot_items)
            chosen = np.flatnonzero(possible * possible / size >= enough)
        else:
            chosen = _first(sure, others, k)
        return [others[chosen], common[chosen], size[chosen]]

    return choose


def _best_overlaps(probes: DataFrame, key: str, k: int, hot: bool, among: bool) -> DataFrame:
    """(key, Other, Common, OtherSize) as `_choose_overlaps` says.

    Counting is done in numpy, so that the pairs behind the lists never become rows.
    """
    return _from_lists(probes, key, ["Other", "Common", "OtherSize"], _choose_overlaps(k, hot, among))


def _best_of_owners(sets: DataFrame, facts: DataFrame, items: DataFrame, k: int, hot: bool) -> DataFrame:
    """As `_best_overlaps`, for the profiles of a table of (Profile, StockCode): `items` has the owners of their products."""
    names = ["Size", "Hot"] if hot else ["Size"]
    owners = items.join(facts, "Profile").select("StockCode", F.col("Profile").alias("Other"), *names)
    packed = _pack(_lists(owners, "StockCode", F.col("Other"), *names), facts.select(F.col("Profile").alias("Other"), *names))
    held = sets.select("Profile", F.col("StockCode").alias("Item"), F.lit(True).alias("Reads"), *_weighs(1))

    def wide(keys: DataFrame) -> DataFrame:
        asking = sets.join(keys, "Profile", "left_semi")
        return _best_overlaps(_in_parts(asking, stage(_owner_lists(items, facts)), "Profile", OWNERS_AT_ONCE, among=True), "Profile", k, hot, True)

    return _from_blocks(held, packed, "Profile", ["Other", "Common", "OtherSize"], _choose_overlaps(k, hot, among=True), wide)


def _in_parts(reading: DataFrame, lists: DataFrame, key: str, at_once: int, among: bool = False) -> DataFrame:
    """(key, Part, List): every list that a key reads, by StockCode, with keys that meet very many others in parts.

    A part has the entries whose Other falls to it and, where keys are `among` the others, that of the key itself.
    """
    lengths = lists.groupBy("StockCode").agg(F.sum(F.size("List")).alias("Entries"))
    met = reading.join(lengths, "StockCode").groupBy(key).agg(F.sum("Entries").alias("Met"))
    wide = met.filter(F.col("Met") > at_once).select(key, F.ceil(F.col("Met") / at_once).alias("Parts"))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("Parts", F.lit(1).cast("bigint")) - 1))

    def falls(o: Column) -> Column:
        here = F.pmod(F.xxhash64(o["Other"]), F.col("Parts")) == F.col("Part")
        return here | (o["Other"] == F.col(key)) if among else here

    own = F.when(F.col("Parts").isNull(), F.col("List")).otherwise(F.filter("List", falls))
    probes = spread_join(reading.select(key, "StockCode"), lists.select("StockCode", "List"), "StockCode")
    return probes.join(wide, key, "left").select(key, "Parts", "List", each.alias("Part")).select(key, "Part", own.alias("List"))


def _owner_lists(items: DataFrame, facts: DataFrame) -> DataFrame:
    return (
        items.join(facts, "Profile")
        .groupBy("StockCode")
        .agg(F.collect_list(F.struct(F.col("Profile").alias("Other"), F.lit(1).cast("bigint").alias("Value"), "Size", "Hot")).alias("List"))
    )


def light_probes(light: DataFrame, facts: DataFrame, at_once: int = OWNERS_AT_ONCE) -> DataFrame:
    """(Profile, Part, List): the owners of every light product of every profile, with their sizes and hot products.

    A list has at most as many owners as a light product may have.
    """
    return _in_parts(light, stage(_owner_lists(light, facts)), "Profile", at_once, among=True)


def _best_by_hot_products(asked: DataFrame, hot_sets: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(S, Other, OtherSize, Common): for each signature asked for, the k closest classes by hot products alone.

    `asked` has (S, Floor), the closeness that a class must reach; `classes` has (T, Other, Size). The lists of hot
    products are read by bands of sizes, small ones first: a class of size n comes to |S|^2 / n at most, so
    that a signature leaves once its k-th best is above that for all larger bands. A band's lists are divided by
    the class, so that no list and no task holds a band.
    """
    banded = stage(classes.withColumn("Band", F.floor(F.log2("Size")).cast("int")))
    bands = banded.groupBy("Band").agg(F.count(F.lit(1)).alias("n")).orderBy("Band").collect()  # 64 at most
    sizes = hot_sets.groupBy("Signature").agg(F.count(F.lit(1)).alias("Items"))
    still = stage(asked.join(sizes.withColumnRenamed("Signature", "S"), "S"))
    found = None
    for band in bands:
        parts = -(-band["n"] // LIST)
        least = 1 << band["Band"]
        open_ = still.filter(F.col("Items") * F.col("Items") / F.lit(float(least)) >= F.col("Floor")).select("S")
        lists = (
            banded.filter(F.col("Band") == band["Band"])
            .withColumn("Part", F.pmod(F.xxhash64("Other"), F.lit(parts)))
            .join(hot_sets.withColumnRenamed("Signature", "T"), "T")
            .groupBy("StockCode", "Part")
            .agg(F.collect_list(F.struct("Other", F.lit(1).cast("bigint").alias("Value"), "Size", F.lit(0).cast("bigint").alias("Hot"))).alias("List"))
        )
        asking = hot_sets.withColumnRenamed("Signature", "S").join(open_, "S", "left_semi").select("S", "StockCode")
        read = _best_overlaps(spread_join(asking, stage(lists), "StockCode"), "S", k, hot=False, among=False)
        place = F.row_number().over(
            Window.partitionBy("S").orderBy(F.desc(_closeness(F.col("Common"), F.col("OtherSize"))), "Other")
        )
        merged = read if found is None else read.unionByName(found)
        found = stage(merged.withColumn("Place", place).filter(F.col("Place") <= k).drop("Place"))
        if band is not bands[-1]:
            reached = (
                found.groupBy("S")
                .agg(F.count(F.lit(1)).alias("n"), F.min(_closeness(F.col("Common"), F.col("OtherSize"))).alias("Least"))
                .filter(F.col("n") == k)
            )
            still = stage(
                still.join(reached, "S", "left").select("S", "Items", F.greatest("Floor", F.coalesce("Least", F.lit(0.0))).alias("Floor"))
            )
    return found


def _similar_to_all(owned: DataFrame, k: int, hot_owners: int) -> DataFrame:
    owned = stage(_by_number(owned, numbered_products(owned), "CustomerID"))
    # customers with equal sets form one profile; its first k + 1 members can stand for all
    members, sets = _signatures(owned, "CustomerID", "StockCode")
    profiles = members.withColumnRenamed("Signature", "Profile")
    sets = stage(sets.withColumnRenamed("Signature", "Profile"))
    by_id = F.row_number().over(Window.partitionBy("Profile").orderBy("CustomerID"))
    standing = profiles.withColumn("Place", by_id).filter(F.col("Place") <= k + 1).drop("Place")
    other = [F.col("CustomerID").alias("OtherID"), F.col("Size").alias("OtherSize")]
    closest = [F.desc(_closeness(F.col("Common"), F.col("OtherSize"))), F.asc("OtherID")]

    def nearest(candidates: DataFrame, to: str) -> DataFrame:
        # k + 1, because a member may not be its own neighbour
        place = F.row_number().over(Window.partitionBy(to).orderBy(*closest))
        return candidates.withColumn("Place", place).filter(F.col("Place") <= k + 1)

    first = stage(profiles.filter(F.col("CustomerID") == F.col("Profile")).select("Profile", "Size"))
    hot = _hot_items(sets, "StockCode", hot_owners)
    owners = sets.groupBy("StockCode").agg(F.count(F.lit(1)).alias("Entries"))
    many = None if hot is None else _reads_many(sets, hot, stage(owners), "Profile")
    few = sets if many is None else stage(sets.join(many, "Profile", "left_anti").select(*sets.columns))
    # a profile's first member has its number, so k + 1 profiles hold the k + 1 closest customers
    pair = [F.col("Profile").alias("P"), F.col("Other").alias("Q"), F.col("Common")]
    asked = few.select("StockCode").distinct()
    items = sets if many is None else stage(sets.join(asked, "StockCode", "left_semi").select(*sets.columns))
    met = _best_of_owners(few, first.withColumn("Hot", F.lit(0).cast("bigint")), items, k + 1, hot=False).select(*pair)

    if many is not None:
        light, hot = _split_hot(sets, "StockCode", hot)
        hot_items = hot.groupBy("Profile").agg(F.count(F.lit(1)).alias("Hot"))
        facts = stage(first.join(hot_items, "Profile", "left").fillna(0, ["Hot"]))
        asking = stage(light.join(many, "Profile", "left_semi").select(*light.columns))
        by_light = _best_of_owners(asking, facts, light, k + 1, hot=True).select(*pair)
        # what two profiles share of the hot products depends on their signatures only
        hot_members, hot_sets = _signatures(hot, "Profile", "StockCode")
        hot_sets = stage(hot_sets)
        signature_of = hot_members.select("Profile", "Signature")
        met = met.unionByName(_add_hot_common(stage(by_light), signature_of, hot_sets))

    # a profile's members are each other's nearest; every profile is spelled out by its first members
    itself = first.select(F.col("Profile").alias("P"), F.col("Profile").alias("Q"), F.col("Size").alias("Common"))
    in_full = (
        met.unionByName(itself)
        .join(standing.select(F.col("Profile").alias("Q"), *other), "Q")
        .select("P", "OtherID", "OtherSize", "Common")
    )
    best = nearest(in_full, "P")

    if many is not None:
        best = stage(best)
        # candidates by hot products alone are at most as close as the number of hot products owned:
        # whoever has k + 1 closer ones already needs none of them
        worst = best.filter(F.col("Place") == k + 1).select(
            F.col("P").alias("Profile"), _closeness(F.col("Common"), F.col("OtherSize")).alias("Worst")
        )
        still_open = stage(
            hot_members.join(many, "Profile", "left_semi")
            .join(worst, "Profile", "left")
            .filter(F.col("Worst").isNull() | (F.col("Size") >= F.col("Worst")))
            .select(F.col("Profile").alias("P"), F.col("Signature").alias("S"), F.coalesce("Worst", F.lit(0.0)).alias("Floor"))
        )
        # the first members of each (signature, size) class stand for the class, which has the number of the first
        in_class = Window.partitionBy("Signature", "Size").orderBy("CustomerID")
        class_members = stage(
            standing.join(signature_of, "Profile")
            .withColumn("Place", F.row_number().over(in_class))
            .filter(F.col("Place") <= k + 1)
            .withColumn("Other", F.min("CustomerID").over(Window.partitionBy("Signature", "Size")))
            .select(F.col("Signature").alias("T"), "Other", "Size", "CustomerID")
        )
        classes = class_members.filter(F.col("CustomerID") == F.col("Other")).select("T", "Other", "Size")
        floors = still_open.groupBy("S").agg(F.min("Floor").alias("Floor"))
        by_hot = _best_by_hot_products(floors, hot_sets, classes, k + 1)
        hot_list = nearest(
            by_hot.join(class_members.select("Other", F.col("CustomerID").alias("OtherID")), "Other").drop("Other"), "S"
        ).drop("Place")
        from_hot = still_open.select("P", "S").join(hot_list, "S").select("P", "OtherID", "OtherSize", "Common")
        # both lists are cut before they are merged, as in _merge_best
        merged = (
            best.drop("Place")
            .unionByName(from_hot)
            .groupBy("P", "OtherID", "OtherSize")
            .agg(F.max("Common").alias("Common"))
        )
        best = nearest(merged, "P")

    lists = best.groupBy("P").agg(
        F.sort_array(F.collect_list(F.struct("Place", "OtherID", "OtherSize", "Common"))).alias("List")  # k + 1
    )
    others = F.slice(F.filter("List", lambda o: o["OtherID"] != F.col("CustomerID")), 1, k)
    return (
        profiles.join(lists, profiles.Profile == lists.P)
        .select("CustomerID", "Size", F.posexplode(others).alias("Rank", "o"))
        .select(
            "CustomerID",
            (F.col("Rank") + 1).alias("Rank"),
            F.col("o.OtherID").alias("SimilarID"),
            (F.col("o.Common") / F.sqrt(F.col("Size").cast("double") * F.col("o.OtherSize"))).alias("Similarity"),
        )
    )


def _add_hot_common(halves: DataFrame, signature_of: DataFrame, hot_sets: DataFrame) -> DataFrame:
    """Add to Common of (P, Q) what their signatures share, computed once per pair of signatures."""
    signed = stage(halves.join(signature_of.toDF("P", "S"), "P", "left").join(signature_of.toDF("Q", "T"), "Q", "left"))
    wanted = signed.filter(F.col("S").isNotNull() & F.col("T").isNotNull()).select("S", "T").distinct()
    shared = (
        spread_join(wanted, hot_sets.select(F.col("Signature").alias("S"), "StockCode"), "S")
        .join(hot_sets.select(F.col("Signature").alias("T"), "StockCode"), ["T", "StockCode"])
        .groupBy("S", "T")
        .agg(F.count(F.lit(1)).alias("HotCommon"))
    )
    return signed.join(shared, ["S", "T"], "left").select(
        "P", "Q", (F.col("Common") + F.coalesce("HotCommon", F.lit(0))).alias("Common")
    )


def _similar_to_few(owned: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """Neighbours of a few customers: one pass over all purchases, no comparison among the others."""
    sizes = owned.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("Size"))
    asked = owned.join(selected.select("CustomerID"), "CustomerID", "left_semi")
    common = (
        spread_join(asked, owned.withColumnRenamed("CustomerID", "SimilarID"), "StockCode")
        .filter(F.col("CustomerID") != F.col("SimilarID"))
        .groupBy("CustomerID", "SimilarID")
        .agg(F.count(F.lit(1)).alias("Common"))
    )
    closest = Window.partitionBy("CustomerID").orderBy(
        F.desc(_closeness(F.col("Common"), F.col("OtherSize"))), "SimilarID"
    )
    return (
        common.join(sizes.toDF("SimilarID", "OtherSize"), "SimilarID")
        .withColumn("Rank", F.row_number().over(closest))
        .filter(F.col("Rank") <= k)
        .join(sizes, "CustomerID")
        .select(
            "CustomerID",
            "Rank",
            "SimilarID",
            (F.col("Common") / F.sqrt(F.col("Size").cast("double") * F.col("OtherSize"))).alias("Similarity"),
        )
    )


# Similarities are added as whole multiples of this step, so that sums do not depend on the order of rows.
SCORE_STEP = 1e-12


def user_recommendations(tx: DataFrame, neighbours: DataFrame, k: int = 10) -> DataFrame:
    """The k products that each customer's neighbours own and the customer does not, by summed similarity."""
    owned = stage(owned_products(tx))
    numbers = numbered_products(owned)
    owned = stage(_by_number(owned, numbers, "CustomerID"))
    weight = F.round(F.col("Similarity") / SCORE_STEP).cast("bigint")
    asked = stage(neighbours.select("CustomerID", F.col("SimilarID").alias("Other"), weight.alias("Weight")))
    products = owned.select("CustomerID", F.col("StockCode").alias("Other"))
    lists = _lists(products, "CustomerID", F.col("Other"))
    packed = _pack(lists, products.select("Other"))
    # an owned product never becomes a recommendation, whatever the weights
    taken = -(1 << 62)
    held = (
        asked.select("CustomerID", F.col("Other").alias("Item"), F.lit(True).alias("Reads"), *_weighs(F.col("Weight")))
        .unionByName(owned.select("CustomerID", F.lit(-1).cast("bigint").alias("Item"), F.lit(False).alias("Reads"), *_weighs(0, F.col("StockCode"), taken)))
    )

    def choose(_: int, entries: np.ndarray) -> list:
        products, weights = entries
        free = weights > taken // 2
        products, weights = products[free], weights[free]
        chosen = _first(weights, products, k)
        return [products[chosen], weights[chosen]]

    def wide(keys: DataFrame) -> DataFrame:
        theirs = owned.select(F.col("CustomerID").alias("Other"), "StockCode")
        return (
            spread_join(asked.join(keys, "CustomerID", "left_semi"), theirs, "Other")
            .groupBy("CustomerID", "StockCode")
            .agg(F.sum("Weight").alias("Weight"))
            .join(owned, ["CustomerID", "StockCode"], "left_anti")
            .withColumnRenamed("StockCode", "Number")
        )

    scored = _from_blocks(held, packed, "CustomerID", ["Number", "Weight"], choose, wide)
    named = numbers.withColumnRenamed("Number", "Of")
    return _best(
        scored.join(named, F.col("Number") == F.col("Of")).select("CustomerID", "StockCode", (F.col("Weight") * SCORE_STEP).alias("Score")), k
    )
