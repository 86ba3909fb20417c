"""Problem 3: items that appear together, and how much more often than chance.

Every basket is deduplicated and sorted, its ordered pairs are emitted as a stream, and Spark combines their counts on
the map side before the shuffle; in pairs, items are numbers. A long basket is cut into blocks, and every pair of blocks is
a row of its own, so that its pairs are spread over tasks; counts of blocks add up. Lift and pointwise mutual information follow from the marginals. Items that cannot be
in a wanted pair are left out before pairs are made; the bound is exact, so no wanted pair is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.tables import one_per_key
from lexshift.workdir import cut

#: Production thresholds of a case: baskets with both, and how many times more than chance.
MIN_BOTH, MIN_LIFT = 5, 10
#: Items of a basket that are paired in one row; longer ones are cut into blocks and the blocks paired, so many pairs of blocks a task.
BLOCK, TASK_BLOCKS = 1000, 16


def item_pairs(df: DataFrame, items: str, min_both: int = MIN_BOTH, min_lift: int = MIN_LIFT, block: int = BLOCK) -> DataFrame:
    """``item_a < item_b, n_ab, n_a, n_b, n, lift, pmi`` of the pairs in the list column ``items``, a row a basket.

    Wanted are pairs with ``n_ab >= min_both`` and ``n_ab * n >= min_lift * n_a * n_b``; 1 and 0 give all pairs. n is
    the number of baskets with at least one item. NULL lists, empty lists and NULL items count nothing, an item counts
    once a basket. A basket of any length is streamed, its pairs are never held together, and beyond ``block`` items they
    are made by several tasks. An item in more than
    ``n / min_lift`` baskets is in no wanted pair, nor is one in fewer than ``min_both``: both stay out of the pairing.
    """
    baskets = cut(df.select(F.array_sort(F.array_distinct(F.array_compact(F.col(f"`{items}`")))).alias("items")).where("size(items) > 0"))
    size = F.when(F.size("items") > block, F.ceil(F.size("items") / block))
    n, blocks = baskets.agg(F.count("*"), F.coalesce(F.sum(size * (size + 1) / 2), F.lit(0))).first()
    single = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    useful = single.where((F.col("n") >= min_both) & (F.col("n") * min_lift <= n))
    numbered = cut(useful.select("item", "n", F.monotonically_increasing_id().alias("num")))  # written, so that a number stays an item's
    keyed = baskets.select(F.monotonically_increasing_id().alias("basket"), "items")  # of written rows, so the same when a task is repeated
    long = keyed.select("basket", F.explode("items").alias("item")).join(numbered.select("item", "num"), "item").select("basket", "num")
    kept = long.groupBy("basket").agg(F.array_sort(F.collect_list("num")).alias("nums")).where("size(nums) > 1").select("nums")
    if not blocks:
        pairs = _within(kept)
    else:
        kept = cut(kept)
        pairs = _within(kept.where(F.size("nums") <= block)).unionByName(_across(kept.where(F.size("nums") > block), block, max(1, min(100_000, int(blocks) // TASK_BLOCKS))))
    both = pairs.groupBy("num_a", "num_b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_both)
    a, b = (numbered.select(F.col("num").alias(f"num_{x}"), F.struct("item", "n").alias(x)) for x in "ab")
    out = both.join(a, "num_a").join(b, "num_b").where(F.col("n_ab") * n >= min_lift * F.col("a.n") * F.col("b.n"))
    out = out.select("n_ab", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))  # in the order of the items
    out = out.select(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"), "n_ab", F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), F.lit(n).cast("bigint").alias("n"))
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))
    return out.withColumn("lift", lift).withColumn("pmi", F.log2(lift))


def _within(lists: DataFrame) -> DataFrame:
    """``num_a, num_b`` of all pairs of each sorted list ``nums``."""
    first = lists.select("nums", F.posexplode("nums").alias("at", "num_a"))
    return first.select("num_a", F.explode(F.slice("nums", F.col("at") + 2, F.size("nums"))).alias("num_b"))


def _across(lists: DataFrame, block: int, tasks: int) -> DataFrame:
    """The same by pairs of blocks of the lists, which are spread over ``tasks``."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("nums") - 1) / block).cast("int")), lambda i: F.slice("nums", i * block + 1, block))
    left = lists.select(parts.alias("parts")).select("parts", F.posexplode("parts").alias("i", "a"))
    both = left.select("i", "a", F.posexplode(F.slice("parts", F.col("i") + 1, F.size("parts"))).alias("d", "b"))
    spread = both.repartition(tasks, F.xxhash64("a", "b"))  # by content, so the same when a task is repeated
    return _within(spread.where("d = 0").select(F.col("a").alias("nums"))).unionByName(spread.where("d > 0").select(F.explode("a").alias("num_a"), "b").select("num_a", F.explode("b").alias("num_b")))


def found(substitutes: DataFrame) -> DataFrame:
    """Pairs of substitutes; repeated mentions count once."""
    mentions = one_per_key(substitutes.select("term", "line_id", "token_index", "top_terms"), "term", "line_id", "token_index")
    return item_pairs(mentions, "top_terms").select(F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b"))
