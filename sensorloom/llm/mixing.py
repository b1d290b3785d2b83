"""Mixing sources to target weights by hierarchical budgets.

Leaves are the values of the ``TREE`` columns (domain, language, source). A total of tokens is split
down the tree: at each node the children share the node's budget by weight, none gets more than its
leaves hold over ``max_epochs``, and what a short child can't use goes to its siblings by weight. A node
never gets more than its subtree can hold, so a shortage is settled among siblings before an ancestor's
other children see it. The share is the water level of a node's children, found in closed form with
running sums over the children ordered by capacity per weight.

Each leaf then takes whole epochs of its documents and, of the last epoch, the longest prefix of tokens
that fits its budget, in an order seeded by seed and epoch. The order's hash is cut into ranges of about
``BUCKET_ROWS`` rows; the ranges' totals give each range its base, so no leaf is ever one task's work.

Rows repeated whole are one document with a number of copies: they share their place and are taken or left
together, however many they are. Domains are the caller's: a mapping from source to domain.

Native: DataFrame functions only. Defined results: null and empty texts have no tokens and follow their
place in the order, so they are taken as often as the documents round them, never over ``max_epochs``; a
leaf without tokens takes nothing; null tree values are a value of their own; sources without a domain
are in "other"; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, table

TREE = ("domain", "lang", "source")
SEED = 17
MAX_EPOCHS = 2
#: The total budget as a share of the tokens there are.
BUDGET_SHARE = 0.6
BUCKET_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"
#: The domain of each source of the training corpus, data that come with it; unnamed ones are in "other".
DOMAINS = {f"src{i}": "web" if i < 12 else "books" for i in range(20)}
#: Weights by value at each level; what isn't named weighs 1. A mix that leans on the web two to one,
#: with English held to twice any other language.
WEIGHTS = {"domain": {"web": 2.0, "books": 1.0}, "lang": {"en": 2.0}, "source": {}}


def domain_of(source: Column, domains: dict[str, str]) -> Column:
    if not domains:
        return F.lit("other")
    known = F.create_map(*[F.lit(x) for pair in domains.items() for x in pair])
    return F.coalesce(F.element_at(known, source), F.lit("other"))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, total: int, tree: tuple[str, ...] = TREE, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (tree columns, tokens, rows) with ``budget`` tokens, ``total`` together or all there are.

    A window holds the children of one node, a row each.
    """
    out = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    there = out.agg(F.sum("cap")).first()[0] or 0.0
    out = out.withColumn("budget", F.lit(min(float(total), there)))
    for depth, level in enumerate(tree):
        above, own = [*tree[:depth]], [*tree[: depth + 1]]
        child = out.groupBy(*own).agg(F.sum("cap").alias("c"), F.first("budget").alias("node"))
        child = child.withColumn("w", _weight(level, weights)).withColumn("ratio", F.col("c") / F.col("w"))
        parent = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))  # the root's children
        order = parent.orderBy("ratio", *own)
        child = child.withColumns({
            "c_before": F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "w_from": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        })
        full = F.col("c_before") + F.col("ratio") * F.col("w_from") <= F.col("node")
        # the level at the first child that isn't full holds for all after it
        level_at = F.when(~full, (F.col("node") - F.col("c_before")) / F.col("w_from"))
        child = child.withColumn("full", full).withColumn("water", F.first(level_at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        child = child.withColumn("share", F.when(F.col("full"), F.col("c")).otherwise(F.col("water") * F.col("w")))
        share = child.select(*[F.col(c).alias(f"_{c}") for c in own], "share")
        same = F.lit(True)
        for c in own:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(share, same).drop("budget", *[f"_{c}" for c in own]).withColumnRenamed("share", "budget")
    return out.drop("cap").withColumn("budget", F.floor("budget").cast("long"))


def select(rows: DataFrame, plan: DataFrame, tree: tuple[str, ...] = TREE, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``rows`` (doc_id, text_hash, tree columns, tokens, copies; no two alike) with ``epochs``, how often each is taken (0: not at all).

    A leaf of ``tokens`` and a budget takes floor(budget / tokens) whole epochs; the epoch after them is cut.
    """
    t, leaf = {f"{c}": f"_{c}" for c in tree}, [*tree]
    plan = plan.select(*[F.col(c).alias(t[c]) for c in tree], F.col("tokens").alias("leaf_tokens"), "budget", F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).alias("n_ranges"))
    same = F.lit(True)
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(t[c]))
    whole = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("budget") / F.col("leaf_tokens"))).otherwise(0).cast("int")
    keyed = rows.join(plan, same).drop(*t.values()).withColumns({"whole": whole, "rest": F.col("budget") - whole * F.col("leaf_tokens")})
    keyed = keyed.withColumn("place", F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id"), F.col("text_hash")))
    # 2^63 in steps of the range's width
    keyed = keyed.withColumn("range", F.floor((F.shiftright("place", 1) + F.lit(1 << 62)) / (F.lit(float(1 << 63)) / F.col("n_ranges"))).cast("int"))
    keyed = materialise(keyed.drop("n_ranges", "leaf_tokens"), "mix-keyed")
    own = F.col("tokens") * F.col("copies")
    sums = keyed.groupBy(*leaf, "range").agg(F.sum(own).alias("in_range"))
    upto = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(sums.select(*[F.col(c).alias(t[c]) for c in tree], F.col("range").alias("_range"), "in_range", F.coalesce(F.sum("in_range").over(upto), F.lit(0)).alias("base")), "mix-ranges")
    placed = keyed.join(base, (F.col("range") == F.col("_range")) & same).drop("_range", *t.values())
    inside = Window.partitionBy(*leaf, "range").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    # only the one range of a leaf that the budget cuts needs its rows in order
    edge = (F.col("base") <= F.col("rest")) & (F.col("base") + F.col("in_range") > F.col("rest"))
    cut = placed.where(edge).withColumn("taken", F.col("base") + F.sum(own).over(inside) <= F.col("rest"))
    # without a rest the last epoch is whole, and nothing comes after it
    clear = placed.where(~edge).withColumn("taken", (F.col("rest") > 0) & (F.col("base") + F.col("in_range") <= F.col("rest")))
    epochs = F.least(F.col("whole") + F.col("taken").cast("int"), F.lit(max_epochs))
    return clear.unionByName(cut).withColumn("epochs", epochs).drop("whole", "rest", "place", "range", "in_range", "base", "taken")


def mix(df: DataFrame, weights: dict = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domains: dict[str, str] = DOMAINS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, domain, lang, source, tokens, copies, epochs) of each document of ``df``; ``copies`` counts its rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), domain_of(F.col(source_col), domains).alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))
    rows = materialise(rows.groupBy("doc_id", "text_hash", *TREE, "tokens").agg(F.count("*").alias("copies")), "mix-rows")
    leaves = rows.groupBy(*TREE).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("rows"))
    leaves = materialise(leaves, "mix-leaves")
    total = math.floor((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share)
    plan = materialise(budgets(leaves, total, TREE, weights, max_epochs), "mix-budgets")
    return select(rows, plan, TREE, seed, max_epochs)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, repeated ones too: doc_id, domain, lang, source, tokens and epochs."""
    taken = mix(table(spark, sf_dir, "documents"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", *TREE, "tokens", "epochs")
