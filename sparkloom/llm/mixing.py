"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A budget in tokens is handed down a tree (domain, language, source). At each
node the children share by weight; a child that can't fill its share (its
documents, times the epochs allowed, are fewer) is filled and its shortage goes
to its siblings. A node's capacity is the sum of its children's, so what a
whole group of siblings can't take is redistributed one level up. A leaf's
quota is met by whole epochs and a token-prefix of one more, each epoch in an
order of its own that the seed decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """White-space separated words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def _shared_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes (parent levels, level, cap, weight, budget of the parent) with the node's own share in `budget`."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # a child is full if its capacity is below the share it gets once those before it (less capacity for their weight) are full
    order = family.orderBy((F.col("cap") / F.col("weight")), level)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumn("spent", F.sum("cap").over(upto) - F.col("cap"))
    nodes = nodes.withColumn("open", F.sum("weight").over(family) - F.sum("weight").over(upto) + F.col("weight"))
    nodes = nodes.withColumn("full", F.col("cap") * F.col("open") <= F.col("weight") * F.greatest(F.col("budget") - F.col("spent"), F.lit(0)))
    # the full ones are a prefix of the order
    nodes = nodes.withColumn("full", F.min(F.col("full").cast("int")).over(upto) == 1)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family)
    open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family)
    nodes = nodes.withColumn("taken", taken).withColumn("open", open_)
    share = F.expr("weight * (budget - taken) div open")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(share, F.lit(0)))).drop("spent", "open", "full", "taken")


def leaf_quotas(sizes: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], num: int, den: int, epochs: int) -> DataFrame:
    """(levels, tokens, quota) from leaves (levels, tokens); the root's budget is num / den of all tokens."""
    leaves = sizes.withColumn("cap", F.col("tokens") * epochs)
    handed = leaves.agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    handed = handed.select(F.least(F.expr(f"tokens * {int(num)} div {int(den)}"), "cap").cast("long").alias("budget"))
    for i, level in enumerate(levels):
        parent = levels[:i]
        nodes = leaves.groupBy(*parent, level).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights.get(level, {})))
        nodes = nodes.join(handed, parent) if parent else nodes.crossJoin(handed)  # the root is one row
        handed = _shared_out(nodes, parent, level).select(*parent, level, "budget")
    return leaves.select(*levels, "tokens").join(handed.withColumnRenamed("budget", "quota"), levels)


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("doc_id").cast("string")))


def mix_sources(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    num: int = 1,
    den: int = 2,
    epochs: int = 2,
    seed: int = 17,
) -> DataFrame:
    """docs (doc_id, text, ...) with the levels' columns, n_tokens and copies: how many times each document is taken.

    The budget is num / den of all tokens; weights (whole numbers, 1 where
    unnamed) are by level and value. In an epoch a leaf's documents come in
    order of md5(seed:epoch:doc_id), and a quota's last, partial epoch takes
    them while their running total stays within it; rows that repeat a doc_id
    are taken together. Null levels count as an empty string; a null doc_id
    is never taken; null and blank texts have no tokens and are taken with the
    prefix that they fall into. Columns of docs that are named like a level,
    n_tokens or copies are replaced.
    """
    names = list(levels)
    spare = f"_{'_'.join(names)}"
    marked = docs.withColumns({f"{spare}{c}": F.coalesce(x.cast("string"), F.lit("")) for c, x in levels.items()})
    marked = marked.drop(*names, "n_tokens", "copies").withColumnsRenamed({f"{spare}{c}": c for c in names})
    marked = marked.withColumn("n_tokens", tokens(F.col("text")))
    rows = written(marked.where("doc_id is not null").select(*names, "doc_id", "n_tokens"), "tokens")
    sizes = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    quotas = leaf_quotas(sizes, names, weights, num, den, epochs).where("quota > 0")
    quotas = quotas.withColumn("whole", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens"))
    # hash digits that deal a leaf into about as many stretches as each has documents
    digits = sizes.select(*names, F.greatest(F.lit(3), F.ceil(F.log(16.0, F.sqrt("documents")))).cast("int").alias("digits"))
    quotas = quotas.join(digits, names)
    quotas = written(quotas, "quotas")

    # where each leaf's prefix ends: totals by stretch of the key, then the one stretch that the rest falls into
    keyed = rows.join(quotas, names).withColumn("key", _key(seed, F.col("whole"))).withColumn("stretch", F.expr("substring(key, 1, digits)"))
    totals = keyed.groupBy(*names, "stretch").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    running = F.sum("n").over(Window.partitionBy(*names).orderBy("stretch"))
    totals = totals.withColumn("upto", running).where("upto - n <= rest")
    cut = totals.groupBy(*names).agg(F.max(F.struct("stretch", (F.col("upto") - F.col("n")).alias("before"))).alias("at"))
    cut = written(cut.select(*names, "at.stretch", "at.before"), "cuts")
    inner = keyed.join(cut, [*names, "stretch"])
    upto = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("key"))
    last = inner.withColumn("upto", F.col("before") + upto).where("upto <= rest").groupBy(*names).agg(F.max("key").alias("key"))
    ends = quotas.join(cut, names, "left").join(last.withColumnRenamed("key", "last"), names, "left")
    # the stretch's own rows up to `last`; without any, all rows before the stretch
    ends = ends.select(*names, "whole", F.coalesce("last", "stretch", F.lit("")).alias("last"))
    ends = written(ends, "ends")  # a row for each leaf; Spark broadcasts it where its size allows
    copies = F.coalesce(F.col("whole") + F.when(_key(seed, F.col("whole")) <= F.col("last"), 1).otherwise(0), F.lit(0))
    return marked.join(ends, names, "left").withColumn("copies", copies.cast("int")).drop("whole", "last")


def domain_of(source: Column) -> Column:
    """The domain that a source belongs to, by a rule: the first digit of its md5."""
    digit = F.substring(F.md5(source), 1, 1)
    return F.when(digit < "6", "web").when(digit < "c", "forum").otherwise("books")


#: Production parameters for documents.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"web": 3, "forum": 2}, "lang": {"en": 5, "de": 2, "fr": 2}}


def document_levels(prefix: str = "") -> dict[str, Column]:
    """The tree's levels for documents; with a prefix, their columns stand beside those of documents."""
    levels = {"domain": domain_of(F.coalesce("source", F.lit(""))), "lang": F.col("lang"), "source": F.col("source")}
    return {f"{prefix}{name}": column for name, column in levels.items()}
