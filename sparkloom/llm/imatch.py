"""I-Match fingerprints, with DataFrame functions only.

A text's terms are its distinct words within a band of inverse document
frequency over the whole corpus; that lexicon has at most (mean distinct words
of a document) / LOW terms, whatever the corpus. Each of SUBSETS lexicon
subsets keeps a term with a chance of 1/128, decided by a hash of term and
subset; a signature hashes the sorted terms of one subset, and a fingerprint is
the list of all signatures. Two fingerprints are alike by the share of equal
signatures among the subsets in which either text has a term.

These samples leave most of the lexicon in no subset. With whole=True every
term is also in the subset that its CRC-32 names, so the subsets cover the
lexicon, and a text without a term in the band is signed over all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

LOW, HIGH = 0.0005, 0.05  # document frequency, as a share of all documents
SUBSETS = 32
NONE = "."  # the signature of a subset without terms


def terms(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def _home(term: Column) -> Column:
    """The mask of the one subset that a term is always in if the lexicon is covered."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.crc32(term.cast("binary")) % SUBSETS).cast("int"))


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH, whole: bool = False) -> DataFrame:
    """(term, mask) of the words of texts (text) within the band, in two documents and a subset at least; bit r of mask: is it in subset r?"""
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = counts.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n))
    mask = F.lit(0).cast("long")
    for r in range(SUBSETS):
        digits = F.substring(F.md5(F.concat(F.lit(f"{r}:"), F.col("term"))), 1, 2)
        mask = mask + F.when(digits < "02", F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long"))
    if whole:
        mask = mask.bitwiseOR(_home(F.col("term")))
    # the test names df, so that it stays above the counting and isn't made for every word of every text
    return kept.select("term", F.when(F.col("df") > 0, mask).alias("mask")).where("mask <> 0")


def _signatures(found: Column) -> Column:
    """From sorted array<struct<term, mask>>: SUBSETS signatures."""

    def signature(bit: int) -> Column:
        mine = F.transform(F.filter(found, lambda t: t["mask"].bitwiseAND(F.lit(bit).cast("long")) != 0), lambda t: t["term"])
        return F.when(F.size(mine) == 0, F.lit(NONE)).otherwise(F.substring(F.md5(F.array_join(mine, " ")), 1, 8))

    return F.concat_ws("-", *(signature(1 << r) for r in range(SUBSETS)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among the subsets where either fingerprint has terms; 0 where neither has."""
    pairs = F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b"))
    told = F.filter(pairs, lambda p: (p["a"] != NONE) | (p["b"] != NONE))
    same = F.filter(told, lambda p: p["a"] == p["b"])
    return F.when(F.size(told) == 0, F.lit(0.0)).otherwise(F.size(same) / F.size(told))


def _successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) in ascending order, the last followed by the first; ids are distinct.

    Ids are dealt out by range; only the first id of each range meets in one task.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    every = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(every), F.min("first").over(Window.partitionBy())).alias("after"))
    inner = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return dealt.withColumn("inner", inner).join(after, "part").select("doc_id", F.coalesce("inner", "after").alias("next_id"))


def _once(docs: DataFrame) -> DataFrame:
    """The text of each doc_id, the smallest of rows that repeat it.

    Only the ids are shuffled, and the texts of repeated ids: Spark broadcasts
    their table as long as its files are below its own threshold.
    """
    again = written(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    single = docs.join(again, "doc_id", "left_anti").select("text")
    return single.unionAll(docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select("text"))


def document_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, whole: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of docs (doc_id, text).

    The edited text's last floor(n_chars / 2) code points are the first as many
    of the next document's, by ascending doc_id. Null texts are empty; rows
    with a null doc_id are left out; of rows that repeat a doc_id the smallest
    text counts, once, for the lexicon too. A text without a term in the band has the fingerprint
    of empty signatures and is like no other but an equal text; if whole, only
    a text without words has.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = F.broadcast(written(lexicon(_once(docs), low, high, whole), "lexicon"))
    succession = written(_successors(docs.select("doc_id").distinct()), "successors")
    texts = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    mine = texts.join(succession, "doc_id").withColumn("n_chars", F.char_length("text").cast("long"))
    mine = mine.withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    asks = mine.select(F.col("doc_id").alias("to"), F.col("next_id").alias("doc_id"), "half")
    heads = texts.join(asks, "doc_id").select(F.col("to").alias("doc_id"), F.expr("substring(text, 1, half)").alias("head"))
    both = mine.join(heads, "doc_id").select(
        "doc_id", "next_id", "n_chars", "text", F.concat(F.expr("substring(text, 1, int(n_chars) - half)"), "head").alias("edited")
    )
    words = both.select("doc_id", F.posexplode(F.array(terms(F.col("text")), terms(F.col("edited")))).alias("side", "terms"))
    words = words.select("doc_id", "side", F.explode("terms").alias("term")).join(known, "term")
    found = words.groupBy("doc_id").agg(
        *(F.collect_list(F.when(F.col("side") == i, F.struct("term", "mask"))).alias(c) for i, c in enumerate(("own", "other")))
    )

    def rest(text: str) -> Column:
        """What a text without terms in the band is signed over."""
        if not whole:
            return F.array().cast("array<struct<term: string, mask: bigint>>")
        return F.transform(F.sort_array(terms(F.col(text))), lambda t: F.struct(t.alias("term"), _home(t).alias("mask")))

    def signed(found: str, text: str) -> Column:
        return _signatures(F.when(F.size(found) > 0, F.col(found)).otherwise(rest(text)))

    prints = both.select(
        "doc_id", "next_id", "n_chars", F.sha2("text", 256).alias("sha"), F.sha2("edited", 256).alias("edited_sha256"), *["text", "edited"] * whole
    )
    found = found.select("doc_id", F.sort_array("own").alias("own"), F.sort_array("other").alias("other"))
    prints = prints.join(found, "doc_id", "left").select(
        "doc_id",
        "next_id",
        "n_chars",
        "sha",
        "edited_sha256",
        signed("own", "text").alias("fingerprint"),
        signed("other", "edited").alias("edited_fingerprint"),
    )
    prints = written(prints, "fingerprints")
    nexts = prints.select(F.col("doc_id").alias("next_id"), F.col("sha").alias("next_sha"), F.col("fingerprint").alias("next_print"))
    near = lambda sha, mark: F.when(F.col("sha") == F.col(sha), F.lit(1.0)).otherwise(likeness(F.col("fingerprint"), F.col(mark)))
    return prints.join(nexts, "next_id").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        near("edited_sha256", "edited_fingerprint").alias("near_edited"),
        near("next_sha", "next_print").alias("near_next"),
    )
