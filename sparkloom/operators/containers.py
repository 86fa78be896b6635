"""Ordered containers as plain functions of DataFrames: map, set, vector and multimap.

A map is (key, value) with unique keys, a set (key), a vector (pos, value) with
dense positions, a multimap (key, ord, value). find() is a lower bound: the
entries from the first key that is not below the argument. Changes return new
DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import with_positions


def _latest(updates: DataFrame, seq: str | None) -> DataFrame:
    """One update for each key: that of the largest seq."""
    rest = [c for c in updates.columns if c not in ("key", seq)]
    best = updates.groupBy("key").agg(F.max_by(F.struct(*rest), seq).alias("_u")) if seq else updates
    return best.select("key", "_u.*") if seq else updates.dropDuplicates(["key"])


@dataclass(frozen=True)
class OrderedMap:
    df: DataFrame

    def find(self, key: Any) -> DataFrame:
        """Entries from the lower bound on, in order."""
        return self.df.where(F.col("key") >= F.lit(key)).orderBy("key")

    def get(self, key: Any) -> DataFrame:
        return self.df.where(F.col("key") == F.lit(key))

    def lower_bounds(self, queries: DataFrame, block: str = "key") -> DataFrame:
        """For each (q), the first entry whose key is q or more: one ordered pass over keys and queries together."""
        both = self.df.select("key", "value", F.lit(None).cast(queries.schema["q"].dataType).alias("q")).unionByName(
            queries.select(F.col("q").alias("key"), F.lit(None).cast(self.df.schema["value"].dataType).alias("value"), "q")
        )
        placed = with_positions(both, "key", F.col("q").isNull().cast("int"))
        here = F.when(F.col("q").isNull(), F.struct("key", "value"))
        b = F.floor(F.col("pos") / 4096)
        # the nearest entry from here on: the last one seen from the far end, so that a frame only grows
        inner = F.last(here, True).over(Window.partitionBy("_b").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
        placed = placed.withColumn("_b", b)
        firsts = placed.groupBy("_b").agg(F.min_by(here, F.when(F.col("q").isNull(), F.col("pos"))).alias("_f"))
        after = F.last("_f", True).over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
        firsts = firsts.select("_b", after.alias("_after"))  # one row for each block of positions
        found = placed.withColumn("_in", inner).where("q is not null").join(firsts, "_b").select("q", F.coalesce("_in", "_after").alias("e"))
        return found.select("q", "e.key", "e.value")

    def seek(self, n: int) -> DataFrame:
        """The entry at position n."""
        return with_positions(self.df, "key").where(F.col("pos") == n)

    def first(self) -> DataFrame:
        return self.df.orderBy("key").limit(1)

    def last(self) -> DataFrame:
        return self.df.orderBy(F.desc("key")).limit(1)

    def size(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("size"))

    def between(self, low: Any, high: Any) -> DataFrame:
        return self.df.where((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))

    def upsert(self, updates: DataFrame, seq: str | None = None) -> OrderedMap:
        """Updates win over entries, the largest seq over other updates of its key."""
        new = _latest(updates, seq).select("key", "value")
        return OrderedMap(self.df.join(new, "key", "left_anti").select("key", "value").unionByName(new))

    def existed(self, keys: DataFrame) -> DataFrame:
        """keys with existed: was there an entry?"""
        mine = self.df.select("key", F.lit(True).alias("existed"))
        return keys.join(mine, "key", "left").withColumn("existed", F.coalesce("existed", F.lit(False)))

    def remove(self, keys: DataFrame) -> OrderedMap:
        return OrderedMap(self.df.join(keys.select("key"), "key", "left_anti"))

    def removed(self, keys: DataFrame) -> DataFrame:
        """What remove() takes away."""
        return self.df.join(keys.select("key"), "key", "left_semi")

    def replaced(self, updates: DataFrame, seq: str | None = None) -> DataFrame:
        """For each updated key its new value and the one before, if any."""
        new = _latest(updates, seq).select("key", "value")
        return new.join(self.df.select("key", F.col("value").alias("previous")), "key", "left")

    def with_value(self, keys: DataFrame, change: Callable[[Column, Column], Column]) -> OrderedMap:
        """change(old value or null, row of keys as struct) gives each named key's new value; null deletes or leaves out."""
        given = keys.select("key", F.struct(*keys.columns).alias("_given"))
        both = self.df.join(given, "key", "full")
        named = F.col("_given").isNotNull()
        new = F.when(named, change(F.col("value"), F.col("_given"))).otherwise(F.col("value"))
        return OrderedMap(both.select("key", new.alias("value"), named.alias("_named")).where("not _named or value is not null").drop("_named"))

    def insert(self, batch: DataFrame) -> OrderedMap:
        """A batch of new keys; a key that is there already is an error at run time."""
        clash = self.df.select("key", F.lit(True).alias("_there"))
        checked = batch.join(clash, "key", "left").withColumn(
            "key", F.when(F.col("_there"), F.raise_error(F.lit("key exists")).cast(batch.schema["key"].dataType)).otherwise(F.col("key"))
        )
        return OrderedMap(self.df.select("key", "value").unionByName(checked.select("key", "value")))

    def remove_positions(self, start: int, end: int) -> OrderedMap:
        return OrderedMap(with_positions(self.df, "key").where((F.col("pos") < start) | (F.col("pos") >= end)).drop("pos"))

    def chunks(self, run: Callable, schema: str) -> DataFrame:
        """run over Arrow batches in order of key within ranges of keys."""
        return self.df.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, schema)


@dataclass(frozen=True)
class OrderedSet:
    df: DataFrame

    def find(self, key: Any) -> DataFrame:
        return self.df.where(F.col("key") >= F.lit(key)).orderBy("key")

    def contains(self, keys: DataFrame) -> DataFrame:
        return OrderedMap(self.df).existed(keys.select("key")).withColumnRenamed("existed", "found")

    def upsert(self, keys: DataFrame) -> OrderedSet:
        return OrderedSet(self.df.select("key").unionByName(keys.select("key")).distinct())

    def remove(self, keys: DataFrame) -> OrderedSet:
        return OrderedSet(self.df.join(keys.select("key"), "key", "left_anti"))

    def intersect(self, other: OrderedSet) -> OrderedSet:
        return OrderedSet(self.df.join(other.df, "key", "left_semi"))

    def read(self, start: int, length: int) -> DataFrame:
        """Keys by position."""
        return with_positions(self.df, "key").where((F.col("pos") >= start) & (F.col("pos") < start + length))

    def remove_positions(self, start: int, end: int) -> OrderedSet:
        return OrderedSet(OrderedMap(self.df).remove_positions(start, end).df)


@dataclass(frozen=True)
class Vector:
    df: DataFrame

    @staticmethod
    def of(df: DataFrame, *order: str, value: str) -> Vector:
        return Vector(with_positions(df.select(*dict.fromkeys([*order, value])), *order).select("pos", F.col(value).alias("value")))

    def get(self, pos: int) -> DataFrame:
        return self.df.where(F.col("pos") == pos)

    def set(self, pos: int, value: Any) -> Vector:
        return Vector(self.df.withColumn("value", F.when(F.col("pos") == pos, F.lit(value)).otherwise(F.col("value"))))

    def read(self, start: int, length: int) -> DataFrame:
        return self.df.where((F.col("pos") >= start) & (F.col("pos") < start + length))

    def insert(self, at: int, other: Vector, length: int) -> Vector:
        """length is the other's size: positions shift without a sort."""
        mine = self.df.withColumn("pos", F.when(F.col("pos") >= at, F.col("pos") + length).otherwise(F.col("pos")))
        return Vector(mine.unionByName(other.df.withColumn("pos", F.col("pos") + at)))

    def remove(self, start: int, end: int) -> Vector:
        rest = self.df.where((F.col("pos") < start) | (F.col("pos") >= end))
        return Vector(rest.withColumn("pos", F.when(F.col("pos") >= end, F.col("pos") - (end - start)).otherwise(F.col("pos"))))


@dataclass(frozen=True)
class Multimap:
    df: DataFrame

    def grouped(self) -> DataFrame:
        """(key, values) with each key's values in order."""
        pairs = F.sort_array(F.collect_list(F.struct("ord", "value")))
        return self.df.groupBy("key").agg(F.transform(pairs, lambda p: p["value"]).alias("values"))

    @staticmethod
    def of_groups(groups: DataFrame) -> Multimap:
        return Multimap(groups.select("key", F.posexplode("values").alias("ord", "value")))

    def sizes(self) -> DataFrame:
        return self.df.groupBy("key").agg(F.count("*").alias("size"))

    def find(self, key: Any) -> DataFrame:
        return self.df.where(F.col("key") >= F.lit(key)).orderBy("key", "ord")

    def values(self, key: Any) -> DataFrame:
        return self.df.where(F.col("key") == F.lit(key)).orderBy("ord")

    def contains(self, keys: DataFrame) -> DataFrame:
        return OrderedMap(self.df.select("key").distinct()).existed(keys.select("key")).withColumnRenamed("existed", "found")

    def upsert(self, other: DataFrame) -> Multimap:
        """The other's keys get its whole runs."""
        return Multimap(self.df.join(other.select("key").distinct(), "key", "left_anti").select("key", "ord", "value").unionByName(other.select("key", "ord", "value")))

    def remove(self, keys: DataFrame) -> Multimap:
        return Multimap(self.df.join(keys.select("key"), "key", "left_anti"))

    def remove_range(self, low: Any = None, high: Any = None) -> Multimap:
        """Without the keys from low up to high; an open side goes on."""
        inside = F.lit(True)
        if low is not None:
            inside &= F.col("key") >= F.lit(low)
        if high is not None:
            inside &= F.col("key") < F.lit(high)
        return Multimap(self.df.where(~inside))
