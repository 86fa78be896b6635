"""SQL pass-through, its JSON envelope, and the small set of tools that serve it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables


def query(spark: SparkSession, text: str, folder: str | None = None, args: dict[str, Any] | None = None) -> DataFrame:
    """Any Spark SQL statement, over the views of a folder's tables where one is given."""
    if folder is not None:
        names = tuple(n for n in tables.NAMES if n in text)
        tables.register(spark, folder, names)
    return spark.sql(text, args) if args else spark.sql(text)


def as_records(df: DataFrame) -> DataFrame:
    """(record): each row as a JSON object whose values are strings, NULL as the text "NULL"; of equal names the last counts."""
    last = {c: i for i, c in enumerate(df.columns)}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    fields = [F.coalesce(F.col(f"c{i}").cast("string"), F.lit("NULL")).alias(c) for c, i in last.items()]
    return plain.select(F.to_json(F.struct(*fields)).alias("record"))


class ToolServer:
    """Named tools with described parameters, over dictionaries or lines of JSON."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tools: dict[str, tuple[str, dict[str, str], Callable[..., Any]]] = {}
        self.register("init", "describes the tools", {}, self.describe)
        self.register("add_numbers", "adds two numbers", {"a": "number", "b": "number"}, lambda a, b: a + b)
        self.register("sql_query", "runs a statement", {"query": "string"}, self._sql)

    def register(self, name: str, about: str, params: dict[str, str], run: Callable[..., Any]) -> None:
        self.tools[name] = (about, params, run)

    def describe(self) -> list[dict[str, Any]]:
        return [{"name": n, "description": a, "parameters": p} for n, (a, p, _) in sorted(self.tools.items())]

    def _sql(self, query: str) -> list[dict[str, str]]:
        # the answer is one message, so it is gathered here; use query() for large results
        return [json.loads(r.record) for r in as_records(self.spark.sql(query)).toLocalIterator()]

    def execute(self, name: str, params: dict[str, Any]) -> dict[str, Any]:
        if name not in self.tools:
            return {"error": f"unknown tool {name}"}
        try:
            return {"result": self.tools[name][2](**params)}
        except Exception as e:  # a failing tool answers; it doesn't end the server
            return {"error": str(e).split("\n")[0]}

    def serve(self, lines: Iterator[str], out: TextIO) -> None:
        """One request {"tool", "params"} a line, one answer a line."""
        for line in lines:
            if line.strip():
                try:
                    request = json.loads(line)
                    answer = self.execute(request.get("tool", ""), request.get("params", {}))
                except json.JSONDecodeError as e:
                    answer = {"error": f"not JSON: {e}"}
                out.write(json.dumps(answer) + "\n")
                out.flush()
