"""The query layer as named functions with checked arguments, as a model or a shell calls them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import graph
from lexweave.operators import search as S
from lexweave.operators.links import reference_search


class ToolError(ValueError):
    """A call that names no tool, or whose arguments don't fit."""


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    required: dict[str, type]
    optional: dict[str, type]
    says: str


class Tools:
    """Tools over tables of circulars (id, title, reference, department, day, body), edges and values."""

    def __init__(self, circulars: DataFrame, edges: DataFrame, values: DataFrame):
        self.circulars, self.edges, self.values = circulars, edges, values
        self.known = {
            "search_circulars": Tool(self.search, {"query": str}, {"department": str, "limit": int}, "circulars that a question finds by words"),
            "find_reference": Tool(self.reference, {"reference": str}, {"limit": int}, "circulars that a reference means"),
            "get_circular": Tool(self.circular, {"id": int}, {}, "one circular"),
            "related_circulars": Tool(self.related, {"id": int}, {"depth": int}, "what lies within some edges of a circular"),
            "amendment_chain": Tool(self.chain, {"id": int}, {}, "the chain of a circular, oldest first"),
            "find_values": Tool(self.find_values, {"metric": str}, {"subject": str, "limit": int}, "values of a metric, latest first"),
            "list_departments": Tool(self.departments, {}, {}, "departments with their numbers of circulars"),
        }

    def call(self, name: str, arguments: dict | None = None) -> DataFrame:
        arguments = arguments or {}
        if name not in self.known:
            raise ToolError(f"no tool {name}; there are {sorted(self.known)}")
        tool = self.known[name]
        kinds = tool.required | tool.optional
        missing, odd = sorted(set(tool.required) - set(arguments)), sorted(set(arguments) - set(kinds))
        wrong = sorted(k for k, v in arguments.items() if k in kinds and not isinstance(v, kinds[k]))
        if missing or odd or wrong:
            raise ToolError(f"{name}: missing {missing}, unknown {odd}, of a wrong kind {wrong}")
        return tool.run(**arguments)

    def _one(self, **values: object) -> DataFrame:
        return self.circulars.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])

    def search(self, query: str, department: str | None = None, limit: int = 10) -> DataFrame:
        kept = self.circulars if department is None else self.circulars.where(F.lower("department").contains(department.lower()))
        arm = S.lexical_arm(kept, self._one(query_id=0, text=query), S.CIRCULAR_COLUMNS, limit)
        return arm.join(kept.select("id", "title", "reference", "day"), "id").select("rank", "id", "title", "reference", "day").orderBy("rank")

    def reference(self, reference: str, limit: int = 20) -> DataFrame:
        found = reference_search(self._one(query_id=0, text=reference), self.circulars, limit)
        return found.join(self.circulars, "id").select("id", "title", "reference", "day").orderBy(F.desc("day"), "id")

    def circular(self, id: int) -> DataFrame:  # noqa: A002
        return self.circulars.where(F.col("id") == id)

    def related(self, id: int, depth: int = 1) -> DataFrame:  # noqa: A002
        return graph.neighbourhood(self.edges, self._one(seed=id), depth).where("level > 0").select(F.col("node").alias("id"), "level")

    def chain(self, id: int) -> DataFrame:  # noqa: A002
        chains = graph.chain(self.edges, self._one(seed=id))
        return graph.chain_members(chains, self.circulars.select("id", "day")).select(F.col("node").alias("id"), "position").orderBy("position")

    def find_values(self, metric: str, subject: str | None = None, limit: int = 20) -> DataFrame:
        rows = self.values.where(F.lower("metric").contains(metric.lower()))
        rows = rows if subject is None else rows.where(F.lower("subject").contains(subject.lower()))
        return rows.orderBy(F.desc_nulls_last("day")).limit(limit)

    def departments(self) -> DataFrame:
        return self.circulars.groupBy("department").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "department")
