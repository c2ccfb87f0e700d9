"""External selections as a Spark data source: plug-in resolvers that give items, read in parallel, with filters.

A resolver is a class of the user's (any importable one), named by "module:Class" with arguments that JSON can hold. It
says in how many parts its items come, which filters it can take over itself, and gives the items of a part as Arrow
batches, in the tasks that read them.

Filters that are to reach a resolver are handed to external(). Those it takes are part of the source's options, and Spark
applies all of them again. (Spark's own push-down into Python sources is not used: in 4.1 a second query on the same
DataFrame that pushes nothing still reads by the filters of the first, which a test found.)
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = "value string, label string"
#: what a filter (column, op, value) may ask, as Spark's condition
OPS = {
    "equal": lambda c, v: c == v, "in": lambda c, v: c.isin(list(v)), "starts_with": lambda c, v: c.startswith(v),
    "greater": lambda c, v: c > v, "at_least": lambda c, v: c >= v, "less": lambda c, v: c < v, "at_most": lambda c, v: c <= v,
}
_ARROW = pa.schema([("value", pa.string()), ("label", pa.string())])


class Resolver:
    """A source of items (value, label). Subclasses hold only what can be pickled."""

    def parts(self) -> list:
        """What can be read apart; at least one part, unless there are no items."""
        raise NotImplementedError

    def takes(self, column: str, op: str) -> bool:
        """Whether items() applies filters of this kind (ops: those of OPS)."""
        return False

    def items(self, part, filters: list[tuple[str, str, object]]) -> Iterator[pa.RecordBatch]:
        """Batches (value, label) of a part that satisfy the filters (column, op, value) it takes."""
        raise NotImplementedError


class ParquetItems(Resolver):
    """Items in the columns of Parquet files, each row group a part; filters skip row groups and rows."""

    def __init__(self, path: str, value: str, label: str) -> None:
        self.path, self.value, self.label = path, value, label

    def _fragments(self):
        import pyarrow.dataset as pd

        return pd.dataset(self.path.removeprefix("file://"), format="parquet").get_fragments()

    def parts(self) -> list:
        return [(f.path, g.id) for f in self._fragments() for g in f.row_groups]

    def takes(self, column: str, op: str) -> bool:
        return True

    def items(self, part, filters) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        names = {"value": self.value, "label": self.label}
        wanted = pc.scalar(True)
        for column, op, v in filters:
            c = pc.field(names[column])
            wanted &= {
                "equal": lambda: c == v, "in": lambda: c.isin(list(v)), "starts_with": lambda: pc.starts_with(c, v),
                "greater": lambda: c > v, "at_least": lambda: c >= v, "less": lambda: c < v, "at_most": lambda: c <= v,
            }[op]()
        path, group = part
        for f in self._fragments():
            if f.path == path:
                for batch in f.subset(row_group_ids=[group]).to_batches(columns=list(dict.fromkeys(names.values())), filter=wanted):
                    yield pa.RecordBatch.from_arrays([batch.column(names[c]).cast(pa.string()) for c in ("value", "label")], schema=_ARROW)


class _Part(ds.InputPartition):
    pass


class _Reader(ds.DataSourceReader):
    def __init__(self, resolver: Resolver, filters: list[tuple[str, str, object]]) -> None:
        self.resolver, self.filters = resolver, filters

    def partitions(self):
        return [_Part(p) for p in self.resolver.parts()] or [_Part(None)]

    def read(self, partition):
        if partition.value is not None:
            yield from self.resolver.items(partition.value, self.filters)


class SelectionSource(ds.DataSource):
    """Format `paramloom_selection`; options `resolver` ("module:Class"), `arguments` and `filters` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paramloom_selection"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        filters = [tuple(f) for f in json.loads(self.options.get("filters", "[]"))]
        return _Reader(resolver(self.options["resolver"], json.loads(self.options.get("arguments", "{}"))), filters)


def resolver(name: str, arguments: dict) -> Resolver:
    """The resolver that a name stands for; LookupError if there is none."""
    module, _, cls = name.partition(":")
    try:
        kind = getattr(importlib.import_module(module), cls)
    except (ImportError, AttributeError, ValueError):
        raise LookupError(f"no resolver {name!r}") from None
    if not (isinstance(kind, type) and issubclass(kind, Resolver)):
        raise LookupError(f"{name!r} is no resolver")
    return kind(**arguments)


def external(spark: SparkSession, name: str, *filters: tuple[str, str, object], **arguments) -> DataFrame:
    """The items (value, label) of a resolver that satisfy all filters (column, op, value)."""
    source = resolver(name, arguments)  # an unknown name fails here, not in a task
    taken = [f for f in filters if source.takes(f[0], f[1])]
    spark.dataSource.register(SelectionSource)
    read = spark.read.format(SelectionSource.name()).option("resolver", name).option("arguments", json.dumps(arguments)).option("filters", json.dumps(taken))
    items = read.load()
    for column, op, value in filters:
        items = items.where(OPS[op](F.col(column), value))
    return items
