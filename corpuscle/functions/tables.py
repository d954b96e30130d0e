"""Users' mappers as table functions of SQL: any number of rows for a document, or for a key's rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def register_mapper(spark: SparkSession, name: str, mapper: Callable[..., Iterable[tuple]], schema: str) -> None:
    """name(arguments...) for a lateral join: SELECT t.* FROM docs d, LATERAL name(d.text, 3) t.

    mapper(arguments...) gives rows of schema, any number of them, for each row on the left. Arguments that every call
    must give by a constant are checked while the query is analysed, by mapper.check(values) if it has that.
    """
    shape = StructType.fromDDL(schema)
    check = getattr(mapper, "check", None)

    class Mapper:
        @staticmethod
        def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
            if check:
                check([a.value if a.isConstantExpression else None for a in arguments])
            return AnalyzeResult(shape)

        def eval(self, *values):
            yield from mapper(*values)

    spark.udtf.register(name, udtf(Mapper))


def register_by_key(spark: SparkSession, name: str, start: Callable[[], object], key: str, order: str, schema: str) -> None:
    """name(TABLE(t)): rows of schema made of the rows of each key in their order, which analysis asks Spark for.

    start() gives a new object for each key, with add(row) and end(), both giving rows of schema: what it keeps between
    rows is all that is held, so a key's rows stream by. The table may have any other columns.
    """
    shape = StructType.fromDDL(schema)

    class ByKey:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or not {key, order} <= set(table.dataType.names):
                raise ValueError(f"{name} takes TABLE(...) with columns {key} and {order}")
            return AnalyzeResult(shape, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(order)])

        def __init__(self):
            self.state = start()

        def eval(self, row):
            yield from self.state.add(row)

        def terminate(self):
            yield from self.state.end()

    spark.udtf.register(name, udtf(ByKey))
