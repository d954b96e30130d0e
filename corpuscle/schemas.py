"""Schemas of the tables that sources read and operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

DOCUMENT = _table(title=_S, text=_S, links=T.ArrayType(_S), flags=T.ArrayType(_S))
TERM_STATS = _table(word=_S, tf=_L, df=_L)
VECTOR = _table(head=_S, feature=_S, cnt=_L)
WEIGHTED = _table(head=_S, feature=_S, weight=_D)
EDGE = _table(kind=_S, src=_S, dst=_S)
DEGREE = _table(doc=_S, incoming=_L, outgoing=_L)
DUMP_PAGE = T.StructType(
    [
        T.StructField("title", _S),
        T.StructField("ns", _S),
        T.StructField("id", _L),
        T.StructField("redirect", _S),
        T.StructField(
            "revision",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", _L),
                        T.StructField("timestamp", _S),
                        T.StructField("contributor", _table(username=_S, id=_L, ip=_S)),
                        T.StructField("minor", _S),
                        T.StructField("comment", _S),
                        T.StructField("text", _table(_VALUE=_S)),
                    ]
                )
            ),
        ),
    ]
)
