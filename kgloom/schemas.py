"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


DOCUMENT = _struct(doc_id=_S, text=_S)
PAGE = _struct(doc_id=_S, page_no=T.IntegerType(), text=_S)
CHUNK = _struct(doc_id=_S, chunk_no=T.IntegerType(), chunk=_S)
FACT = _struct(head=_S, relation=_S, tail=_S)
RAW_TRIPLE = _struct(head=_S, relation=_S, tail=_S, source=_S, method=_S)
TRIPLE = _struct(head=_S, relation=_S, tail=_S, source=_S, method=_S, ord=_L)
FINAL_TRIPLE = _struct(head=_S, relation=_S, tail=_S, source=_S, method=_S, ord=_L, head_type=_S, tail_type=_S, head_type_score=_D, tail_type_score=_D)
RELATION_TYPE = _struct(name=_S, description=_S, head_types=T.ArrayType(_S), tail_types=T.ArrayType(_S), is_symmetric=T.BooleanType(), mutex_with=T.ArrayType(_S))
ENTITY_TYPE = _struct(name=_S, description=_S, examples=T.ArrayType(_S))
TRUTH = _struct(entities=T.ArrayType(_S), relations=T.ArrayType(FACT))
ENTITY_LABEL = _struct(entity=_S, is_correct=T.BooleanType(), comment=_S)
RELATION_LABEL = _struct(head=_S, relation=_S, tail=_S, is_correct=T.BooleanType(), comment=_S)
