"""Schemas of the records the library reads."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("item_id", "passage_id", "source_name", "book", "chunk_idx", "relation", "relation_group", "relation_display", "relation_definition", "head_text", "head_type")]
    + [T.StructField("head_start", T.IntegerType()), T.StructField("head_end", T.IntegerType()), T.StructField("tail_text", T.StringType()), T.StructField("tail_type", T.StringType())]
    + [T.StructField("tail_start", T.IntegerType()), T.StructField("tail_end", T.IntegerType()), T.StructField("passage_text", T.StringType()), T.StructField("dataset_origin", T.StringType()), T.StructField("provenance_resolution", T.StringType())]
)
LABELLED_ITEM = T.StructType([*ITEM.fields, T.StructField("label", T.StringType())])

NODE = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
EDGE = T.StructType(
    [
        T.StructField("head", NODE), T.StructField("relation", T.StringType()), T.StructField("tail", NODE), T.StructField("authority", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("support_count", T.IntegerType()), T.StructField("unique_book_count", T.IntegerType()), T.StructField("best_book", T.StringType()), T.StructField("best_chunk", T.IntegerType()), T.StructField("evidence", T.StringType()),
    ]
)
CHUNK = T.StructType([T.StructField("book", T.StringType()), T.StructField("chunk_idx", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(NODE))])
PATH = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(T.StringType())), T.StructField("hops", T.IntegerType()),
        T.StructField("semantic_edges", T.IntegerType()), T.StructField("passage_conditioned", T.BooleanType()),
    ]
)
PATH_RECORD = T.StructType(
    [
        T.StructField("item_id", T.StringType()), T.StructField("split", T.StringType()), T.StructField("path_count", T.IntegerType()), T.StructField("enumeration_truncated", T.BooleanType()),
        T.StructField("paths", T.ArrayType(PATH)), T.StructField("label_fields_present", T.BooleanType()),
    ]
)
ENTITY_SPAN = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])

#: Strength of an edge's sources, in order.
AUTHORITY = ("single", "medium", "high", "very_high")
