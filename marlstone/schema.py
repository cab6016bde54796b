"""The entities' schemas. Text fields of metadata are never null: an unknown one is empty."""

from __future__ import annotations

from pyspark.sql import types as T

FILE = T.StructType([T.StructField("file_path", T.StringType(), False), T.StructField("mtime", T.DoubleType()), T.StructField("length", T.LongType())])

EXTRACTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("extractor_used", T.StringType()), T.StructField("error", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])

METADATA_FIELDS = ("doc_title", "doc_author", "doc_created", "doc_modified", "doc_keywords", "doc_subject", "doc_type", "file_name", "file_type", "file_size", "fs_created", "fs_modified", "relative_path")

CHUNK = T.StructType([T.StructField("chunk_id", T.StringType(), False), T.StructField("text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("file_path", T.StringType()), *[T.StructField(f, T.LongType() if f == "file_size" else T.StringType()) for f in METADATA_FIELDS], T.StructField("extractor_used", T.StringType())])

TRACKER = T.StructType([T.StructField("file_path", T.StringType(), False), T.StructField("file_mtime", T.DoubleType()), T.StructField("content_hash", T.StringType()), T.StructField("last_indexed", T.StringType()), T.StructField("is_indexed", T.BooleanType()), T.StructField("error_msg", T.StringType()), T.StructField("embedding_model", T.StringType())])
