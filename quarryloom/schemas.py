"""Schemas of the tables that make an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = "repo_root string, path string, mtime timestamp, size long, text string"
SYMBOLS = "repo_root string, name string, kind string, path string, line int, language string, pattern string, scope string, signature string"
CHUNKS = "repo_root string, path string, start_line int, end_line int, start_byte long, end_byte long, content string, content_hash string, node_type string, node_name string, language string"
CACHE = "content_hash string, embedding array<float>, created_at timestamp, access_count long, last_accessed timestamp, model string, dimensions int"
LOCATIONS = "repo_root string, path string, start_line int, end_line int, content_hash string, node_type string, node_name string, language string, created_at timestamp"
FILE_STATS = "repo_root string, path string, chunks long, types map<string,long>, languages map<string,long>, hashes binary"
MERKLE = "path string, parent string, depth int, is_dir boolean, hash string, size long"
RANKED = "id string, path string, line int, end_line int, score double, source string, rank int, snippet string, metadata map<string,string>"
PROJECTS = "path string, name string, watch_enabled boolean, added_at timestamp, last_indexed timestamp, symbols long, embeddings long, db_bytes long"
REPO_CONFIG = "repo_root string, model string, dimensions int, updated_at timestamp"
TABLES = {"files": FILES, "symbols": SYMBOLS, "chunks": CHUNKS, "embedding_cache": CACHE, "chunk_locations": LOCATIONS, "merkle": MERKLE, "projects": PROJECTS, "repo_config": REPO_CONFIG}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
