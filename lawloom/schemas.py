"""Schemas of the rows between the steps and at rest."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK = "kind string, text string, table_header string, table_rows array<string>"
BLOCKS = f"doc_id string, node_ix int, block_ix int, {BLOCK}"
ANCESTOR = "struct<guid:string,kind:string,heading:string,number:string>"
NODES = (
    "doc_id string, node_ix int, guid string, parent_guid string, kind string, heading string, number string, title string, "
    f"ancestors array<{ANCESTOR}>, history array<string>, ordinances array<string>, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>"
)
PAGES = "doc_id string, page int, text string"
HITS = "n int, id string, title string, citation string, breadcrumb string, url string, source_type string, content string, page_start int, page_end int, score double"

# The stored fields of a chunk with their type and index flags
# (K key, S searchable, F filterable, C facetable, O sortable).
CHUNK_FIELDS = [
    ("id", "string", "KFO"), ("doc_id", "string", "FC"), ("source_type", "string", "FC"), ("node_type", "string", "FC"),
    ("title", "string", "S"), ("citation", "string", "SFO"), ("content", "string", "S"), ("division", "string", "FC"),
    ("chapter_number", "string", "FCO"), ("chapter_title", "string", "SFC"), ("part", "string", "SF"), ("article", "string", "SFC"),
    ("section_number", "string", "FO"), ("section_title", "string", "S"), ("breadcrumb", "string", "S"), ("url", "string", ""),
    ("node_guid", "string", "F"), ("history", "string", "S"), ("ordinances", "array<string>", "SFC"), ("adopted_date", "timestamp", "FO"),
    ("page_start", "int", "F"), ("page_end", "int", "F"), ("chunk_index", "int", "FO"), ("chunk_count", "int", ""),
    ("token_count", "int", ""), ("municipality", "string", "FC"), ("legislation_through", "string", ""), ("crawled_at", "timestamp", "FO"),
]
FACETS = [name for name, _, flags in CHUNK_FIELDS if "C" in flags]


def chunk_schema() -> T.StructType:
    """The chunk's type; the index flags are metadata of the fields. Arrays can't be sorted by."""
    names = {"K": "key", "S": "searchable", "F": "filterable", "C": "facetable", "O": "sortable"}
    fields = []
    for name, kind, flags in CHUNK_FIELDS:
        own = {names[f]: True for f in flags if not (f == "O" and kind.startswith("array"))}
        fields.append(T.StructField(name, T._parse_datatype_string(kind), True, own))
    return T.StructType(fields)
