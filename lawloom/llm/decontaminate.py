"""Benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of

# Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
    "contaminated boolean, spans array<struct<begin:long,end:long>>"
)


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words: A-Z lower-cased, all other ASCII but letters and digits as breaks."""
    return text.translate(_KEEP).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def item_windows(items: list[tuple[str, bytes | None]], size: int) -> dict[bytes, list[str]]:
    """Each distinct window with the items that hold it."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        for window in windows_of(words_of(text), size):
            found[window].add(item)
    return {window: sorted(owners) for window, owners in found.items()}


def build_automaton(windows: dict[bytes, list[str]]) -> ahocorasick.Automaton | None:
    """One automaton over all windows, each between spaces so that it matches whole words."""
    if not windows:
        return None
    automaton = ahocorasick.Automaton()
    for window, owners in windows.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, owners))
    automaton.make_automaton()
    return automaton


def scan(text: bytes | None, automaton: ahocorasick.Automaton | None) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, hit flag of each word, and the items with occurring windows."""
    words = words_of(text)
    if not words or automaton is None:
        return len(words), np.zeros(0, bool), set()
    line = f" {b' '.join(words).decode('latin-1')} "
    owners: set[str] = set()
    ends, sizes = [], []
    for end, (size, items) in automaton.iter(line):
        ends.append(end)
        sizes.append(size)
        owners.update(items)
    if not ends:
        return len(words), np.zeros(0, bool), owners
    # The space after word k stands where the lengths of the words before it say.
    after = np.cumsum([len(w) + 1 for w in words])
    last = np.searchsorted(after, ends)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, last - np.array(sizes) + 1, 1)
    np.add.at(marks, last + 1, -1)
    return len(words), np.cumsum(marks[:-1]) > 0, owners


def spans_of(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets in the original text, whose characters are counted once."""
    bounds = np.array([m.span() for m in _WORD.finditer(text)])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    # Every byte but those that go on with a character begins one.
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [{"begin": int(chars[bounds[a][0]]), "end": int(chars[bounds[b - 1][1]])} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def automaton_of(items: list[tuple[str, bytes | None]], window: int) -> ahocorasick.Automaton | None:
    """The automaton of these items, built once in a Python worker, which serves many tasks; the last one is kept."""
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build_automaton(item_windows(items, window))
    return _BUILT[key]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_benchmark_mb: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its words, the words in benchmark windows, the items, and the spans.

    A window is ``window`` consecutive words of an item; a shorter item that has words is one
    window. One Aho-Corasick automaton over all windows scans each normalised text once;
    ``spans`` gives the hit passages as character offsets (end exclusive) of the original text.
    Item texts are broadcast after a check of their size against ``max_benchmark_mb``, and each worker makes
    the automaton of them, which takes up to about 60 times their size in memory; beyond the bound the call
    fails rather than drop items: split the benchmark and call once per part.

    Cases: null and word-free texts have no words and are not contaminated; null item texts
    have no windows; a null item id is called ``null``; repeated rows are each judged; an empty
    benchmark hits nothing; other columns are not read.
    """
    spark = docs.sparkSession
    batches_of(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"))
    mb = (items.agg(F.sum(F.length("text"))).first()[0] or 0) / 1e6
    if mb > max_benchmark_mb:
        raise ValueError(f"the benchmark has {mb:.0f} MB of text, max_benchmark_mb is {max_benchmark_mb}")
    shared = spark.sparkContext.broadcast([(r.item, None if r.text is None else bytes(r.text)) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value, window)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = bytes(text) if text is not None else None
                n, hit, owners = scan(text, automaton)
                items = sorted(owners)
                rows.append(
                    {
                        "doc_id": doc_id,
                        "n_words": n,
                        "n_hit": int(hit.sum()),
                        "n_items": len(items),
                        "items": items,
                        "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
                        "contaminated": bool(hit.any()),
                        "spans": spans_of(text, hit) if hit.any() else [],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string()))]
        + [("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", span)]
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
