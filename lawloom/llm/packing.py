"""Bounded-space online packing of token sequences into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialise
from .tokens import tokenizer

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_MERGED = 1 << 60  # ids of merged windows stand above those of the tasks'


class Windows:
    """A fixed number of open windows; pieces are only ever added to one or start a new one."""

    def __init__(self, size: int, open_: int, first: int) -> None:
        self.size, self.next = size, first
        self.free = np.zeros(open_, np.int64)  # 0: the place is not in use, or full
        self.ids = np.full(open_, -1, np.int64)

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece shorter than a window.

        It goes where it leaves the least room. If it fits nowhere, it starts a window in an
        unused place, or else in that of the fullest window, which is emitted as it is.
        """
        room = np.where(self.free >= length, self.free, self.size + 1)
        at = int(room.argmin())
        if room[at] > self.size:
            at = int(self.free.argmin())
            self.ids[at], self.free[at] = self.new(), self.size
        offset = self.size - int(self.free[at])
        self.free[at] -= length
        return int(self.ids[at]), offset


def _pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, open_: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        windows = Windows(size, open_, part << 32)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    window, offset = (windows.new(), 0) if length == size else windows.place(length)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, n, window, offset))
            yield batch_of(rows)
        # What is open at the end, as rows without a piece: the window, and how much of it is used.
        yield batch_of([(None, -1, 0, 0, 0, int(i), size - int(free)) for i, free in zip(windows.ids, windows.free, strict=True) if free])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names)

    names = [x.split()[0] for x in PIECE.split(", ")]
    return docs.mapInArrow(run, PIECE)


def _merge(windows: DataFrame, size: int, level: int, fan_in: int) -> DataFrame:
    """One round: windows (sequence_id, used, part) of fan_in neighbouring parts share new windows.

    Within a group, longest first, each old window goes whole into the new one where it leaves
    the least room. Of the new windows at most one is half empty, so a group of the next round
    gets at most fan_in rows, and one of the first round at most fan_in times the open windows.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["used", "sequence_id"], ascending=[False, True])
        first = _MERGED + (level << 54) + (int(key[0]) << 24)
        free, to, base = np.zeros(len(group), np.int64), [], []
        made = 0
        for used in group["used"]:
            room = np.where(free[:made] >= used, free[:made], size + 1)
            at = int(room.argmin()) if made and room.min() <= size else made
            if at == made:
                free[at], made = size, made + 1
            to.append(first + at)
            base.append(size - int(free[at]))
            free[at] -= used
        return pd.DataFrame({"sequence_id": group["sequence_id"], "to": to, "base": base, "used": group["used"], "part": int(key[0])})

    return windows.groupBy(F.floor(F.col("part") / fan_in).alias("part")).applyInPandas(run, "sequence_id long, to long, base long, used long, part long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, size: int = 2048, open_windows: int = 128, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are tokenised where they are read and never shuffled. Each task keeps
    ``open_windows`` windows: full windows' worth of a document become sequences of their
    own, the rest goes best-fit into an open window; where it fits nowhere, the fullest
    window is emitted. What a task leaves open at its end, at most its open windows, is
    merged in rounds over ``fan_in`` neighbouring tasks, until one group remains. The
    pieces, without tokens, are written once to the shared folder.

    Cases: null text is empty, so it is the end id alone; repeated rows and null ids are
    packed like others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    batches_of(spark, 500)
    pieces = materialise(_pieces(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer_path, end_id, size, open_windows), "pieces")
    open_ = pieces.where("start < 0").select("sequence_id", F.col("offset").alias("used"), F.shiftright("sequence_id", 32).alias("part"))
    moves = None
    left = materialise(open_, "left")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while level == 0 or parts > 1:
        made = materialise(_merge(left, size, level, fan_in), f"merge{level}")
        step = made.select("sequence_id", "to", "base")
        if moves is None:
            moves = step
        else:
            again = step.withColumnsRenamed({"sequence_id": "via", "to": "to2", "base": "base2"})
            moves = moves.join(again, F.col("to") == F.col("via"), "left").select(
                "sequence_id", F.coalesce("to2", "to").alias("to"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base")
            )
        left = materialise(
            made.groupBy(F.col("to").alias("sequence_id"), "part").agg(F.sum("used").alias("used")).where(F.col("used") <= size // 2), f"left{level}"
        )
        parts, level = -(-parts // fan_in), level + 1
    return pieces.where("start >= 0").join(moves, "sequence_id", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
    )
