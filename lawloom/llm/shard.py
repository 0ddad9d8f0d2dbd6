"""K-d tree partitioning of documents into shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

_BINS = 4096
_TIE = 1 << 32  # below the scaled value of a dimension stands a crc32
_SCALE = (1 << 30) - 1


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _at(values: dict[int, int], node: Column, size: int, other: int = -1) -> Column:
    """values[node], as a look-up in a literal array."""
    return F.get(F.array(*[F.lit(values.get(n, other)).cast("long") for n in range(size)]), node)


def _place(tree: dict, dims: list[str]) -> Column:
    """The leaf or open node in which a row stands, by walking down the splits made so far."""
    size = 2 * len(tree) + 1
    keys = F.array(*dims)
    depth = F.array(*[F.lit(i) for i in range(len(tree).bit_length() + 8)])

    def down(node: Column, _: Column) -> Column:
        child = _at({n: t[2] for n, t in tree.items()}, node, size)
        bound = _at({n: t[1] for n, t in tree.items()}, node, size)
        dim = _at({n: dims.index(t[0]) for n, t in tree.items()}, node, size, 0).cast("int")
        return F.when(child < 0, node).otherwise(child.cast("int") + (F.get(keys, dim) > bound).cast("int"))

    return F.aggregate(depth, F.lit(0), down) if tree else F.lit(0)


def kd_tree(rows: DataFrame, dims: list[str], leaves: int) -> tuple[dict, dict[int, int]]:
    """Split rows (size, and one long key for each of dims) into leaves of near equal sums of size.

    Each level takes one pass for the ranges of all its open nodes, picks the widest
    dimension of each against the whole table's range, and finds the weighted quantile by
    histograms of at most 4,096 bins a node, refined until the crossing bin holds one key.
    Only one row a node comes to the driver. Returns the splits and the shard of each leaf.
    """
    tree: dict[int, tuple[str, int, int, int]] = {}
    wanted = {0: leaves}
    whole: dict[str, int] = {}
    following = 1
    while open_ := {n: k for n, k in wanted.items() if k > 1 and n not in tree}:
        placed = rows.withColumn("node", _place(tree, dims)).where(F.col("node").isin(list(open_)))
        ranges = placed.groupBy("node").agg(
            F.sum("size").alias("size"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
        )
        state: dict[int, dict] = {}
        for r in ranges.collect():
            width = {d: r[f"max_{d}"] - r[f"min_{d}"] for d in dims}
            whole = whole or {d: max(1, w) for d, w in width.items()}
            dim = max(dims, key=lambda d: width[d] / whole[d])
            k = open_[r["node"]]
            state[r["node"]] = {"dim": dim, "lo": r[f"min_{dim}"], "hi": r[f"max_{dim}"], "before": 0, "target": r["size"] * (k // 2) // k}
        bounds: dict[int, int] = {}
        while live := {n: s for n, s in state.items() if n not in bounds}:
            step = {n: (s["hi"] - s["lo"]) // _BINS + 1 for n, s in live.items()}
            node, size = F.col("node"), following
            key = F.get(F.array(*dims), _at({n: dims.index(s["dim"]) for n, s in live.items()}, node, size, 0).cast("int"))
            low = _at({n: s["lo"] for n, s in live.items()}, node, size)
            high = _at({n: s["hi"] for n, s in live.items()}, node, size)
            bins = (
                placed.where(node.isin(list(live)))
                .select("node", "size", key.alias("key"), low.alias("low"), high.alias("high"), _at(step, node, size, 1).alias("step"))
                .where(F.col("key").between(F.col("low"), F.col("high")))
                .withColumn("bin", F.floor((F.col("key") - F.col("low")) / F.col("step")).cast("long"))
                .groupBy("node", "bin")
                .agg(F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last"))
            )
            upto = F.sum("size").over(Window.partitionBy("node").orderBy("bin"))
            goal = _at({n: int(s["target"] - s["before"]) for n, s in live.items()}, node, size)
            crossing = (
                bins.withColumn("upto", upto)
                .where(F.col("upto") >= goal)
                .groupBy("node")
                .agg(F.min_by(F.struct("upto", "size", "first", "last"), "bin").alias("at"))
            )
            for r in crossing.collect():
                s, at = live[r["node"]], r["at"]
                s["before"] += at["upto"] - at["size"]
                s["lo"], s["hi"] = at["first"], at["last"]
                if at["first"] == at["last"]:
                    short, over = s["target"] - s["before"], s["before"] + at["size"] - s["target"]
                    bounds[r["node"]] = at["first"] if over <= short else at["first"] - 1
        for n in open_:
            if n in state:
                tree[n] = (state[n]["dim"], bounds[n], following, following + 1)
            else:  # a node without rows: any split will do
                tree[n] = (dims[0], 0, following, following + 1)
            wanted[following], wanted[following + 1] = open_[n] // 2, open_[n] - open_[n] // 2
            following += 2
    ends = sorted(n for n in wanted if n not in tree)
    return tree, {n: shard for shard, n in enumerate(ends)}


def shard_documents(
    docs: DataFrame, *, shards: int = 40, target_bytes: int | None = None, slot_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    The law is ``bytes``: a k-d tree over (log of size, id, source) is split until its leaves
    reach the target bytes: ``target_bytes``, which then gives the number of shards, or all bytes over ``shards``.
    A node is split at the weighted median of its widest dimension, or where it makes an odd number
    of leaves at the matching weighted quantile. Below each dimension's scaled value stands a
    hash of the id, the text and the row's place in the input, so a source, a group of copies or
    equal rows that make up a third of all are split like any other. Texts are read once; later passes read a table of ids, sizes and sources. Slots are
    numbered in buckets of about ``slot_rows`` rows, to which the rows of the buckets before
    are added, so no task sorts a whole shard.

    Cases: null text has size 16 and the crc32 of the empty text; null ids and sources count
    as 0; ties, also rows equal in everything, are split by that hash (which of equal rows goes where depends on
    how the input is partitioned); an empty table gives no rows; with fewer documents than shards some shards are
    empty; other columns, whatever their names, are not read.
    """
    base = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            size_of(F.col(text_col)).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.crc32(F.coalesce(F.col(source_col), F.lit("")).cast("binary")).alias("source_crc32"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    values = {"by_size": F.log2("size"), "by_id": F.coalesce("doc_id", F.lit(0)).cast("double"), "by_source": F.col("source_crc32").cast("double")}
    ends = base.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *[f(v).alias(f"{n}_{d}") for d, v in values.items() for n, f in (("min", F.min), ("max", F.max))]).first()
    empty = {"law": F.lit("bytes"), "shard": F.lit(0), "slot": F.lit(0).cast("long"), "grown_shard": F.lit(None).cast("int")}
    out = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    if not ends["n"]:
        return base.withColumns(empty).select(out)
    shards = shards if target_bytes is None else max(1, -(-ends["bytes"] // target_bytes))
    tie = F.crc32(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"), F.col("row").cast("string")).cast("binary"))
    keys = {}
    for d, v in values.items():
        span = (ends[f"max_{d}"] - ends[f"min_{d}"]) or 1.0
        keys[d] = F.floor((v - F.lit(ends[f"min_{d}"])) / F.lit(span) * _SCALE).cast("long") * _TIE + tie
    rows = base.withColumns(keys)
    tree, shard_of = kd_tree(rows, list(values), shards)
    buckets = max(1, -(-ends["n"] // (shards * slot_rows)))
    placed = (
        rows.withColumn("shard", _at(shard_of, _place(tree, list(values)), 2 * shards - 1).cast("int"))
        .withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
        .select("doc_id", "size", "text_crc32", "shard", "bucket", "row")
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row")) - 1
    return (
        placed.withColumn("place", place)
        .join(starts, ["shard", "bucket"])
        .withColumns({"law": F.lit("bytes"), "slot": (F.col("start") + F.col("place")).cast("long"), "grown_shard": F.lit(None).cast("int")})
        .select(out)
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, files: int = 1, id_col: str = "doc_id") -> None:
    """Write whole documents as Parquet folders shard=0, shard=1, ..., each of about ``files`` files in order of slot."""
    (
        docs.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
        .repartition(F.col("shard"), F.pmod(F.xxhash64(id_col), F.lit(files)))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
