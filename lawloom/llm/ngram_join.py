"""Jaccard similarity join on word n-grams with rare-first prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialise, spread_join
from .components import connected_components
from .words import shingles, word_hashes

_RARE = (1 << 15) - 1  # document frequencies from here on count as the same in the order of n-grams


def least_shared(n: int, percent: int) -> int:
    """Shared n-grams that a set of n needs with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def half(n: int, percent: int) -> tuple[int, int]:
    """How many n-grams, in order of their hash, show whether a set can have a partner, and how many must be shared.

    If a partner shares at least ``least_shared`` n-grams, it shares at least n // 4 within the first
    n - least_shared + n // 4 of both sets in any common order; 2 are left for rounding.
    """
    extra = max(1, n // 4)
    return min(n, n - least_shared(n, percent) + extra), max(1, extra - 2)


def _sets(text: bytes | None, size: int) -> np.ndarray:
    return shingles(word_hashes(text)[0], size)


def _key(grams: np.ndarray) -> bytes:
    return hashlib.md5(grams.tobytes(), usedforsecurity=False).digest()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key, short_key: sets of n-grams are equal when their keys are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sets(t, size) for t in batch.column(2).to_pylist()]
            keys = [_key(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array(keys, pa.binary()), pa.array(np.frombuffer(b"".join(k[:8] for k in keys), "<i8"))],
                ["doc_id", "text_hash", "n_shingles", "set_key", "short_key"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, short_key long")


def _maybe_shared(docs: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """short_key of the sets that may have a partner, with false positives but nothing lost.

    Every set sends the first n-grams in order of their hash (see ``half``), packed by task batch
    and range of hashes, each distinct set once a batch. A range counts which hashes more than
    one set has; sets with too few of those can't have a partner. Hashes are cut to 32 bits
    below their range, which can only make more sets pass.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct = {}
            for text in batch.column(2).to_pylist():
                grams = _sets(text, size)
                if len(grams):
                    distinct.setdefault(_key(grams)[:8], grams)
            if not distinct:
                continue
            parts = [g[: half(len(g), percent)[0]] for g in distinct.values()]
            keys = np.frombuffer(b"".join(distinct), "<i8")
            grams = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            short = (grams >> np.uint64(32)).astype("<u4")
            order = np.argsort(bucket, kind="stable")
            present, starts = np.unique(bucket[order], return_index=True)
            rows = []
            for b, own in zip(present.tolist(), np.split(order, starts[1:]), strict=True):
                who, counts = np.unique(owner[own], return_counts=True)
                rows.append((b, keys[who].tobytes(), counts.astype("<u4").tobytes(), short[own].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.repeat(np.frombuffer(k, "<i8"), np.frombuffer(c, "<u4")) for k, c in zip(group["keys"], group["counts"], strict=True)])
        _, place, times = np.unique(np.frombuffer(b"".join(group["grams"]), "<u4"), return_inverse=True, return_counts=True)
        # The same set may come from several batches, so a hash is shared if its owners differ.
        low, high = np.full(len(times), np.iinfo(np.int64).max), np.full(len(times), np.iinfo(np.int64).min)
        np.minimum.at(low, place, keys)
        np.maximum.at(high, place, keys)
        shared = (low != high)[place]
        # Sets come once for each batch: count a set's hashes once.
        pairs = np.unique(np.stack((keys[shared], place[shared])), axis=1) if shared.any() else np.zeros((2, 0), np.int64)
        who, n = np.unique(pairs[0], return_counts=True)
        return pd.DataFrame({"short_key": who, "n": n})

    names, types = ["bucket", "keys", "counts", "grams"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    packed = docs.mapInArrow(pack, "bucket int, keys binary, counts binary, grams binary")
    return packed.groupBy("bucket").applyInPandas(count, "short_key long, n long").groupBy("short_key").agg(F.sum("n").alias("shared"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams once more as little-endian bytes, which are cheaper to move."""
    for batch in batches:
        packed = [g.values.to_numpy().astype("<i8").tobytes() for g in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], ["set_key", "n", "grams", "packed"])


def _ranked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """set_key, n, grams, packed: the n-grams that other sets have too, rarest first, of sets that have enough of them.

    An n-gram becomes the number (frequency, hash) in one integer, so integers sort rarest first.
    N-grams of one set only stand before all these and are but counted: n - size(grams).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sets(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(x) for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.view("i8") for x in found], pa.list_(pa.int64()))],
                ["set_key", "n", "grams"],
            )

    sets = materialise(docs.select("text").mapInArrow(run, "set_key binary, n long, grams array<long>"), "sets")
    grams = sets.select("set_key", "n", F.explode("grams").alias("gram"))
    frequency = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    number = F.shiftleft(F.least("df", F.lit(_RARE)), 48).bitwiseOR(F.col("gram").bitwiseAND(F.lit((1 << 48) - 1)))
    ranked = grams.join(frequency, "gram").groupBy("set_key", "n").agg(F.array_sort(F.collect_list(number)).alias("grams"))
    return materialise(ranked.where(F.size("grams") * 100 >= F.col("n") * percent).mapInArrow(_packed, "set_key binary, n long, grams array<long>, packed binary"), "ranked")


def _members(ranked: DataFrame, percent: int) -> DataFrame:
    """hub, set_key, n, shared, rest: the sets with a common prefix n-gram, by one of them.

    The hub of an n-gram is the set, of those that have it in their prefix, whose n-grams are
    shared the most. Two sets with a common prefix n-gram have a common hub, and most n-grams
    of a group of near copies have the same one, so a set has few hubs. shared counts the prefix
    n-grams by which a set has the hub; rest is how many n-grams it has from the first of these on,
    which bounds what it can share with a set that it first meets at this hub.
    """
    need = F.ceil(F.col("n") * percent / 100).cast("long")
    alone = F.col("n") - F.size("grams")
    take = (F.col("n") - need + 1 - alone).cast("int")
    rank = F.struct((F.size("grams") / F.col("n")).alias("share"), "set_key")
    prefix = ranked.where(take > 0).select("set_key", "n", rank.alias("rank"), F.size("grams").alias("m"), F.posexplode(F.slice("grams", F.lit(1), take)).alias("at", "gram"))
    rows = prefix.select("set_key", "n", "rank", "gram", (F.col("m") - F.col("at")).alias("rest"))
    hubs = rows.groupBy("gram").agg(F.max("rank").alias("hub"), F.count("*").alias("sets")).where("sets > 1").select("gram", F.col("hub.set_key").alias("hub"))
    met = rows.select("set_key", "n", "rest", "gram").join(hubs, "gram")
    return met.groupBy("hub", "set_key").agg(F.first("n").alias("n"), F.count("*").alias("shared"), F.max("rest").alias("rest"))


def _hamming(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """Lower bound of the number of n-grams in one of two sorted suffixes only, by splitting both at y's middle."""
    away = abs(len(x) - len(y))
    if not depth or not len(x) or not len(y) or away > most:
        return away
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    same = at < len(x) and x[at] == y[mid]
    left = _hamming(x[:at], y[:mid], most, depth - 1)
    if left + abs((len(x) - at - same) - (len(y) - mid - 1)) > most:
        return most + 1
    return left + _hamming(x[at + same :], y[mid + 1 :], most - left, depth - 1) + (not same)


def possible(n: np.ndarray, m: np.ndarray, n2: np.ndarray, m2: np.ndarray, percent: int) -> np.ndarray:
    """Length filter, and positional filter: nothing is shared before the first of the m n-grams that others have."""
    need = np.ceil((n + n2) * percent / (100 + percent) - 1e-9)
    return (n * 100 >= n2 * percent) & (n2 * 100 >= n * percent) & (np.minimum(m, m2) >= need)


def similar(x: np.ndarray, y: np.ndarray, n: int, n2: int, percent: int) -> bool:
    """All filters, then the exact test; x and y hold the n-grams of sets of n and n2 that others have."""
    if not possible(n, len(x), n2, len(y), percent):
        return False
    most = n + n2 - 2 * -(-(n + n2) * percent // (100 + percent)) - (n - len(x)) - (n2 - len(y))
    if most < 0 or _hamming(x, y, most, 2) > most:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (n + n2 - both)


def _star_links(members: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between each set and the hub with which it has the most prefix n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, n2, x, y = (batch.column(k) for k in range(6))
            held = [
                similar(np.frombuffer(x[k].as_py(), "<i8"), np.frombuffer(y[k].as_py(), "<i8"), n[k].as_py(), n2[k].as_py(), percent) for k in range(batch.num_rows)
            ]
            keep = pa.array(held, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    main = members.where("hub <> set_key").groupBy("set_key").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    one = ranked.select("set_key", "n", "packed")
    two = ranked.select(F.col("set_key").alias("hub"), F.col("n").alias("n2"), F.col("packed").alias("packed2"))
    # A hub goes once to each of so many tasks as its members fill, not with each of its members.
    main = materialise(main, "main_hubs")
    parts = materialise(main.groupBy("hub").agg(F.ceil(F.count("*") / 1000).cast("int").alias("parts")), "hub_parts")
    members = main.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int")).drop("parts")
    hubs = two.join(parts, "hub").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return members.join(one, "set_key").join(hubs, ["hub", "part"]).select(F.col("set_key").alias("u"), F.col("hub").alias("v"), "n", "n2", "packed", "packed2").mapInArrow(run, "u binary, v binary")


def _shared_with(own: np.ndarray, starts: np.ndarray, holders: np.ndarray, sets: int) -> np.ndarray:
    """How many of a set's n-grams (by number) each set has, from the lists of the sets that hold each n-gram."""
    sizes = starts[own + 1] - starts[own]
    at = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    return np.bincount(holders[at], minlength=sets)


def _unit_links(group: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Links within one group that join components, at most one less than it has sets.

    Pairs of one component are left out, and pairs that pass the positional filter at a smaller common
    hub too; so each pair is tested in one group. Sets of two units only meet those of the other. Length and positional
    filter compare a set with all others as arrays; the few pairs they leave are verified one by one behind
    the suffix filter, or, for a set with many, by counting along its n-grams' lists, with the same result.
    """
    hub = group["hub"].iloc[0]
    keys, component = group["set_key"].tolist(), pd.factorize(group["component"])[0]
    n, most = group["n"].to_numpy(), group["most"].to_numpy()
    grams = [np.frombuffer(g, "<i8") for g in group["packed"]]
    sides = group["unit"].to_numpy()
    two = (sides != sides[0]).any()
    hubs = [{h["hub"]: h["most"] for h in own if h["hub"] < hub} for own in group["hubs"]]
    links, parent = [], list(range(component.max() + 1))
    lists = None

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in np.flatnonzero(sides == sides[0]) if two else range(len(keys)):
        fits = (n <= most[a]) & (n[a] <= most) & (100 * n >= percent * n[a]) & (100 * n[a] >= percent * n) & (component != component[a])
        if two:
            fits &= sides != sides[0]
        else:
            fits[: a + 1] = False
        others = np.flatnonzero(fits)
        if len(others) > 8:
            if lists is None:
                ends = np.cumsum([len(g) for g in grams])
                number = np.unique(np.concatenate(grams), return_inverse=True)[1]
                order = np.argsort(number, kind="stable")
                starts = np.concatenate(([0], np.cumsum(np.bincount(number))))
                lists = number, np.concatenate(([0], ends)), starts, np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
            number, ends, starts, holders = lists
            both = _shared_with(number[ends[a] : ends[a + 1]], starts, holders, len(grams))[others]
            others = others[100 * both >= percent * (n[others] + n[a] - both)]
            verified = True
        else:
            verified = False
        for b in others:
            if root(component[a]) == root(component[b]) or any(n[b] <= most_a and n[a] <= hubs[b].get(h, -1) for h, most_a in hubs[a].items()):
                continue
            if verified or similar(grams[a], grams[b], int(n[a]), int(n[b]), percent):
                parent[root(component[a])] = root(component[b])
                links.append((keys[a], keys[b]))
    return links


def _rest_links(members: DataFrame, ranked: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (u, v) between sets of different components with a common prefix n-gram, found hub by hub.

    A hub's sets are dealt into units by size class and, beyond about ``block`` sets, by hash. Two units
    (or one with itself) are a group only if length and positional filter leave room for a pair between
    them, so a set is copied to the units it may have a partner in. In a large group of sets that
    are alike but can't reach the threshold, no two units meet.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["component"].nunique() == 1:
            return pd.DataFrame({"u": [], "v": []}, dtype=object)
        return pd.DataFrame(_unit_links(group, percent), columns=["u", "v"], dtype=object)

    # A set shares at most ``rest`` n-grams with one that it first meets here, so that has at most this size.
    most = F.floor(F.col("rest") * (100 + percent) / percent).cast("long") - F.col("n")
    members = materialise(members.withColumn("most", most).drop("shared", "rest"), "bounded")
    own = members.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    own = own.withColumn("size_class", F.floor(F.log(1.1, F.col("n"))).cast("long"))
    apart = own.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("hub")
    own = materialise(spread_join(own, apart, ["hub"], "set_key", 4), "members_apart")
    many = own.groupBy("hub", "size_class").agg(F.count("*").alias("sets"))
    placed = spread_join(own, many, ["hub", "size_class"], "set_key", 4)
    unit = F.col("size_class") * (1 << 40) + F.pmod(F.xxhash64("set_key"), F.ceil(F.col("sets") / block))
    placed = materialise(placed.withColumn("unit", unit).drop("size_class", "sets"), "placed")
    stats = materialise(
        placed.groupBy("hub", "unit").agg(
            F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.max("most").alias("most"), F.min("component").alias("low"), F.max("component").alias("high")
        ),
        "units",
    )
    a, b = (stats.select("hub", *[F.col(c).alias(f"{c}_{x}") for c in stats.columns[1:]]) for x in "ab")
    room = (F.col("min_n_a") <= F.col("most_b")) & (F.col("min_n_b") <= F.col("most_a"))
    room &= (F.col("max_n_a") * 100 >= F.col("min_n_b") * percent) & (F.col("max_n_b") * 100 >= F.col("min_n_a") * percent)
    room &= ~((F.col("low_a") == F.col("high_a")) & (F.col("low_b") == F.col("high_b")) & (F.col("low_a") == F.col("low_b")))
    pairs = materialise(a.join(b, "hub").where((F.col("unit_a") <= F.col("unit_b")) & room).select("hub", "unit_a", "unit_b"), "unit_pairs")
    sides = pairs.select("hub", F.col("unit_a").alias("unit"), "unit_a", "unit_b").unionByName(
        pairs.where("unit_a <> unit_b").select("hub", F.col("unit_b").alias("unit"), "unit_a", "unit_b")
    )
    hubs_of = members.groupBy("set_key").agg(F.collect_list(F.struct("hub", "most")).alias("hubs"))
    full = placed.join(sides, ["hub", "unit"]).join(ranked.select("set_key", "packed"), "set_key").join(hubs_of, "set_key")
    return full.groupBy("hub", "unit_a", "unit_b").applyInPandas(run, "u binary, v binary")


def ngram_join(
    docs: DataFrame, *, size: int = 5, percent: int = 75, block: int = 1000, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id.

    Documents link when their sets of distinct word n-grams have a Jaccard similarity of at
    least ``percent`` / 100; component_id is the smallest id reachable by links and class_id
    the smallest id with the same set. Steps:

    1. Documents with the same set are one class; only classes are joined.
    2. Classes that can't have a partner go: a set is kept only if enough of its n-grams are
       shared with any other set (``_maybe_shared``). That is prefix filtering with n-grams
       that a single set has as the rarest, done on packed 32-bit hashes. The keys of the sets
       left are broadcast if they are at most ``broadcast_rows`` (32 bytes each), so that texts
       stay where they are; beyond that the texts are shuffled once by id.
    3. The sets left are read again, their n-grams counted, and ordered rarest first. Sets with
       a common prefix n-gram meet at its hub (``_members``).
    4. Each set is tested against its main hub, which joins most near copies at a cost in
       proportion to their number. Then, hub by hub and in units of about ``block`` sets, pairs of
       sets that are not in one component yet are tested once each, behind length, positional and
       suffix filters, which also tell which units meet at all. Groups give back links that
       join components, never all pairs.

    Cases: null texts and texts without words have 0 n-grams and component themselves; with
    fewer words than ``size`` the whole sequence is the one n-gram; repeated rows share their
    class; a null id is only component_id where all ids of its component are null; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    batches_of(spark, 500)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    known = materialise(signatures(texts, size), "signatures")
    classes = known.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("short_key").alias("short_key")
    )
    classes = materialise(classes, "classes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (known.agg(F.sum("n_shingles")).first()[0] or 0) // 4_000_000)
    shared = _maybe_shared(texts, size, percent, buckets)
    enough = F.col("shared") >= F.greatest(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("n") / 4)) - 2)
    alive = materialise(classes.join(shared, "short_key").where(enough).select("set_key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")), "alive")
    few = F.broadcast(alive) if alive.count() <= broadcast_rows else alive
    # Null-safe, as the text of a class without ids has none.
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))
    ranked = _ranked(texts.join(few, same).dropDuplicates(["set_key"]).select("text"), size, percent)
    members = materialise(_members(ranked, percent), "members")
    links = materialise(_star_links(members, ranked, percent), "star_links")
    labels = materialise(connected_components(links), "labels")
    more = materialise(_rest_links(members, ranked, labels, percent, block), "rest_links")
    if not more.isEmpty():
        labels = materialise(connected_components(links.unionByName(more)), "labels")
    by_class = classes.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "class_id", F.coalesce("component", "set_key").alias("component"))
    lowest = by_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    by_class = by_class.join(lowest, "component").select("set_key", "class_id", "component_id")
    out = known.join(by_class, "set_key", "left")
    none = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    )
