"""A hierarchical Pitman-Yor language model over words, fitted and scored on all texts.

Every word is a context: its restaurant seats the words that follow it. All these restaurants
share one parent, the root, whose customers are their tables, over a uniform base. Dishes are the
frequent words (see ``least_count``), the end, and the class RARE; which rare word it is,
given RARE, is one more Pitman-Yor restaurant over all rare words, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialise
from .words import word_hashes

_LIMIT = 1024  # counts up to here have exact Stirling numbers
_EXACT = 1 << 20  # tables up to here are drawn one by one in the concentration's auxiliary variables
_DISH = 32  # bits of a dish
_JOINED = 1 << 18  # bytes of texts hashed in one go
START = 0  # the context of a text's first word


class Stirling:
    """Ratios S(c, t + 1) / S(c, t) of generalised Stirling numbers with discount d.

    Exact up to c = 1024. Beyond, S(c, t) depends on t / c ** d alone but for factors that don't change the
    ratio (its limit for large c), so the ratio at t is that of c = 1024 at the matching t, scaled as 1 / t.
    """

    def __init__(self, d: float) -> None:
        self.d = d
        rows = np.full((_LIMIT + 1, _LIMIT + 2), -np.inf)
        rows[1, 1] = 0.0
        t = np.arange(_LIMIT + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(1, _LIMIT):
                rows[c + 1, 1:] = np.logaddexp(rows[c, :-1], np.log(np.maximum(c - d * t[1:], 1e-300)) + rows[c, 1:])
                rows[c + 1, c + 2 :] = -np.inf
            ratio = rows[:, 1:] - rows[:, :-1]
        self.ratio = np.where(np.isfinite(ratio), ratio, -1e9)

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log of the ratio; t may lie between integers."""
        return self.of(c)(t)

    def of(self, c: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """The same as a function of t, for counts that are asked for many times."""
        start = np.minimum(c, _LIMIT).astype(np.int64) * self.ratio.shape[1]
        flat, far = self.ratio.ravel(), np.flatnonzero(c >= _LIMIT)  # below, t is its own matching one
        shrink = np.where(c[far] > _LIMIT, (_LIMIT / np.maximum(c[far], 1.0)) ** self.d, 1.0)

        def log_ratio(t: np.ndarray) -> np.ndarray:
            near = np.maximum(t, 1.0)
            near[far] = np.clip(t[far] * shrink, 1.0, _LIMIT - 1.0)
            near = np.minimum(near, _LIMIT - 1.0)
            low = near.astype(np.int64)
            at = start + low
            a, b = flat[at], flat[at + 1]
            mid = np.where(b < -1e8, a, a + (near - low) * (b - a))
            mid[far] += np.log(near[far]) - np.log(np.maximum(t[far], 1.0))
            return mid

        return log_ratio


def discount(one: float, two: float) -> float:
    """n1 / (n1 + 2 n2), kept within 0.05 to 0.95, where the model is well defined."""
    return float(np.clip(one / (one + 2 * two) if one else 0.05, 0.05, 0.95))


def concentration(theta: float, d: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator) -> float:
    """One draw with the auxiliary variables of Teh (2006), under a wide Gamma prior (shape 1, mean 100).

    The sum of the Bernoulli variables of tables beyond the first million of a restaurant, whose chances are tiny,
    is drawn as the Poisson variable with their mean.
    """
    used = customers > 1
    if not used.any():
        return float(max(1e-3, rng.gamma(1.0, 100.0)))
    x = rng.beta(theta + 1, customers[used] - 1)
    most = int(min(tables.max(initial=0), _EXACT))
    i = np.arange(1, max(most, 1))
    reach = len(tables) - np.searchsorted(np.sort(tables), i + 1)
    y = rng.binomial(reach, theta / (theta + d * i)).sum() if most > 1 else 0
    far = tables[tables > _EXACT]
    y += rng.poisson(np.log((theta + d * far) / (theta + d * _EXACT)) * theta / d).sum() if len(far) else 0
    return float(max(1e-3, rng.gamma(1 + y, 1 / (0.01 - np.log(np.maximum(x, 1e-300)).sum()))))


@dataclass
class Restaurants:
    """Restaurants of one level as cells (row, count): which restaurant, and how many customers one dish has there."""

    row: np.ndarray  # ascending
    counts: np.ndarray
    theta: float = 1.0
    d: float = 0.0
    mean_theta: float = 1.0  # over the sweeps after burn-in
    tables: np.ndarray = field(init=False)
    total: np.ndarray = field(init=False)  # tables of each restaurant

    def __post_init__(self) -> None:
        self.d = self.d or discount((self.counts == 1).sum(), (self.counts == 2).sum())
        self.tables = np.ones(len(self.counts), np.int64)
        self.customers, self.total = np.bincount(self.row, self.counts), np.bincount(self.row, self.tables)
        # One customer has one table, so only cells with more are moved.
        self.open = np.flatnonzero(self.counts > 1)
        c = self.counts[self.open]
        self.reach, self.stirling = 1 + (c ** (self.d / 2)).astype(np.int64), stirling_of(self.d).of(c)

    def sample(self, parent: np.ndarray, rng: np.random.Generator, *, steps: int = 3, move_theta: bool = True) -> None:
        """Gibbs over the tables of every dish given all others: Metropolis moves, all dishes of a step at once.

        parent: probability of each cell's dish in the parent. One customer has one table.
        """
        c, p, row, t = self.counts[self.open], parent[self.open], self.row[self.open], self.tables[self.open]
        for _ in range(steps):
            step = rng.integers(1, self.reach + 1) * (2 * rng.integers(0, 2, len(c)) - 1)
            to = t + step
            log_ratio = step * (self.stirling((t + to - 1) / 2) + np.log(np.maximum(self.theta + self.d * (self.total[row] + (step - 1) / 2), 1e-300) * p))
            moved = np.flatnonzero((to >= 1) & (to <= c) & (np.log(rng.random(len(c))) < log_ratio))
            self.total = self.total + np.bincount(row[moved], step[moved], len(self.total))
            t[moved] = to[moved]
        self.tables[self.open] = t
        if move_theta:
            self.theta = concentration(self.theta, self.d, self.customers, self.total, rng)

    def run(self, parent: np.ndarray, rng: np.random.Generator, *, sweeps: int, burn_in: int, move_theta: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Averages over the sweeps after burn-in: each cell's own part of its predictive probability, and each restaurant's weight of the parent.

        The predictive probability of a dish is own part + weight x the parent's.
        """
        own, weight, thetas = np.zeros(len(self.counts)), np.zeros(len(self.customers)), []
        for sweep in range(sweeps):
            self.sample(parent, rng, move_theta=move_theta)
            if sweep >= burn_in:
                whole = self.theta + self.customers
                own += (self.counts - self.d * self.tables) / whole[self.row]
                weight += (self.theta + self.d * self.total) / whole
                thetas.append(self.theta)
        self.mean_theta = float(np.mean(thetas))
        return own / (sweeps - burn_in), weight / (sweeps - burn_in)


_STIRLING: dict[float, Stirling] = {}


def stirling_of(d: float) -> Stirling:
    """The table for a discount rounded to 1/100, kept in the worker, as buckets come with nearly the same ones."""
    d = round(d, 2)
    if d not in _STIRLING:
        _STIRLING[d] = Stirling(d)
    return _STIRLING[d]


def fit_root(customers: np.ndarray, *, sweeps: int, burn_in: int, seed: int) -> np.ndarray:
    """The root's averaged predictive probability of each dish, given the tables that serve it in all contexts."""
    base, used = 1 / len(customers), np.flatnonzero(customers > 0)
    out = np.zeros(len(customers))
    if not len(used):
        return out + base
    root = Restaurants(np.zeros(len(used), np.int64), customers[used])
    own, weight = root.run(np.full(len(used), base), np.random.default_rng(seed), sweeps=sweeps, burn_in=burn_in)
    out[used] = own
    return out + weight[0] * base


def fit_rare(values: np.ndarray, times: np.ndarray, *, sweeps: int, burn_in: int, seed: int) -> tuple[np.ndarray, float]:
    """Averaged predictive probability of a rare word by its count (for each of values), and of unseen words together.

    times: how many words have each count. The base gives half to unseen words, the rest evenly to
    the others. Words of one count are alike, so how many of them have 1, 2, ... tables is one draw.
    """
    kinds, customers = times.sum(), float((values * times).sum())
    if not kinds:
        return np.zeros(0), 1.0
    rng = np.random.default_rng(seed)
    d, theta, base = discount(times[values == 1].sum(), times[values == 2].sum()), 1.0, 0.5 / kinds
    stirling = Stirling(d)
    ratios = [np.concatenate(([0.0], np.cumsum(stirling(np.full(v - 1, v), np.arange(1.0, v))))) for v in values]
    tables = float(kinds)
    total, unseen = np.zeros(len(values)), 0.0
    for sweep in range(sweeps):
        each = np.log((theta + d * tables) * base)
        drawn = np.zeros(len(values))
        for k, (logs, n) in enumerate(zip(ratios, times, strict=True)):
            odds = logs + each * np.arange(len(logs))
            odds = np.exp(odds - odds.max())
            drawn[k] = rng.multinomial(n, odds / odds.sum()) @ np.arange(1, len(logs) + 1)
        tables = float(drawn.sum())
        theta = concentration(theta, d, np.array([customers]), np.array([tables]), rng)
        if sweep >= burn_in:
            new = (theta + d * tables) / (theta + customers)
            total += (values - d * drawn / times) / (theta + customers) + new * base
            unseen += new * 0.5
    return total / (sweeps - burn_in), unseen / (sweeps - burn_in)


def hashed(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text; short texts are joined by a blank and hashed together, as calls cost more than their bytes."""
    held, n = [], 0
    for k, text in enumerate(texts):
        held.append(text or b"")
        n += len(held[-1]) + 1
        if n >= _JOINED or k == len(texts) - 1:
            hashes, begin, _ = word_hashes(b" ".join(held))
            yield from np.split(hashes, np.searchsorted(begin, np.cumsum([len(x) + 1 for x in held])[:-1]))
            held, n = [], 0


def _chunks(batches: Iterator[pa.RecordBatch], tokens: int = 500_000) -> Iterator[list[tuple[int, bool, np.ndarray]]]:
    """(key, train, word hashes) of texts, gathered over batches up to about so many tokens and at most 65,535 texts."""
    held, n = [], 0
    for batch in batches:
        keys, trains, texts = (batch.column(k).to_pylist() for k in range(3))
        for key, train, hashes in zip(keys, trains, hashed(texts), strict=True):
            held.append((key, train, hashes))
            n += len(hashes) + 1
            if n >= tokens or len(held) == 65_535:
                yield held
                held, n = [], 0
    if held:
        yield held


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, n: training count of every word (null: the end, one a training text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 2_000_000):
            train = [x for _, t, x in chunk if t]
            words, counts = np.unique(np.concatenate(train) if train else np.zeros(0, np.uint64), return_counts=True)
            mask = np.concatenate((np.zeros(len(words), bool), [True]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(words.view("i8"), 0), mask=mask), pa.array(np.append(counts, len(train)), pa.int64())], ["word", "n"]
            )

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Places:
    """Places of hashes among sorted distinct ones.

    Hashes are even, so one stands a few places behind the first with its leading bits; bisection would miss the cache
    at each step. The table of these first places is at most as long as the hashes.
    """

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        bits, span = max(1, len(known).bit_length() - 1), int(known[-1]) - int(known[0])
        self.shift = np.uint64(max(0, span.bit_length() - bits))
        steps = np.arange((span >> int(self.shift)) + 1, dtype=np.uint64)
        self.first = np.searchsorted(known, known[0] + (steps << self.shift))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The first place of a known hash that isn't smaller; for those beyond the last one, its place."""
        inside = np.clip(hashes, self.known[0], self.known[-1])
        at = self.first[(inside - self.known[0]) >> self.shift]
        behind = np.flatnonzero(self.known[at] < inside)
        while len(behind):
            at[behind] += 1
            behind = behind[self.known[at[behind]] < inside[behind]]
        return at


@dataclass
class Plan:
    """What tasks need to deal out tokens: frequent words, and contexts that are too frequent for one task."""

    words: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray  # training count of each dish
    buckets: int
    hot: np.ndarray  # sorted hashes of contexts with more tokens than a bucket
    salts: np.ndarray  # how many buckets each of these is dealt to

    def hot_bucket(self, k: int | np.ndarray) -> int | np.ndarray:
        """The first bucket of the k-th hot context."""
        return self.buckets + (np.cumsum(self.salts) - self.salts)[k]

    @cached_property
    def _places(self) -> Places:
        return Places(self.words)

    def dishes(self, hashes: np.ndarray) -> np.ndarray:
        """Dish of each word: 0 is the end, 1, 2, ... are words (sorted), the last is RARE."""
        if not len(self.words):
            return np.ones(len(hashes), np.int64)
        at = self._places(hashes)
        return np.where(self.words[at] == hashes, at + 1, len(self.words) + 1)

    def tokens(self, chunk: list, *, only_hot: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context, dish and text number of each token of a chunk, or of those with a hot context."""
        sizes = np.array([len(x) + 1 for _, _, x in chunk])
        ends = np.cumsum(sizes) - 1
        hashes = np.concatenate([x for _, _, x in chunk])
        is_end = np.zeros(sizes.sum(), bool)
        is_end[ends] = True
        context, word = np.full(len(is_end), START, np.uint64), np.zeros(len(is_end), np.uint64)
        word[~is_end] = hashes
        context[1:] = word[:-1]
        context[ends[:-1] + 1] = START
        text = np.repeat(np.arange(len(chunk)), sizes)
        if only_hot:
            keep = np.isin(context, self.hot)
            context, word, is_end, text = context[keep], word[keep], is_end[keep], text[keep]
        dish = np.zeros(len(word), np.uint32)
        dish[~is_end] = self.dishes(word[~is_end])
        return context, dish, text

    def rows(self, context: np.ndarray, salt: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, slice]]:
        """bucket, its contexts, their sizes and place, of sorted contexts; a hot context is a bucket of its own, by salt."""
        starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        ends = np.append(starts[1:], len(context))
        each = context[starts]
        bucket = ((each >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        at = np.searchsorted(self.hot, each)
        is_hot = self.hot[np.minimum(at, len(self.hot) - 1)] == each if len(self.hot) else np.zeros(len(each), bool)
        for k in np.flatnonzero(is_hot):
            yield int(self.hot_bucket(at[k]) + salt % int(self.salts[at[k]])), each[k : k + 1], ends[k : k + 1] - starts[k : k + 1], slice(starts[k], ends[k])
        # Hot contexts split their neighbours' buckets into several rows.
        edges = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | is_hot[1:] | is_hot[:-1]))) if len(each) else []
        for a, b in zip(edges, np.append(edges[1:], len(each)), strict=True):
            if not is_hot[a]:
                yield int(bucket[a]), each[a:b], ends[a:b] - starts[a:b], slice(starts[a], ends[b - 1])


def planes(numbers: np.ndarray, kind: str) -> bytes:
    """Whole numbers as bytes, all first bytes, then all second bytes and so on: small numbers become runs of zeros, which shuffles compress."""
    return np.ascontiguousarray(numbers, kind).view("u1").reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def unplaned(parts: Iterable[bytes], kind: str) -> np.ndarray:
    """The numbers of several ``planes``, one after the other."""
    width = np.dtype(kind).itemsize
    found = [np.ascontiguousarray(np.frombuffer(p, "u1").reshape(width, -1).T).view(kind).ravel() for p in parts]
    return np.concatenate(found) if found else np.zeros(0, kind)


PACKED = "chunk long, bucket long, contexts binary, sizes binary, dishes binary, counts binary, texts binary, keys binary, train binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(columns)], _NAMES)


def _packed(texts: DataFrame, shared: Broadcast[Plan], *, with_texts: bool) -> DataFrame:
    """Tokens of all texts by bucket of their context: with the texts they are in, or summed (training texts without hot contexts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for number, chunk in enumerate(_chunks(batches)):
            chunk = chunk if with_texts else [x for x in chunk if x[1]]
            if not chunk:
                continue
            name = TaskContext.get().partitionId() << 32 | number
            context, dish, text = own.tokens(chunk)
            keys = np.array([k for k, _, _ in chunk], "<i8")
            train = np.array([t for _, t, _ in chunk], bool)
            if with_texts:
                # By context and place; whole numbers are sorted faster than their places are.
                order = np.sort(ranks(context)[1] << 32 | np.arange(len(context))) & 0xFFFFFFFF
                context, dish, text = context[order], dish[order], text[order]
            else:
                context, dish, counts = summed(context, dish)
            # The keys of a chunk's texts go in one row of their own; rows of tokens number them.
            rows = [(name, -1 - name, b"", b"", b"", b"", b"", keys.tobytes(), b"")] if with_texts else []
            for bucket, contexts, sizes, at in own.rows(context, int(keys[0])):
                if with_texts:
                    there = np.zeros(len(chunk), bool)
                    there[text[at]] = True
                    who, place = np.flatnonzero(there), (np.cumsum(there) - 1)[text[at]]
                    rows.append((name, bucket, contexts.tobytes(), planes(sizes, "<u4"), planes(dish[at], "<u4"), b"", planes(place, "<u2"), who.astype("<u2").tobytes(), train[who].tobytes()))
                elif bucket < own.buckets:
                    rows.append((name, bucket, contexts.tobytes(), planes(sizes, "<u4"), planes(dish[at], "<u4"), planes(counts[at], "<u4"), b"", b"", b""))
            yield _batch(rows)

    return texts.mapInArrow(run, PACKED)


def firsts(values: np.ndarray) -> np.ndarray:
    """Where each distinct one of sorted values begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))[: len(values)])


def ranks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the place of each of ``hashes`` among them."""
    each = np.sort(hashes)
    each = each[firsts(each)]
    return each, Places(each)(hashes) if len(each) else np.zeros(0, np.int64)


def summed(context: np.ndarray, dish: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, dish), sorted, with the sums of their counts, by default 1 each."""
    each, number = ranks(context)
    cell = number.astype(np.int64) << _DISH | dish
    if counts is None:
        cell = np.sort(cell)
        starts = firsts(cell)
        cell, sums = cell[starts], np.diff(np.append(starts, len(cell)))
    else:
        cell, place = np.unique(cell, return_inverse=True)
        sums = np.bincount(place, counts, len(cell)).astype(np.int64)
    return each[cell >> _DISH], (cell & ((1 << _DISH) - 1)).astype(np.uint32), sums


def _hot_cells(texts: DataFrame, shared: Broadcast[Plan]) -> DataFrame:
    """Summed cells of each hot context in one packed row (at most as many as there are dishes); Spark sums them by context and dish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for chunk in _chunks(batches):
            chunk = [x for x in chunk if x[1]]
            if not chunk:
                continue
            context, dish, _ = own.tokens(chunk, only_hot=True)
            context, dish, counts = summed(context, dish)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(own.hot, context)), pa.array(dish.astype("i8")), pa.array(counts)], ["hot", "dish", "n"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("dish")
        k, own = int(group["hot"].iloc[0]), shared.value
        row = (0, int(own.hot_bucket(k)), own.hot[k : k + 1].tobytes(), planes(np.array([len(group)]), "<u4"), planes(group["dish"].to_numpy(), "<u4"), planes(group["n"].to_numpy(), "<u4"), b"", b"", b"")
        return pd.DataFrame([row], columns=_NAMES)

    cells = texts.mapInArrow(run, "hot long, dish long, n long").groupBy("hot", "dish").agg(F.sum("n").alias("n"))
    return cells.groupBy("hot").applyInPandas(pack, PACKED)


def _cells(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, dish and count (for tokens none) of all tokens or cells in packed rows."""
    context = np.repeat(np.frombuffer(b"".join(group["contexts"]), "<u8"), unplaned(group["sizes"], "<u4"))
    return context, unplaned(group["dishes"], "<u4"), unplaned(group["counts"], "<u4")


def _tables(cells: DataFrame, shared: Broadcast[Plan], *, sweeps: int, burn_in: int, seed: int) -> DataFrame:
    """dish, tables, and for dish -1, -2: cells with one and with two customers, -3: concentration times customers and -4: customers."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        context, dish, counts = summed(*_cells(group))
        starts = firsts(context)
        level = Restaurants(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context)))), counts)
        base = (shared.value.counts + 0.5) / (shared.value.counts + 0.5).sum()
        level.run(base[dish], np.random.default_rng([seed, int(group["bucket"].iloc[0])]), sweeps=sweeps, burn_in=burn_in)
        served, place = np.unique(dish, return_inverse=True)
        stats = {-1: (counts == 1).sum(), -2: (counts == 2).sum(), -3: level.mean_theta * counts.sum(), -4: counts.sum()}
        return pd.DataFrame({"dish": [*served.tolist(), *stats], "tables": [*np.bincount(place, level.tables).tolist(), *map(float, stats.values())]})

    return cells.groupBy("bucket").applyInPandas(run, "dish long, tables double").groupBy("dish").agg(F.sum("tables").alias("tables"))


def _context_scores(tokens: DataFrame, hot_cells: DataFrame, plan: Plan, root: np.ndarray, d: float, theta: float, *, sweeps: int, burn_in: int, seed: int) -> DataFrame:
    """key, class_score: log10 probability of the dishes of each text, summed over its buckets.

    A bucket answers each chunk of texts with one packed row, and a chunk's answers are summed by text, so rows are
    as many as texts, not texts times buckets.
    """

    def run(tokens: pd.DataFrame, hot: pd.DataFrame) -> pd.DataFrame:
        root = shared.value
        if not len(tokens):
            return pd.DataFrame([], columns=names)
        if tokens["bucket"].iloc[0] < 0:
            return pd.DataFrame({"chunk": tokens["chunk"], "texts": b"", "keys": tokens["keys"], "sums": b""}, columns=names)
        context, dish, _ = _cells(tokens)
        # The number of each token's text, by rows of tokens; each row numbers its own texts.
        texts = [unplaned([x], "<u2") for x in tokens["texts"]]
        train = np.concatenate([np.frombuffer(t, bool)[x] for t, x in zip(tokens["train"], texts, strict=True)])
        # A hot context's tokens are in several buckets, each of which is given the whole restaurant's cells.
        cells = summed(*_cells(hot)) if len(hot) else summed(context[train], dish[train])
        starts = firsts(cells[0])
        each, row = cells[0][starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cells[0]))))
        score = np.log10(root[dish])
        if len(each):
            level = Restaurants(row, cells[2], theta, d)
            # All buckets of a hot context draw the same seating.
            bucket = int(hot["first"].iloc[0] if len(hot) else tokens["bucket"].iloc[0])
            part, weight = level.run(root[cells[1]], np.random.default_rng([seed, bucket]), sweeps=sweeps, burn_in=burn_in, move_theta=False)
            at = Places(each)(context)
            met = each[at] == context
            known = row.astype(np.int64) << _DISH | cells[1]
            cell = at << _DISH | dish
            place = np.searchsorted(known, cell)
            place[place == len(known)] = 0
            seen = met & (known[place] == cell)
            score = np.log10(np.where(seen, part[place], 0.0) + np.where(met, weight[at], 1.0) * root[dish])
        ends = np.cumsum([len(x) for x in texts])[:-1]
        sums = [np.bincount(x, part, len(k) // 2).tobytes() for x, part, k in zip(texts, np.split(score, ends), tokens["keys"], strict=True)]
        return pd.DataFrame({"chunk": tokens["chunk"], "texts": tokens["keys"], "keys": b"", "sums": sums}, columns=names)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        who, place = np.unique(np.frombuffer(b"".join(group["keys"]), "<i8"), return_inverse=True)
        each = np.bincount(np.frombuffer(b"".join(group["texts"]), "<u2"), np.frombuffer(b"".join(group["sums"]), "<f8"), len(place))
        return pd.DataFrame({"key": who, "class_score": np.bincount(place, each, len(who))})

    names = ["chunk", "texts", "keys", "sums"]
    shared = tokens.sparkSession.sparkContext.broadcast(root)
    # A hot context's restaurant goes to each of its buckets; there are at most as many as buckets.
    ranges = [(int(plan.hot_bucket(k)), int(plan.hot_bucket(k) + n - 1)) for k, n in enumerate(plan.salts)]
    ranges = tokens.sparkSession.createDataFrame(ranges, "first long, last long")
    copies = hot_cells.withColumnRenamed("bucket", "first").join(F.broadcast(ranges), "first").withColumn("bucket", F.explode(F.sequence("first", "last")))
    answers = tokens.groupBy("bucket").cogroup(copies.groupBy("bucket")).applyInPandas(run, "chunk long, texts binary, keys binary, sums binary")
    scored = answers.groupBy("chunk").applyInPandas(add, "key long, class_score double")
    return scored.groupBy("key").agg(F.sum("class_score").alias("class_score"))


RARE = "chunk long, bucket long, keys binary, train binary, sizes binary, hashes binary, times binary"
EACH = np.dtype([("key", "<i8"), ("n_tokens", "<i8"), ("class_base", "<f8"), ("class_known", "<i8")])


def _rare_counts(texts: DataFrame, shared: Broadcast[Plan]) -> DataFrame:
    """Rows of packed arrays, by range of word hashes: of each text, the training counts of its rare words.

    Each chunk of texts sends, per bucket, the texts' distinct rare words and how often they come; a
    bucket sums the training counts of its words and answers with counts in place of words.
    kind 0: keys, sizes (rare words of each text), counts, times. kind 1: counts, times (words that have them).
    kind 2, a chunk's own row: keys holds EACH of every text, its tokens, and over frequent words and the end the base and how many are known.
    A rare word has under ``least_count`` training tokens, so none is hot in the training texts.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        base, known = np.log10(own.counts + 0.5), own.counts > 0
        base[-1], known[-1] = 0.0, False
        for number, chunk in enumerate(_chunks(batches)):
            name = TaskContext.get().partitionId() << 32 | number
            keys, train = np.array([k for k, _, _ in chunk], "<i8"), np.array([t for _, t, _ in chunk], bool)
            _, dish, text = own.tokens(chunk)
            starts = firsts(text)
            sums = [x.sum() for x in np.split(base[dish], starts[1:])]
            each = np.array(list(zip(keys, np.diff(np.append(starts, len(text))), sums, np.add.reduceat(known[dish], starts, dtype=np.int64), strict=True)), EACH)
            # Distinct rare words of each text, by text and hash.
            is_word = np.append(text[1:] == text[:-1], False)
            words, rare = np.concatenate([x for _, _, x in chunk]), dish[is_word] == len(own.words) + 1
            kinds, number = ranks(words[rare])
            cell = np.sort(text[is_word][rare] << 32 | number)
            starts = firsts(cell)
            hashes, owner, times = kinds[cell[starts] & 0xFFFFFFFF], cell[starts] >> 32, np.diff(np.append(starts, len(cell)))
            bucket = ((hashes >> np.uint64(32)) * np.uint64(own.buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            present, starts = np.unique(bucket[order], return_index=True)
            rows = [(name, -1 - name, each.tobytes(), b"", b"", b"", b"")]
            for b, at in zip(present.tolist(), np.split(order, starts[1:]), strict=False):
                who, sizes = np.unique(owner[at], return_counts=True)
                small = times[at].max() < 256
                rows.append((name, b, keys[who].tobytes(), train[who].tobytes(), sizes.astype("<u4").tobytes(), hashes[at].tobytes(), times[at].astype("u1" if small else "<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] < 0:
            return pd.DataFrame([(2, 0, k, b"", b"", b"") for k in group["keys"]], columns=told)
        sizes_of = [len(h) // 8 for h in group["hashes"]]
        times = np.concatenate([np.frombuffer(t, "u1" if len(t) == n else "<u4") for t, n in zip(group["times"], sizes_of, strict=True)])
        keys, train = np.frombuffer(b"".join(group["keys"]), "<i8"), np.frombuffer(b"".join(group["train"]), bool)
        sizes, hashes = np.frombuffer(b"".join(group["sizes"]), "<u4"), np.frombuffer(b"".join(group["hashes"]), "<u8")
        kinds, place = np.unique(hashes, return_inverse=True)
        seen = np.bincount(place, times * np.repeat(train, sizes), len(kinds)).astype("<u4")
        values, many = np.unique(seen[seen > 0], return_counts=True)
        out = [(1, 0, b"", b"", values.astype("<u4").tobytes(), many.astype("<u4").tobytes())]
        counts = np.split(seen[place], np.cumsum(sizes_of)[:-1])
        out += [(0, c, k, s, x.tobytes(), t) for c, k, s, x, t in zip(group["chunk"], group["keys"], group["sizes"], counts, group["times"], strict=True)]
        return pd.DataFrame(out, columns=told)

    told = ["kind", "chunk", "keys", "sizes", "counts", "times"]
    names = [x.split()[0] for x in RARE.split(", ")]
    return texts.mapInArrow(pack, RARE).groupBy("bucket").applyInPandas(answer, "kind int, chunk long, keys binary, sizes binary, counts binary, times binary")


def _rare_scores(packed: DataFrame, values: np.ndarray, logs: np.ndarray, unseen: float) -> DataFrame:
    """key, rare_score, rare_base (sum of log10 of count + 0.5) and rare_known, summed by text over the answers to its chunk."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values, logs, unseen = shared.value
        parts = []
        for r in group.itertuples(index=False):
            sizes, counts = np.frombuffer(r.sizes, "<u4"), np.frombuffer(r.counts, "<u4")
            times = np.frombuffer(r.times, "u1" if len(r.times) == len(counts) else "<u4")
            at = np.searchsorted(values, counts)
            score = np.where(counts > 0, logs[np.minimum(at, len(logs) - 1)] if len(logs) else 0.0, unseen) * times
            starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[:-1]
            each = (score, np.log10(counts + 0.5) * times, (counts > 0) * times.astype(np.int64))
            parts.append((np.frombuffer(r.keys, "<i8"), *(np.add.reduceat(x, starts) for x in each)))
        keys, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
        who, place = np.unique(keys, return_inverse=True)
        score, base, known = (np.bincount(place, x, len(who)) for x in sums)
        return pd.DataFrame({"key": who, "rare_score": score, "rare_base": base, "rare_known": known.astype(np.int64)})

    shared = packed.sparkSession.sparkContext.broadcast((values, logs, unseen))
    rows = packed.where("kind = 0").drop("kind").groupBy("chunk").applyInPandas(run, "key long, rare_score double, rare_base double, rare_known long")
    return rows.groupBy("key").agg(F.sum("rare_score").alias("rare_score"), F.sum("rare_base").alias("rare_base"), F.sum("rare_known").alias("rare_known"))


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for keys in batch["keys"]:
            yield pd.DataFrame(np.frombuffer(keys, EACH))


def score_texts(
    docs: DataFrame,
    held_out: Column,
    *,
    least_count: int = 5,
    bucket_tokens: int = 750_000,
    sweeps: int = 12,
    burn_in: int = 4,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    1. Training counts of all words, with partial sums in the tasks.
    2. Frequent words (``least_count`` in the training texts, however many tokens these have) are dishes of their
       own, all others the dish RARE. Their hashes, counts and root's probabilities, 24 bytes a word, are broadcast.
    3. Every word, rare or not, is a context. Tokens of training texts are summed by (context, dish) and
       dealt to tasks by context, about ``bucket_tokens`` each; there the restaurants are seated by Gibbs
       sweeps, and the tables of each dish become the customers of the root, which is seated next.
    4. Restaurants are seated again under that root, and the tokens of all texts, dealt in the same way,
       get their probabilities, averaged over the sweeps after ``burn_in``.
    5. Which rare word it is comes from a restaurant of all rare words (``fit_rare``).

    Contexts with more tokens than a bucket are summed by Spark, and their tokens are scored in several
    buckets, each of which is given the restaurant (bounded by the number of dishes).

    As in the base, all unseen words count as one word, so ``score`` is a probability over known words, the
    unseen word and the end.

    Cases: null text is empty, so it is one end; a null in ``held_out`` counts as training;
    repeated rows each count and are each scored; without training texts the base is 0 for
    each token and the model uniform; an empty table gives no rows.
    """
    spark = docs.sparkSession
    batches_of(spark, 500)
    out = F.coalesce(held_out, F.lit(False))
    ids = F.col(id_col).cast("long")
    texts = docs.select(F.xxhash64(ids, F.col(text_col)).alias("key"), (~out).alias("train"), F.col(text_col).cast("binary").alias("text"), ids.alias("doc_id"))
    vocabulary = materialise(_word_counts(texts), "words")
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds")).first()
    n, kinds = sums["n"] or 0, sums["kinds"] or 0
    ends = vocabulary.where("word is null").agg(F.sum("n")).first()[0] or 0
    # As Arrow, 16 bytes a word; rows of Python objects would take some hundred.
    top = vocabulary.where((F.col("n") >= least_count) & F.col("word").isNotNull()).toArrow()
    words = top["word"].to_numpy().view("u8")
    order = np.argsort(words)
    words, many = words[order], top["n"].to_numpy()[order]
    counts = np.concatenate(([ends], many, [max(0, n - ends - many.sum())]))
    hot = np.sort(np.append(words[many > bucket_tokens], np.zeros(int(ends > bucket_tokens), np.uint64)))
    # At least 32 buckets to share the work, as long as each has enough tokens to tell a concentration.
    buckets = max(1, -(-n // bucket_tokens), min(32, n // 50_000))
    often = dict(zip(words[many > bucket_tokens].tolist(), many[many > bucket_tokens].tolist(), strict=True)) | {START: ends}
    plan = Plan(words, counts, buckets, hot, np.array([-(-often[h] // bucket_tokens) for h in hot.tolist()], np.int64))
    shared = spark.sparkContext.broadcast(plan)  # one for all steps, as each lies on every executor's disk
    hot_cells = materialise(_hot_cells(texts, shared), "hot_cells") if len(hot) else spark.createDataFrame([], PACKED)
    chain = {"sweeps": sweeps, "burn_in": burn_in, "seed": seed}
    served = _tables(_packed(texts, shared, with_texts=False).unionByName(hot_cells), shared, **chain).toArrow()
    dish, tables = served["dish"].to_numpy(), served["tables"].to_numpy()
    stats = [float(tables[dish == k].sum()) for k in (-1, -2, -3, -4)]
    customers = np.zeros(len(counts), np.int64)
    customers[dish[dish >= 0]] = tables[dish >= 0]
    root = fit_root(customers, **chain)
    d, theta = discount(stats[0], stats[1]), stats[2] / stats[3] if stats[3] else 1.0
    contexts = _context_scores(_packed(texts, shared, with_texts=True), hot_cells, plan, root, d, theta, **chain)
    packed = materialise(_rare_counts(texts, shared), "rare")
    seen = packed.where("kind = 1").select("counts", "times").mapInPandas(_unpacked, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).toPandas().sort_values("value")
    values, times = seen["value"].to_numpy(np.int64), seen["n"].to_numpy(np.int64)
    rare, unseen = fit_rare(values, times, **chain)
    rare_scores = _rare_scores(packed, values, np.log10(rare), float(np.log10(unseen)))
    below = float(np.log10(n + 0.5 * (kinds + 1)))
    # Rows that are equal share a key, so what is told of them is summed together.
    each = packed.where("kind = 2").select("keys").mapInPandas(_each, "key long, n_tokens long, class_base double, class_known long")
    copies = each.groupBy("key").agg(F.count("*").alias("copies"), F.first("n_tokens").alias("n_tokens"), F.sum("class_base").alias("class_base"), F.sum("class_known").alias("class_known"))
    told = copies.join(contexts, "key").join(rare_scores, "key", "left")
    part = lambda name: F.coalesce(F.col(name) / F.col("copies"), F.lit(0.0))
    rows = texts.select("key", "doc_id", (~F.col("train")).alias("held_out"))
    scored = rows.join(materialise(told, "told"), "key").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (part("class_known") + part("rare_known")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (part("class_base") + part("rare_base") - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (part("class_score") + part("rare_score")).alias("score"),
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for counts, times in zip(batch["counts"], batch["times"], strict=True):
            yield pd.DataFrame({"value": np.frombuffer(counts, "<u4").astype("i8"), "n": np.frombuffer(times, "<u4").astype("i8")})
