"""The stored indexes against full scans."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.operators import bitmaps, paging, text_index, vector_index
from lawloom.operators.retrieve import terms, top, vector_top
from lawloom.operators.text_index import STOP, Analyzer, TextIndex, query_terms, stem
from lawloom.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors around 40 middles; a third of all are one vector; nulls, zeros and a row without id."""
    r = random.Random(4)
    middles = [[r.gauss(0, 1) for _ in range(24)] for _ in range(40)]
    rows = [(f"k{i}", [m + r.gauss(0, 1.2) for m in middles[i % 40]]) for i in range(2000)] + [(f"h{i}", middles[3]) for i in range(1000)]
    rows += [("n1", None), ("n2", [0.0] * 24), (None, middles[0]), ("n3", [None] * 24), ("n4", [math.nan] * 24)]
    return spark.createDataFrame(rows, "id string, content_vector array<float>").repartition(6).cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('vectors')}/index"
    vector_index.build(vectors, path, lists=50)
    return VectorIndex(spark, path)


def asked(vectors):
    sampled = vectors.where("id rlike '^[kh][0-9]*0$'").select(F.col("id").alias("query_id"), F.col("content_vector").alias("vector"))
    return sampled.unionAll(vectors.where("id in ('n1', 'n2', 'n3')"))


def found(df):
    return {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in df.collect()}


def scanned(vectors, k):
    whole = vectors.where("id is not null and id not like 'n%'")
    return found(vector_top(whole, asked(vectors).where("query_id not like 'n%'"), k))


def test_a_task_hands_on_its_best_only(spark, vectors):
    from lawloom.operators import retrieve

    r = random.Random(9)
    docs = spark.createDataFrame([(n, [r.gauss(0, 1) for _ in range(8)]) for n in range(1000)] + [(1000, [math.nan] * 8)], "id long, v array<float>").coalesce(1)
    few = docs.limit(5).withColumnRenamed("v", "vector").collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = retrieve._nearest(docs, few, 3, 8).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # However many batches and tiles a task reads.
    assert len(got) == 15
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    own = np.array([unit(x.v) for x in docs.where("id < 1000").orderBy("id").collect()])
    for n, q in enumerate(few):
        assert {x.id for x in got if x.q == n} == set(np.argsort(-(own @ unit(q.vector)))[:3].tolist())


def test_all_vectors_are_indexed_in_pieces(index):
    assert index.pieces.agg(F.sum(F.size("ids"))).first()[0] == 3000
    assert index.pieces.agg(F.max(F.size("ids"))).first()[0] < 1.3 * vector_index.PIECE


def test_recall(index, vectors):
    got, want = found(index.search(asked(vectors), 10)), scanned(vectors, 10)
    # Copies of one vector tie: what counts is the cosine reached at each rank.
    reached = sum(k in got and got[k][1] >= s - 1e-9 for k, (_, s) in want.items())
    assert reached >= 0.9 * len(want) and len(got) == len(want)


def test_more_probes_find_more(index, vectors):
    def hit(probes):
        got, want = found(index.search(asked(vectors), 10, probes=probes)), scanned(vectors, 10)
        return sum(k in got and got[k][1] >= s - 1e-9 for k, (_, s) in want.items()) / len(want)

    one, all_lists = hit(1), hit(len(index.model.centroids))
    assert one < all_lists and all_lists > 0.99


@pytest.mark.parametrize("k,probes", [(10, None), (10, 1), (2500, None)])
def test_exact(index, vectors, k, probes, monkeypatch):
    monkeypatch.setattr(vector_index, "HELD", 1000)
    if k > 100:
        monkeypatch.setattr(vector_index, "BLOCK", 64)
    assert found(index.search_exact(asked(vectors), k, probes=probes)) == scanned(vectors, k)


def test_unprobed_lists_are_pruned(index, vectors):
    wanted = np.zeros((1, len(index.model.centroids)), bool)
    wanted[0, 2] = True
    scan = index._scored(wanted, np.ones((1, 24)), 5, by_code=True, least=np.array([-np.inf]))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "(list#" in plan and "vectors" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert {r.list for r in scan.collect()} == {2}


def test_codes_and_errors(index):
    """A decoded vector is off by exactly the error that is kept, so the bound of the exact search holds."""
    x = vector_index.units(np.random.default_rng(0).normal(size=(300, 24)))
    of = vector_index.nearest(x, index.model.centroids)
    codes, errors = index.model.encode(x, of)
    assert np.allclose(np.linalg.norm(index.model.decode(codes, of) - x, axis=1), errors)
    assert errors.mean() < np.linalg.norm(x - index.model.centroids[of], axis=1).mean()


def test_short_vectors_and_one_row(spark, tmp_path):
    docs = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0, 2.0]), (3, [1.0])], "id long, content_vector array<double>")
    vector_index.build(docs, f"file://{tmp_path}/a")
    queries = spark.createDataFrame([(7, [3.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 12.0]), (8, [1.0])], "query_id long, vector array<double>")
    got = found(VectorIndex(spark, f"file://{tmp_path}/a").search_exact(queries, 2))
    assert got == {(7, 1): (1, round(5 / 13, 9)), (7, 2): (3, round(3 / 13, 9)), (8, 1): (3, 1.0), (8, 2): (1, 0.6)}
    with pytest.raises(ValueError):
        vector_index.build(docs.where("id > 5"), f"file://{tmp_path}/b")


WORDS = ["statute", "statutes", "law", "laws", "city", "cities", "the", "of", "zone", "zoning", "bus", "glass", "fee", "fees", "river", "park", "bridges"]


def plain_words(text):
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (text or "").lower()).split()


def plain_terms(text):
    return [t for w in plain_words(text) if w not in STOP and (t := stem(w))]


def plain_scores(docs, weights, queries):
    fields = {f: [plain_terms(d[f]) for d in docs] for f in weights}
    lengths = {f: [len(plain_words(d[f])) for d in docs] for f in weights}
    means = {f: sum(n) / len(docs) for f, n in lengths.items()}
    x = [{} for _ in docs]
    for f, w in weights.items():
        for n, terms in enumerate(fields[f]):
            for t in terms:
                x[n][t] = x[n].get(t, 0) + w / (0.25 + 0.75 * lengths[f][n] / (means[f] or 1))
    out = {}
    for q, text in queries:
        scores = []
        for n, own in enumerate(x):
            s = 0.0
            for t in set(plain_terms(text)) & set(own):
                df = sum(t in d for d in x)
                s += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * own[t] * 2.2 / (own[t] + 1.2)
            if set(plain_terms(text)) & set(own):
                scores.append((-round(s, 6), docs[n]["id"]))
        out[q] = sorted(scores)
    return out


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(8)
    docs = [{"id": f"d{i:05}", "title": r.choice([None, "", " ".join(r.choices(WORDS, k=3))]), "content": " ".join(r.choices(WORDS, [1 / (n + 1) for n in range(len(WORDS))], k=r.randint(0, 40)))} for i in range(2500)]
    docs += [{"id": f"e{i:05}", "title": "park", "content": "The common LAW of rivers."} for i in range(1200)]
    docs += [{"id": "x1", "title": None, "content": None}, {"id": "x2", "title": "Ünïcode-bridges", "content": "bridges' " * 30000}]
    return docs, spark.createDataFrame([(d["id"], d["title"], d["content"], 1, "c", 2) for d in docs], "id string, title string, content string, n long, range string, bucket int").repartition(7)


@pytest.mark.parametrize("first,span", [(1, 600), (100, 1_000_000)])
def test_text_search_equals_a_full_scan(spark, texts, tmp_path, first, span, monkeypatch):
    monkeypatch.setattr(text_index, "SPAN", span)
    monkeypatch.setattr(text_index, "BITS", 7)
    monkeypatch.setattr(text_index, "BLOCK", 4)
    docs, table = texts
    weights = {"content": 1.0, "title": 2.0}
    text_index.build(table, f"file://{tmp_path}/t", weights)
    queries = [(1, "bridges over the river"), (2, "law"), (3, "zoning fee fees"), (4, "the of"), (5, None), (6, "nothing known"), (7, "glass bus statutes parks and city laws")]
    got = TextIndex(spark, f"file://{tmp_path}/t").search(spark.createDataFrame(queries, "query_id long, text string"), 10, first=first).collect()
    want = plain_scores(docs, weights, queries)
    for q, _ in queries:
        own = sorted((r.rank, r.id, r.score) for r in got if r.query_id == q)
        assert [(n, i) for n, i, _ in own] == [(n, i) for n, (_, i) in enumerate(want[q][:10], 1)]
        assert [s for *_, s in own] == pytest.approx([-s for s, _ in want[q][:10]], abs=2e-6)


def test_bounds_hold_and_pass_over_ranges(spark, tmp_path, monkeypatch):
    """A rare pair of words in one range: the bounds of the others are too low, and no document of theirs is scored."""
    monkeypatch.setattr(text_index, "BITS", 9)
    docs = spark.range(0, 20_000, 1, 4).select(F.col("id"), F.when(F.col("id") == 7777, "common needle haystack").otherwise("common words").alias("content"))
    text_index.build(docs, f"file://{tmp_path}/t", {"content": 1.0})
    index, queries = TextIndex(spark, f"file://{tmp_path}/t"), spark.createDataFrame([(1, "common needle haystack")], "query_id long, text string")
    known = index._asked(queries)
    bounds = index.bounds(known).collect()
    ranges = spark.createDataFrame([(r.range,) for r in bounds], "range long")
    best = {r.range: r.s for r in index._scores(known, ranges, 3).groupBy("range").agg(F.max("score").alias("s")).collect()}
    assert len(bounds) > 30 and all(r.bound >= best[r.range] for r in bounds)
    assert sum(r.bound >= max(best.values()) for r in bounds) == 1
    assert index._scores(known, ranges, 3, {1: max(best.values())}).select("range").distinct().count() == 1
    assert index.search(queries, 1).first().id == 7777


def test_blocks_of_a_range_stay_together(spark, tmp_path, monkeypatch):
    """Copies of a text tie in many ranges, whose blocks are read by many tasks; which ranges to score is known late, so that join turns into a broadcast as it runs."""
    monkeypatch.setattr(text_index, "BITS", 5)
    texts = [" ".join(f"word{(n + i) % 40}" for i in range(6)) for n in range(40)]
    docs = spark.createDataFrame([(c * 40 + n if c + n else None, t) for c in range(30) for n, t in enumerate(texts)], "id long, content string").repartition(3)
    text_index.build(docs, f"file://{tmp_path}/t", {"content": 1.0})
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in settings}

    def late(batches):
        time.sleep(6)
        yield from batches

    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        index = TextIndex(spark, f"file://{tmp_path}/t")
        known = index._asked(queries)
        ranges = spark.createDataFrame([(r.range,) for r in index.postings.select("range").distinct().collect()], "range long").coalesce(1).mapInArrow(late, "range long")
        best = top(index._scores(known, ranges, 10).select("query_id", "id", "score"), 10).collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert {(r.query_id, r.rank): r.id for r in best} == {(n, c + 1): c * 40 + n if c + n else None for n in range(40) for c in range(10)}


def test_terms(spark):
    assert [stem(w) for w in ("cities", "bus", "glass", "fees", "goes", "movies", "aies", "s", "law", "boxes")] == ["city", "bus", "glass", "fee", "goe", "movy", "aie", "", "law", "boxe"]
    assert Analyzer().terms("The laws; LAW's city-cities 3 3") == {"law": 2, "city": 2, "3": 2} and Analyzer().terms(None) == {}
    queries = spark.createDataFrame([(1, "a law"), (2, "law laws city"), (3, None)], "query_id int, text string")
    assert sorted(map(tuple, query_terms(queries).collect())) == [(1, "law"), (2, "city"), (2, "law")]


def test_letters_and_halves_go_as_in_sql(spark, tmp_path):
    import duckdb

    from lawloom.queries import _rounded

    text = "A\u0130B \u0130 \u212alm nop"
    want = duckdb.execute("SELECT regexp_extract_all(lower(?), '[a-z0-9]+')", [text]).fetchone()[0]
    docs = spark.createDataFrame([(1, text)], "id long, content string")
    assert docs.select(text_index.words(F.col("content"))).first()[0] == len(want)
    assert docs.select(terms(F.col("content"))).first()[0] == want
    assert list(Analyzer().terms(text)) == want
    halves = [(n * 10 + 5) / 1e5 for n in range(0, 300_000, 997)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in halves], "x double").coalesce(1).select(_rounded("x", 4)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0] for x in halves]


def test_empty_text_index(spark, tmp_path):
    text_index.build(spark.createDataFrame([], "id long, content string"), f"file://{tmp_path}/t", {"content": 1.0})
    queries = spark.createDataFrame([(1, "law")], "query_id long, text string")
    assert TextIndex(spark, f"file://{tmp_path}/t").search(queries).count() == 0


# -- paged tables and bitmaps


@pytest.mark.parametrize("rows_a_part", [1 << 20, 150])
def test_pages_are_read_without_a_sort(spark, tmp_path, rows_a_part):
    r = random.Random(4)
    # A third of the rows have one key; some have none, some are repeated, and names clash.
    rows = [("hot" if k % 3 == 0 else None if k % 50 == 1 else f"k{r.randrange(400)}", k // 2, 7, "x") for k in range(1000)]
    schema, path = "key string, n int, at int, part string", str(tmp_path / "paged")
    paging.write_paged(spark.createDataFrame(rows, schema).repartition(5), path, "key", rows_a_part=rows_a_part)
    columns = "key string, n int"
    every = sorted(((x.place, x.key, x.n) for x in paging.read_paged(spark, path, columns).collect()))
    assert [x[0] for x in every] == list(range(1000))
    assert sorted((x[1] or "", x[2]) for x in every) == sorted((k or "", n) for k, n, *_ in rows)
    assert [x[1] or "" for x in every] == sorted(k or "" for k, *_ in rows)  # null comes first
    pages = [(x.place, x.key, x.n) for skip in range(0, 1100, 170) for x in paging.page(spark, path, columns, skip, 170).collect()]
    assert pages == every
    physical = paging.page(spark, path, columns, 340, 170)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in physical and "rangepartitioning" not in physical
    assert re.search(r"PartitionFilters: \[[^\]]*part#", physical)
    ranges = spark.read.parquet(f"{path}/ranges").collect()
    if rows_a_part == 150:  # the hot key fills more than one range
        assert len(ranges) >= 6 and sum("hot" in (x.low, x.high) for x in ranges) >= 2


def test_pages_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "paged")
    paging.write_paged(spark.createDataFrame([], "key string"), path, "key")
    assert paging.read_paged(spark, path, "key string").count() == paging.page(spark, path, "key string", 0, 10).count() == 0


def test_bitmaps_count_any_filters(spark):
    r = random.Random(3)
    n = 70_000  # three ranges of 32,768 places
    rows = [(k, r.choice(["en", "de", None]), r.randrange(4), r.sample(["a", "b", "c", None], r.randrange(4)) if k % 7 else None) for k in range(n)]
    rows = [(k, lang, num, (tags + tags[:1]) if tags else tags) for k, lang, num, tags in rows]  # an item twice in one row
    made = bitmaps.build_bitmaps(spark.createDataFrame(rows, "place long, lang string, num int, tags array<string>"), ["lang", "num", "tags"]).cache()
    assert made.groupBy("field", "value", "bucket").count().where("count > 1").count() == 0

    def values(row, field):
        v = row[{"lang": 1, "num": 2, "tags": 3}[field]]
        return {str(x) for x in (v if isinstance(v, list) else [v]) if x is not None}

    for filters in ({}, {"lang": ["en"]}, {"lang": ["en", "de"], "num": ["1", "3"]}, {"tags": ["a", "b"], "lang": ["de"], "num": ["0"]}, {"lang": ["none"]}, {"lang": []}):
        kept = [x for x in rows if all(values(x, f) & set(v) for f, v in filters.items())]
        assert bitmaps.count_hits(made, filters).first()["rows"] == len(kept)
        want = Counter((f, v) for x in kept for f in ("lang", "num", "tags") for v in values(x, f))
        assert {(x.facet, x.value): x.rows for x in bitmaps.facet_hits(made, filters, ["lang", "num", "tags"]).collect()} == dict(want)
    made.unpersist()
