"""The pipeline's stages against plain Python, with null ids, repeated ids and repeated rows."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(4)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 7))) for _ in range(300)]
PASSAGE = " ".join(f"leak{k}" for k in range(14))


def prose(n=40):
    return " ".join(R.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "aa" if k % 2 else "bb", "s", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def pairs(out):
    return Counter((r.doc_id, r.text) for r in out.collect())


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def without_copies(rows):
    """Of each group of distinct (id, text) that links connect, the smallest id, any before none; of ids alike any row."""
    left = list(dict.fromkeys(rows))
    grams = [shingles(t) for _, t in left]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if grams[a] and grams[b] and 100 * both >= 75 * len(grams[a] | grams[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    members = {}
    for row, g in zip(left, group, strict=True):
        members.setdefault(g, []).append(row)
    return [min(m, key=lambda x: (x[0] is None, x[0] or 0)) for m in members.values()]


@pytest.fixture(scope="module")
def copies():
    a, b, c, d, e = (prose() for _ in range(5))
    near = lambda t: t + " more"
    rows = [(1, a), (2, near(a)), (None, a), (None, near(b)), (None, b + " other"), (3, c), (3, d), (3, d), (4, near(d)), (None, e), (5, near(e))]
    return rows + [(7, None), (None, None), (8, ""), (6, prose()), (6, prose())] + [(20 + k, prose()) for k in range(10)]


def test_near_copies(spark, copies):
    got = pairs(corpus_pipeline.without_near_copies(spark, frame(spark, copies), ""))
    want = Counter(without_copies(copies))
    # Two near copies without ids: either may stay.
    same = lambda c: Counter((i, "b" if i is None and t and t.endswith((" more", " other")) else t) for i, t in c.elements())
    assert same(got) == same(want)


def test_language(spark):
    rows = [(k % 40, prose(12)) for k in range(80)] + [(None, prose()), (None, "123 ..."), (None, None), (3, "77 - 88"), (200, ""), (5, prose())]
    got = pairs(corpus_pipeline.by_language(spark, frame(spark, rows), ""))
    assert got == Counter((i, t) for i, t in rows if t and re.search("[a-z]", t))


def test_benchmark(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, prose()), (1, f"{prose()} {PASSAGE}"), (None, f"{PASSAGE} {prose()}"), (None, prose()), (2, PASSAGE), (3, None), (None, None)]
    got = pairs(corpus_pipeline.without_benchmark(spark, frame(spark, rows), str(tmp_path)))
    assert got == Counter((i, t) for i, t in rows if PASSAGE not in (t or ""))


def test_lines(spark, copies):
    from tests.llm.test_operators import without_lines

    line = "all of the rights are reserved here"
    rows = [*copies, (40, f"{line}\n{prose()}"), (41, f"{line}"), (None, f"{line}\nleft alone {prose()}"), (42, None), (43, "")]
    got = pairs(corpus_pipeline.without_recurring_lines(spark, frame(spark, rows), ""))
    want = Counter()
    for (i, t, _, dropped), n in without_lines(rows).items():
        if not dropped or (t or "").strip():
            want[i, t] += n
    assert got == want and (41, line) not in got


def test_run_is_its_stages_one_after_the_other(spark, tmp_path, copies):
    rows = [*copies, (50, f"{prose()} {PASSAGE}"), (51, "123"), (52, "only here\nall of the rights are reserved"), (53, f"{prose()}\nall of the rights are reserved")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
    left = docs.collect()
    # Every text that is left is in pieces as long as the tokenizer's ids of it, and no other.
    from tests.llm.test_operators import BYTE, ids_of

    pieces = Counter()
    for r in got:
        pieces[r.doc_id] += r.length
    want = Counter()
    for r in left:
        want[r.doc_id] += len(ids_of(BYTE, r.text, 1))
    assert pieces == want and not {50, 51} & set(pieces) and {52, 53} <= set(pieces)
