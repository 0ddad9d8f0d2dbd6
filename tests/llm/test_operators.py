"""Each operator against a plain Python version, on rows with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lawloom.llm import common, line_dedup, packing, pitman_yor, sstable, url_reputation
from lawloom.llm import ngram_join as ngram_join_module
from lawloom.llm.common import fold
from lawloom.llm.decontaminate import decontaminate
from lawloom.llm.exact_dedup import exact_dedup
from lawloom.llm.language import identify_language
from lawloom.llm.line_dedup import drop_recurring_lines
from lawloom.llm.ngram_join import ngram_join
from lawloom.llm.packing import pack_documents
from lawloom.llm.pitman_yor import score_texts
from lawloom.llm.shard import shard_documents, size_of, write_shards
from lawloom.llm.tokens import WHITE, PartTokenizer
from lawloom.llm.url_reputation import host_reputation, judge_urls

WORD, BYTE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, n int, row string, key string, bucket int, component string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def texts():
    """Ids and texts: exact and near copies, chains of near copies, null, empty, blank, very long, repeated rows, a null id."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out = [(1, "One two three four five six seven"), (2, None), (3, ""), (4, " \t\n "), (None, "a text without an id"), (1, "One two three four five six seven")]
    out += [(5, "one  two three FOUR five\tsix seven"), (6, "é ß 中文 one-two 3.5 x@y.z"), (7, "short"), (8, "short"), (9, "short words")]
    out += [(10, " ".join(prose(30_000)))]
    base = prose(120)
    for k in range(12):  # near copies, each one word further from the first
        base = list(base)
        base[(17 * k) % 120] = f"new{k}"
        out.append((100 + k, " ".join(base)))
    for k in range(30):
        out.append((200 + k, "\n".join(" ".join(prose(r.randint(2, 14))) for _ in range(6)) + f"\nPage {k} of the same old report here\nall rights reserved."))
    out += [(300 + k, " ".join(prose(40))) for k in range(40)]
    return out


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs = [None, "en", "de"]
    return spark.createDataFrame([(i, t, langs[k % 3], f"s{k % 4}", len(t or ""), "x", 1, "y", "z", 3, "c") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- tokens, shards, packing


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(WHITE + "\x1c\x1f'sté."), st.characters(codec="utf-8")), max_size=60))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_parts_give_the_tokenizers_own_ids(path, text):
    ours, theirs = parted(path), whole(path)
    assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_special_strings_are_encoded_like_the_tokenizer_does():
    for path in (WORD, BYTE):
        text = "a  <|endoftext|> b"
        assert np.frombuffer(PartTokenizer(path).encode([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@cache
def whole(path):
    return Tokenizer.from_file(path)


@cache
def parted(path):
    return PartTokenizer(path)


def ids_of(path, text, end):
    return np.array(whole(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_sstable_round_trip(docs, rows):
    manifest = sstable.write_sstables(docs, WORD, shard_bytes=20_000)
    got = sorted(sstable.read_sstables(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    start, want = 0, defaultdict(list)
    for i, t in rows:
        want[i].append(ids_of(WORD, t, 2).tolist())
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids in want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert manifest.count() > 1


def test_sstable_lookup(spark, docs):
    manifest = sstable.write_sstables(docs, WORD, shard_bytes=20_000)
    asked = spark.createDataFrame([(1,), (205,), (10,), (None,), (999_999,), (-5,)], "doc_id long")
    found = Counter(r.doc_id for r in sstable.lookup(manifest, asked).collect())
    assert found == {1: 2, 205: 1, 10: 1, None: 1}


def test_sstable_file_keeps_order_and_prefixes(tmp_path):
    writer = sstable.Writer(f"file://{tmp_path}/a.sst", block_bytes=64)
    keys = [sstable.key_of(k) for k in (None, -3, 0, 7, 7, 300, 1 << 40)]
    for k, key in enumerate(keys):
        writer.add(key, np.array([k, 70_000 * (k % 2)], "<u4"))
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(1), np.zeros(1, "<u4"))
    writer.close()
    reader = sstable.Reader(f"file://{tmp_path}/a.sst")
    assert [(k, x.tolist()) for k, x in reader] == [(key, [k, 70_000 * (k % 2)]) for k, key in enumerate(keys)]
    assert len(reader.get(keys[3])) == 2 and reader.get(sstable.key_of(8)) == []


def test_packing(docs, rows):
    got = pack_documents(docs, BYTE, open_windows=4, fan_in=2).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ids_of(BYTE, t, 1))
    for i, all_ids in want.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, all_ids))
        for r in by_doc[i]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in all_ids)
    total = 0
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(by_window) <= total / 2048 * 1.1 + 3


def packed_in_one_task(lengths, size, open_, fan_in):
    """Best fit into open windows, then the windows left open together, longest first, in plain Python: pieces (text, start) to window and offset."""
    out, slots, made = {}, [[None, 0] for _ in range(open_)], 0
    for k, n in enumerate(lengths):
        for start in range(0, n, size):
            length = min(size, n - start)
            if length == size:
                out[k, start] = (made, 0)
                made += 1
                continue
            fits = [w for w in slots if w[1] >= length]
            w = min(fits or slots, key=lambda x: x[1])  # the tightest, else a free slot, else that of the fullest
            if not fits:
                w[:] = made, size
                made += 1
            out[k, start] = (w[0], size - w[1])
            w[1] -= length
    merged, moves = [], {}
    for i, free in sorted((w for w in slots if w[1]), key=lambda w: (w[1], w[0])):
        fits = [m for m in merged if m[1] >= size - free]
        m = min(fits, key=lambda x: x[1]) if fits else [len(merged), size]
        if not fits:
            merged.append(m)
        moves[i] = (("m", m[0]), size - m[1])
        m[1] -= size - free
    return {p: (moves[w][0], moves[w][1] + at) if w in moves else (w, at) for p, (w, at) in out.items()}


def test_packing_is_that_of_plain_python(spark):
    r = random.Random(12)
    texts = [" ".join(r.choice(["one", "two", "three"]) for _ in range(r.choice((3, 50, 700, 1500, 5000)))) for _ in range(160)]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    got = pack_documents(data, BYTE, open_windows=6).collect()
    want = packed_in_one_task([len(ids_of(BYTE, t, 1)) for t in texts], 2048, 6, 64)
    groups = lambda of: {frozenset((p, at) for p, (w, at) in of.items() if w == one) for one in {w for w, _ in of.values()}}
    assert groups({(x.doc_id, x.start): (x.sequence_id, x.offset) for x in got}) == groups(want)


def test_windows_are_best_fit_and_emit_the_fullest():
    windows = packing.Windows(10, 2, 0)
    assert [windows.place(n) for n in (6, 7, 3, 4, 9, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]


# -- near copies, exact copies


def jaccard_groups(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    low = {}
    for group in members.values():
        ids = [sets[k][0] for k in group if sets[k][0] is not None]
        for k in group:
            low[k] = min(ids) if ids else None
    return Counter((sets[k][0], len(sets[k][1]), low[k] if sets[k][1] else sets[k][0]) for k in range(len(rows)))


@pytest.mark.parametrize("block", [3, 1000])
def test_ngram_join_matches_all_pairs(docs, rows, block):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs, block=block).collect())
    assert got == jaccard_groups(rows)


def test_ngram_join_of_many_near_copies(spark):
    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(r.choice((0, 1, 2, 3))):
            own[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(own)))
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == jaccard_groups(rows)


def test_ngram_join_of_sets_alike_but_below_the_threshold(spark):
    # Four fifths of each text are one boilerplate, the rest is shared by two texts only: all meet, but only the two link, and some of the second kind.
    r = random.Random(6)
    base = [f"w{k}" for k in range(240)]
    rows = [(k, " ".join(base + [f"own{k // 2}x{j}" for j in range(56)] + [f"z{k}"])) for k in range(60)]
    rows += [(100 + k, " ".join(base + [f"q{k}x{j}" for j in range(r.randrange(20, 40))])) for k in range(30)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4, 1000):
        got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join(data, block=block).collect())
        assert got == jaccard_groups(rows)


def test_units_verify_by_lists_as_by_pairs():
    r = np.random.default_rng(4)
    grams = [np.unique(r.choice(60, r.integers(20, 50), replace=False)).astype("<i8") for _ in range(60)]
    group = lambda rows: pd.DataFrame({"hub": b"h", "set_key": [bytes([k]) for k in rows], "component": list(rows), "n": [len(grams[k]) for k in rows], "most": 200, "packed": [grams[k].tobytes() for k in rows], "hubs": [[{"hub": b"h", "most": 200}]] * len(rows), "unit": 1})
    whole = {frozenset(x) for x in components(ngram_join_module._unit_links(group(range(60)), 50), range(60))}
    pairs = [p for a in range(60) for b in range(a) for p in ngram_join_module._unit_links(group([b, a]), 50)]
    assert whole == {frozenset(x) for x in components(pairs, range(60))} and 1 < len(whole) < 60


def components(links, nodes):
    group = {bytes([k]): {bytes([k])} for k in nodes}
    for u, v in links:
        if group[u] is not group[v]:
            group[u] |= group[v]
            for k in group[v]:
                group[k] = group[u]
    return list({id(g): g for g in group.values()}.values())


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    for i, t in rows:
        groups[digest(t)].append(i)
    low = {h: min((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    want = Counter((i, low[digest(t)], len(groups[digest(t)]), i == low[digest(t)], digest(t)) for i, t in rows)
    for support in (0.02, 0.5):  # with and without winners
        assert Counter(tuple(r) for r in exact_dedup(docs, support=support).collect()) == want


# -- urls, sharding


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/7x?q=1", "https://example.com/en/8", "x://a.example.net/de/80#f", "x://a.example.net/de/9", "x://org", "http://a.b://c/d", "http://É.org/es/"]
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)], "page_id long, url string, html string, n int")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (4, None, None), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, labels).collect()}
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[4] == ("example.com", "/en/8", "com/en/", "block")
    assert got[5] == ("a.example.net", "/de/80", "example.net/de/8", "block")
    assert got[6] == ("a.example.net", "/de/9", "net/de/", "allow")
    assert got[7][:3] == ("org", "", None) and got[8][:3] == ("a.b:", "//c/d", None) and got[9][:3] == ("É.org", "/es/", "org/es/")
    assert judge_urls(pages.limit(0), labels).count() == 0 and judge_urls(pages, labels.limit(0)).where("rule is null and verdict <> 'allow'").count() == 0


def test_reputation_shrinks_by_evidence(spark):
    hosts = spark.createDataFrame([("bad.a.com", 200, 190), ("new.a.com", 1, 1), ("good.b.com", 300, 3), ("c.b.com", 200, 4), ("d.co.uk", 0, 0)], "host string, n long, bad long")
    got = {r.host: r for r in host_reputation(hosts).collect()}
    assert got["bad.a.com"].bad_bound > 0.85 and got["good.b.com"].bad_rate < 0.05
    assert got["bad.a.com"].bad_rate > got["new.a.com"].bad_rate > got["good.b.com"].bad_rate
    assert got["new.a.com"].bad_bound < got["bad.a.com"].bad_bound and all(r.bad_bound < r.bad_rate for r in got.values())


def test_sites(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com:8080": ("y.com", "com"), "10.0.0.1:80": ("10.0.0.1", "ip"), "[::1]": ("[::1]", "ip"), "local": ("local", "local"), "": ("", "")}
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0]: (r[1], r[2]) for r in frame.select("host", *url_reputation.site_of(F.col("host"), url_reputation.SUFFIXES)).collect()} == hosts


def test_weights_are_fitted_within_the_level_above(spark):
    # Domains differ, their hosts don't: what domains differ in must not count as difference between hosts.
    rows = [(f"h{k}.d{d}.com", 100, 90 if d % 2 else 10) for d in range(20) for k in range(4)]
    got = host_reputation(spark.createDataFrame([*rows, ("new.d1.com", 1, 0), ("new.d2.com", 1, 1)], "host string, n long, bad long")).collect()
    rate = {r.host: r.bad_rate for r in got}
    assert rate["new.d1.com"] > 0.85 and rate["new.d2.com"] < 0.15


def test_repeated_pages_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.fr/x", 3, 4, "q")] * 3 + [(2, None, 1, 2, "r")], "page_id long, url string, n long, bad long, host string")
    labels = spark.createDataFrame([(1, 0, 0, "x")] * 2, "doc_id long, quality int, toxic int, url string")
    got = judge_urls(pages, labels).collect()
    assert sorted((r.page_id, r.host, r.n_labelled) for r in got) == [(1, "a.fr", 3)] * 3 + [(2, "", 0)]


def test_sharding(spark, docs, rows, tmp_path):
    placed = shard_documents(docs, shards=5)
    got = placed.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 5 and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    write_shards(docs.where("doc_id >= 200"), placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 70


def split_evenly(rows, dims, leaves):
    """The k-d tree in plain Python: rows (size, *keys) to the number of their leaf, from left to right."""
    whole = [max(1, max(r[1 + d] for r in rows) - min(r[1 + d] for r in rows)) for d in range(dims)]
    out = [0] * len(rows)

    def split(own, leaves, first):
        if leaves == 1:
            for k in own:
                out[k] = first
            return
        width = [(max(rows[k][1 + d] for k in own) - min(rows[k][1 + d] for k in own)) / whole[d] if own else 0 for d in range(dims)]
        d = width.index(max(width))
        target, upto = sum(rows[k][0] for k in own) * (leaves // 2) // leaves, 0
        bound = 0
        for value in sorted({rows[k][1 + d] for k in own}):
            here = sum(rows[k][0] for k in own if rows[k][1 + d] == value)
            if upto + here >= target:
                bound = value if upto + here - target <= target - upto else value - 1
                break
            upto += here
        split([k for k in own if rows[k][1 + d] <= bound], leaves // 2, first)
        split([k for k in own if rows[k][1 + d] > bound], leaves - leaves // 2, first + leaves // 2)

    split(list(range(len(rows))), leaves, 0)
    return out


def test_tree_is_that_of_plain_python(spark):
    from lawloom.llm import shard

    r = random.Random(3)
    rows = [(r.choice((16, 30, 400)), r.randrange(1 << 40), r.choice((5, 5, 5, 900)) << 32 | r.randrange(1 << 20), r.randrange(50)) for _ in range(400)]
    frame = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, size long, a long, b long, c long")
    dims = ["a", "b", "c"]
    tree, shard_of = shard.kd_tree(frame, dims, 7)
    got = {x.k: shard_of[x.node] for x in frame.select("k", shard._place(tree, dims).alias("node")).collect()}
    want = split_evenly(rows, 3, 7)
    groups = lambda of: {frozenset(k for k in range(400) if of[k] == s) for s in set(of)}
    assert groups([got[k] for k in range(400)]) == groups(want)


def test_sharding_to_target_bytes_and_many_rows_without_id(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("one").alias("source"), F.lit(1).alias("size"), F.lit(2).alias("shard"))
    got = shard_documents(rows, target_bytes=10_000).collect()
    total = sum(r.size for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 3000 and len(sizes) == -(-total // 10_000) and max(sizes.values()) < 11_000


def test_shards_are_even_with_a_hot_source_and_copies(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text " * 20)).otherwise(F.repeat(F.lit("ab "), (F.col("id") * 7 % 150).cast("int"))).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    sizes = [r[1] for r in shard_documents(rows).groupBy("shard").agg(F.sum("size")).collect()]
    mean = sum(sizes) / 40
    assert len(sizes) == 40 and max(sizes) < mean * 1.06 and min(sizes) > mean * 0.94
    assert rows.select(size_of(F.col("text"))).count() == 6000


def test_shards_are_even_with_rows_equal_in_everything(spark):
    """A third of all rows have no id and one text: they are split like others, and every shard is used."""
    rows = spark.range(3000).select(F.when(F.col("id") >= 1000, F.col("id")).alias("doc_id"), F.when(F.col("id") < 1000, "the same").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("one").alias("source"))
    got = shard_documents(rows, slot_rows=10).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(sizes.values()) / 40
    assert len(got) == 3000 and len(sizes) == 40 and max(sizes.values()) < mean * 1.05 and min(sizes.values()) > mean * 0.95
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


# -- language, lines, language model, benchmark


def test_language(spark):
    r = random.Random(1)
    sound = {"aa": "kzxqu aeo".split(), "bb": "ölt mnr éis".split(), "cc": "привет слово да".split()}
    rows = [(k, " ".join("".join(r.choice(sound[lang]) for _ in range(2)) for _ in range(r.randint(3, 60))), lang) for k in range(600) for lang in [r.choice(list(sound))]]
    rows += [(1000, None, "aa"), (1001, "123 ... 456", "bb"), (1002, "", None), (1003, "½ ²", "aa"), (1004, "①_٣", "aa"), (None, "привет да", "cc"), (5, "слово " * 50_000, "cc")]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify_language(data, landmarks=10, train_rows=60).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    by_id = {x.doc_id: x for x in got}
    assert all(by_id[i].lang_pred == "und" for i in (1000, 1001, 1002, 1003, 1004))
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    truth = {i: lang for i, t, lang in rows if i is not None and i < 600 and i != 5}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.98 * len(held)


def masked(line):
    tokens = ["<*>" if re.search("[0-9@]", t) else t for t in re.split("[\\x20\\x09-\\x0D]+", line.translate(LOWER)) if t]
    return tuple(tokens) if set(tokens) - {"<*>"} else ()


def drain(rows, depth=3, similarity=0.8):
    """The rule in plain Python: lines (id, text, place) to drop."""
    first, place, leaves = {}, defaultdict(list), defaultdict(set)
    for i, t in rows:
        doc = -(1 << 63) if i is None else i
        for at, line in enumerate((t or "").split("\n")):
            if own := masked(line):
                first[own] = min(first.get(own, doc), doc)
                place[own].append((i, t, at, doc))
                leaves[len(own), own[:depth]].add(own)
    like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) >= similarity * len(a) - 1e-9
    low = {own: min(first[x] for x in members if like(own, x)) for members in leaves.values() for own in members}
    return {x[:3] for own, lines in place.items() for x in lines if x[3] != low[own]}


def without_lines(rows):
    drop, want = drain(rows), Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for at, x in enumerate(lines) if (i, t, at) not in drop]
        want[i, None if t is None else "\n".join(left), len(lines) if t else 0, len(lines) - len(left)] += 1
    return want


def test_recurring_lines(docs, rows):
    clashing = docs.withColumnsRenamed({"hash": "row_key", "key": "Dropped_Lines"})
    got = drop_recurring_lines(clashing).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == without_lines(rows)
    assert any(r.n_dropped for r in got) and {"lang", "row_key", "Dropped_Lines", "row"} <= set(got[0].asDict())


def test_lines_that_differ_in_a_field_share_a_template(spark):
    # Fields early and late, some without digits; short lines; lines of fields only; one line in most documents.
    r = random.Random(8)
    tail = [" ".join(r.choice("abcdefgh") * 3 for _ in range(9)) for _ in range(40)]
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    rows = [(k, f"sent to you {name(k)} on {tail[k % 40]}\nkept {k}\n{k} {k}\n{k}\nTHE end\nno text like {name(7 * k)}{name(k)}") for k in range(200)]
    rows += [(None, f"the END\nsent to you anyone on {tail[3]}"), (5, "the end\r\n\n x")]
    got = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = without_lines(rows)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == want
    assert sum(n[3] * k for n, k in want.items()) > 500


@pytest.mark.parametrize("few", [20, 64])
@pytest.mark.parametrize("places", [1, 2, 3])
def test_lines_that_differ_at_several_places_meet(spark, places, few):
    # One template of 15 tokens, words replaced anywhere after the third; another of 40 that all but agree enough.
    r = random.Random(places)
    base, wide = [f"w{chr(97 + k)}" for k in range(15)], [f"u{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]

    def changed(words, n):
        words = list(words)
        for _ in range(n):
            words[r.randrange(3, len(words))] = "x" + "".join(r.choice("abcdefgh") for _ in range(8))
        return " ".join(words)

    rows = [(k, changed(base, places)) for k in range(300)] + [(1000 + k, changed(wide, 2 + 3 * places)) for k in range(100)]
    got = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), few=few).collect()
    want = without_lines(rows)
    assert Counter((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got) == want
    assert sum(n[3] * k for n, k in want.items()) > 200


def test_line_dedup_sends_only_the_tokens_it_asks_for(spark, monkeypatch):
    # A hot key meets all its rows, in several tasks; of lines that nobody asks for no tokens are sent.
    many = spark.range(9000).select(F.when(F.col("id") < 7000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("by"))
    one = many.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 0")
    got = common.hot_join(many, one, ["k"], "by", "n", 500)
    assert Counter(r.by for r in got.collect()) == Counter([*range(7000), *range(7000, 9000, 2)])
    sent = []
    monkeypatch.setattr(line_dedup, "hot_join", lambda many, one, *a: sent.append(one.count()) or common.hot_join(many, one, *a))
    kinds = spark.createDataFrame([(1, k, 4, f"a b c w{k % 3}") for k in range(1000)], "leaf long, hash long, n int, tokens string")
    pairs = spark.createDataFrame([(1, k, k % 7) for k in range(100, 130)], "leaf long, hash long, lead long")
    found = line_dedup._agreeing(pairs, kinds, 0.8)
    assert {r.hash for r in found.collect()} == {k for k in range(100, 130) if k % 3 == k % 7 % 3} and sent == [7]


def test_lines_with_unlike_tokens_are_not_equal(spark):
    # Tokens whose hashes agree in 16 bits: these lines must not be taken for one another.
    import xxhash

    by_code = defaultdict(list)
    for k in range(3000):
        word = "".join(chr(97 + k // 26**j % 26) for j in range(4))
        by_code[xxhash.xxh64_intdigest(word) & 0xFFFF].append(word)
    pairs = [w[:2] for w in by_code.values() if len(w) > 1]
    assert len(pairs) > 20
    rows = [(2 * n + k, f"alpha beta {w}") for n, pair in enumerate(pairs) for k, w in enumerate(pair)]
    got = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_dropped > 0").count() == 0 and got.count() == len(rows)


def test_near_copies_meet_over_a_row_without_id(spark):
    # The first and last are too far apart to link; the row between them has no id.
    base = [f"w{k}" for k in range(120)]
    change = lambda w, places: [f"{x}x" if k in places else x for k, x in enumerate(w)]
    middle = change(base, (10, 50, 90))
    rows = [(7, " ".join(base)), (None, " ".join(middle)), (9, " ".join(change(middle, (30, 70, 110)))), (11, "other words that no text has"), (None, "alone without any id here")]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x.doc_id, x.component_id) for x in got) == Counter([(7, 7), (None, 7), (9, 7), (11, 11), (None, None)])


@pytest.mark.parametrize("bucket_tokens", [750_000, 900])
def test_language_model(docs, rows, bucket_tokens):
    # With small buckets there are several, and frequent words are hot contexts.
    got = score_texts(docs, fold(F.col("doc_id")) == 1, least_count=20, bucket_tokens=bucket_tokens, sweeps=6, burn_in=2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, kinds = sum(counts.values()), len(counts)
    base = lambda t: sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in [*words(t), None])
    want = Counter((i, held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(base(t), 4)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 and r.perplexity > 1 for r in got)
    # The held-out texts here are mostly one of 30,000 words drawn apart from each other, for which no context can tell
    # more than the base; test_language_model_learns_order has held-out texts like those learned from.
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def prose_with_order(n, seed):
    """Texts in which each word is mostly followed by one of few others."""
    r = random.Random(seed)
    names = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    after = {w: r.sample(names, 3) for w in names}
    out = []
    for k in range(n):
        w, text = r.choice(names), []
        for _ in range(r.randint(3, 12)):
            text.append(w if r.random() > 0.05 else f"odd{r.randrange(500)}")
            w = r.choice(after[w]) if r.random() > 0.2 else r.choice(names)
        out.append((k, " ".join(text)))
    return out


def test_language_model_learns_order(spark):
    rows = prose_with_order(600, 3)
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), fold(F.col("doc_id")) == 1).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.2 * sum(r.n_tokens for r in got)


def test_dishes_do_not_depend_on_the_size_of_the_corpus(spark):
    # Pairs of words seen six times stay dishes beside 6.5 million tokens of other text.
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    ids = (i for i in range(100_000) if not held(i))
    pair = lambda k: f"left{k} right{k}"
    rows = [(next(ids), pair(k)) for k in range(200) for _ in range(6)] + [(next(ids), "pad " * 500_000) for _ in range(13)]
    asked = [i for i in range(100_000, 101_000) if held(i)][:50]
    rows += [(i, pair(k)) for k, i in enumerate(asked)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), fold(F.col("doc_id")) == 1, sweeps=6, burn_in=2).where("held_out").collect()
    assert len(got) == 50 and got[0].train_tokens > 6_500_000
    # One of 200 first words, then a word and an end that are all but certain; as rare words each would be one of 400.
    assert sum(r.score for r in got) / 50 > -4


def seated_one_by_one(rows, held, least, sweeps, burn_in, seed):
    """The model in plain Python: customers leave and come back one by one, and tables of one dish are told apart."""
    rng = np.random.default_rng(seed)
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    frequent = sorted(w for w, n in counts.items() if n >= least)
    dish = {w: k + 1 for k, w in enumerate(frequent)}
    rare = len(frequent) + 1
    pairs = lambda t: list(zip([None, *words(t)], [*(dish.get(w, rare) for w in words(t)), 0], strict=True))
    train = [p for i, t in rows if not held(i) for p in pairs(t)]
    cells = Counter(train)
    d_leaf = pitman_yor.discount(sum(n == 1 for n in cells.values()), sum(n == 2 for n in cells.values()))
    leaf = defaultdict(lambda: defaultdict(list))  # context, dish: customers of each table
    root = defaultdict(list)
    theta, d_root = {"leaf": 1.0, "root": 1.0}, 0.5

    def p_root(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root[w]) - d_root * len(root[w]) + (theta["root"] + d_root * t) / (rare + 1)) / (theta["root"] + n)

    def add(tables, new, d):
        odds = np.array([n - d for n in tables] + [new])
        at = rng.choice(len(odds), p=odds / odds.sum())
        if at == len(tables):
            tables.append(1)
            return True
        tables[at] += 1
        return False

    def leave(tables):
        at = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            return True
        return False

    def add_root(w):
        t = sum(map(len, root.values()))
        add(root[w], (theta["root"] + d_root * t) / (rare + 1), d_root)

    def come(u, w):
        t = sum(map(len, leaf[u].values()))
        if add(leaf[u][w], (theta["leaf"] + d_leaf * t) * p_root(w), d_leaf):
            add_root(w)

    for u, w in train:
        come(u, w)
    total, n = Counter(), 0
    asked = {p for _, t in rows for p in pairs(t)}
    for sweep in range(sweeps):
        for u, w in train:
            if leave(leaf[u][w]):
                leave(root[w])
            come(u, w)
        for name, d, all_ in (("leaf", d_leaf, list(leaf.values())), ("root", d_root, [root])):
            sums = np.array([[sum(map(sum, x.values())), sum(map(len, x.values()))] for x in all_])
            theta[name] = pitman_yor.concentration(theta[name], d, sums[:, 0], sums[:, 1], rng)
        if sweep >= burn_in:
            n += 1
            for u, w in asked:
                c, t = (sum(map(f, leaf[u].values())) for f in (sum, len)) if u in leaf else (0, 0)
                own = leaf[u][w] if u in leaf and w in leaf[u] else []
                total[u, w] += (sum(own) - d_leaf * len(own) + (theta["leaf"] + d_leaf * t) * p_root(w)) / (theta["leaf"] + c)
    values, times = np.unique([n for w, n in counts.items() if w not in dish], return_counts=True)
    each, unseen = pitman_yor.fit_rare(values, times, sweeps=sweeps, burn_in=burn_in, seed=seed)
    which = {w: each[np.searchsorted(values, n)] for w, n in counts.items() if w not in dish}
    return [sum(np.log10(total[p] / n) for p in pairs(t)) + sum(np.log10(which.get(w, unseen)) for w in words(t) if w not in dish) for _, t in rows]


def test_scores_are_those_of_customers_seated_one_by_one(spark):
    rows = prose_with_order(70, 5)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = seated_one_by_one(rows, held, 5, 60, 20, 1)
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), fold(F.col("doc_id")) == 1, sweeps=60, burn_in=20).collect()}
    apart = np.array([(got[i].score - w) / got[i].n_tokens for (i, _), w in zip(rows, want, strict=True)])
    assert np.abs(apart).mean() < 0.03 and np.abs(apart).max() < 0.12


def test_predictive_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    counts = r.poisson(r.gamma(0.2, 20, (12, 9)))
    counts[3, 2] = 5000
    parent = pitman_yor.fit_root(r.integers(0, 50, 9), sweeps=12, burn_in=4, seed=1)
    assert np.isclose(parent.sum(), 1) and (parent > 0).all()
    row, dish = np.nonzero(counts)
    row = np.unique(row, return_inverse=True)[1]
    own, weight = pitman_yor.Restaurants(row, counts[counts > 0]).run(parent[dish], r, sweeps=12, burn_in=4)
    assert np.allclose(np.bincount(row, own) + weight, 1) and (own > 0).all()
    values, times = np.array([1, 2, 3, 40]), np.array([50, 20, 5, 1])
    rare, unseen = pitman_yor.fit_rare(values, times, sweeps=12, burn_in=4, seed=1)
    assert abs((rare * times).sum() + unseen - 1) < 1e-9 and (np.diff(rare) > 0).all()
    assert pitman_yor.fit_rare(np.zeros(0, int), np.zeros(0, int), sweeps=3, burn_in=1, seed=1)[1] == 1.0


def test_stirling_ratios():
    d = 0.4
    exact = {(1, 1): 1.0}
    for c in range(1, 8):
        for t in range(1, c + 2):
            exact[c + 1, t] = exact.get((c, t - 1), 0.0) + (c - d * t) * exact.get((c, t), 0.0)
    s = pitman_yor.Stirling(d)
    for t in range(1, 7):
        assert np.isclose(s(np.array([8]), np.array([float(t)]))[0], np.log(exact[8, t + 1] / exact[8, t]))


def test_gibbs_tables_follow_their_distribution():
    d, c, p = 0.4, 8, 0.3
    exact = {(1, 1): 1.0}
    for k in range(1, c):
        for t in range(1, k + 2):
            exact[k + 1, t] = exact.get((k, t - 1), 0.0) + (k - d * t) * exact.get((k, t), 0.0)
    level = pitman_yor.Restaurants(np.arange(4000), np.full(4000, c), 1.0, d)
    rng = np.random.default_rng(2)
    for _ in range(30):
        level.sample(np.full(4000, p), rng, move_theta=False)
    weights = np.array([exact[c, t] * p**t * np.prod([1 + d * k for k in range(1, t)]) for t in range(1, c + 1)])
    assert np.abs(np.bincount(level.tables, minlength=c + 1)[1:] / 4000 - weights / weights.sum()).max() < 0.03


def test_planes_give_back_the_numbers():
    r = np.random.default_rng(7)
    some = [r.integers(0, 1 << 20, n) for n in (0, 1, 5, 300)]
    assert (pitman_yor.unplaned([pitman_yor.planes(x, "<u4") for x in some], "<u4") == np.concatenate(some)).all()


def test_short_texts_are_hashed_together(monkeypatch):
    r = random.Random(4)
    texts = [None, b"", b" \t", b"one", *(" ".join(r.choice(("Ab", "c", "\u00e9", "a" * 9)) for _ in range(r.randrange(60))).encode() for _ in range(3000)), b"x " * 300_000, b""]
    calls, word_hashes = [], pitman_yor.word_hashes
    monkeypatch.setattr(pitman_yor, "word_hashes", lambda text: calls.append(len(text)) or word_hashes(text))
    got = list(pitman_yor.hashed(texts))
    assert len(got) == len(texts) and all((a == word_hashes(t)[0]).all() and len(a) == len(word_hashes(t)[0]) for a, t in zip(got, texts, strict=True))
    assert len(calls) <= 2 + sum(calls) // (1 << 18) and list(pitman_yor.hashed([])) == []


def test_places_and_sums_equal_bisection():
    r = np.random.default_rng(5)
    for known in (np.array([7], np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(r.integers(0, 2**64 - 1, 5000, np.uint64)), np.arange(9, 900, dtype=np.uint64)):
        asked = np.concatenate((known, known + np.uint64(1), known - np.uint64(1), r.integers(0, 2**64 - 1, 100, np.uint64)))
        assert (pitman_yor.Places(known)(asked) == np.minimum(np.searchsorted(known, asked), len(known) - 1)).all()
        plan = pitman_yor.Plan(known, np.zeros(len(known) + 2), 4, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        assert plan.dishes(asked).tolist() == [int(np.searchsorted(known, x)) + 1 if x in known else len(known) + 1 for x in asked]
    context, dish = r.integers(0, 2**64 - 1, 40, np.uint64)[r.integers(0, 40, 900)], r.integers(0, 9, 900).astype(np.uint32)
    for counts in (None, r.integers(1, 5, 900)):
        want = Counter()
        for c, k, n in zip(context.tolist(), dish.tolist(), [1] * 900 if counts is None else counts.tolist(), strict=True):
            want[c, k] += n
        each, served, sums = pitman_yor.summed(context, dish, counts)
        assert list(zip(each.tolist(), served.tolist(), sums.tolist(), strict=True)) == [(*k, n) for k, n in sorted(want.items())]
    assert [len(x) for x in pitman_yor.summed(context[:0], dish[:0])] == [0, 0, 0]


def test_hot_contexts_are_dealt_apart():
    hot = np.sort(np.array([5 << 60, 9 << 59], np.uint64))
    plan = pitman_yor.Plan(np.zeros(0, np.uint64), np.zeros(2), 4, hot, np.array([3, 8]))
    context = np.sort(np.concatenate((np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64), np.repeat(hot, 20))))
    assert {bucket for salt in range(24) for bucket, *_ in plan.rows(context, salt)} >= set(range(4, 15))
    got = np.concatenate([np.repeat(each, sizes) for _, each, sizes, _ in plan.rows(context, 3)])
    assert sorted(got.tolist()) == context.tolist()
    assert all((bucket >= 4) == bool(np.isin(each, hot).any()) and (context[at] == np.repeat(each, sizes)).all() for bucket, each, sizes, at in plan.rows(context, 3))


def test_decontamination(spark, docs, rows):
    r = random.Random(2)
    spam = " ".join(f"q{k}" for k in range(25))
    own = [*rows, (900, f"before, {spam.upper()}; after"), (901, "só q1 q2 q3"), (902, f"{spam} {spam}")]
    data = spark.createDataFrame(own, "doc_id long, text string")
    items = [("7", spam), ("10", "q1-q2 Q3"), ("3", None), ("4", "..."), (None, "short"), ("8", " ".join(f"q{k}" for k in range(3, 13)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(item or "null")
    want = Counter()
    for i, t in own:
        w, hit, found = split(t), set(), set()
        for window, owners in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= owners
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    got = decontaminate(data, bench).collect()
    assert Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == want
    text = dict(own)[900]
    (span,) = next(x.spans for x in got if x.doc_id == 900)
    assert text[span.begin : span.end] == spam.upper() and r
    (span,) = next(x.spans for x in got if x.doc_id == 901)
    assert dict(own)[901][span.begin : span.end] == "q1 q2 q3"
    with pytest.raises(ValueError):
        decontaminate(data, bench, max_benchmark_mb=0)


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    manifest = sstable.write_sstables(empty, WORD)
    for out in (
        sstable.read_sstables(manifest), ngram_join(empty), pack_documents(empty, BYTE), identify_language(empty), drop_recurring_lines(empty),
        score_texts(empty, fold(F.col("doc_id")) == 1, sweeps=3, burn_in=1), shard_documents(empty), exact_dedup(empty), decontaminate(empty, bench),
    ):
        assert out.count() == 0
