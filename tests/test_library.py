"""The library's own operators on small hand-written cases."""

import io
import json
import math
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from lawloom.functions import text as T
from lawloom.functions.tokens import PatternTokenizer, count_tokens
from lawloom.operators import chat, export, index, markup, retrieve, validate, verify
from lawloom.operators.chunking import line_blocks, pack, pack_groups, page_chunks, pieces_of, split_long
from lawloom.operators.pages import strip_repeated_lines
from lawloom.plans import pipeline
from lawloom.queries import QUERIES, SQL
from lawloom.sources import readers, registry
from lawloom.streaming import limiter, refresh, relay

WORDS = PatternTokenizer()


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


# -- functions


@pytest.mark.parametrize(
    ("make", "given", "wanted"),
    [
        (T.clean, "a b \x1c c ", "a b c"),
        (T.tidy, " a , b ;  c .", "a, b; c."),
        (T.slug, "  Zoning & Land-Use!  ", "zoning-land-use"),
        (T.slug, "a" * 79 + " b", "a" * 79),
        (T.index_key, "code-30 A§", "code-30_A_"),
        (T.citation_of, "30-A M.R.S. § 4452. Enforcement of x", "30-A M.R.S. § 4452"),
        (T.citation_of, "Plain title", "Plain title"),
        (T.smart_title, "PLANNING AND LAND USE of the CITY", "Planning and Land Use of the City"),
        (T.smart_title, "the end", "The End"),
        (T.line_key, "## **Page_ of**  THE  Code ", "page of the code"),
        (T.zero_padded, "1234", "1234"),
        (T.zero_padded, "7", "007"),
        (T.url_quote, "/a b,c+d", "/a%20b%2Cc%2Bd"),
        (T.url_unquote, "a%20b+c", "a b+c"),
        (T.file_stem, "x/y/a.b.pdf", "a.b"),
        (T.through_date, "current through 03-15-2026.", "03-15-2026"),
        (T.escape_html, '<a href="x">&', "&lt;a href=&quot;x&quot;&gt;&amp;"),
        (T.crumb_without_leaf, "A > B > C", "A > B"),
        (T.clean_picture_text, "x <!-- Start of picture text --> a<br>b", "x a b"),
        (T.cited_numbers, "x [1], y [2: part B] and [1]", [1, 2]),
        (T.sentences, "A b. C d; (e) f", ["A b.", "C d;", "(e) f"]),
        (T.paragraphs, "a\n \nb\nc\n\n\n", ["a", "b\nc"]),
        (T.is_footer, "**173 Attachment 1:2**", True),
    ],
)
def test_text(spark, make, given, wanted):
    assert one(spark, given, make(F.col("x"))) == wanted


def test_headings_and_citations(spark):
    rows = [("chapter", "Chapter 9. Boards"), ("section", "§ 9-1. Purpose."), ("section", "Section 3. Powers"), ("article", "Article II. X"), ("part", "no match")]
    df = spark.createDataFrame(rows, "kind string, heading string")
    number, title = T.heading_number(F.col("kind"), F.col("heading"))
    assert [tuple(r) for r in df.select(number, title).collect()] == [("9", "Boards"), ("9-1", "Purpose."), ("3", "Powers"), ("II", "X"), ("", "no match")]
    cite = T.section_citation(F.col("kind"), F.col("heading"), number, F.lit("C"), F.lit("II"))
    assert [r[0] for r in df.select(cite).collect()][:3] == ["Chapter 9. Boards", "Charter Art. II, § 9-1", "Charter Art. II, § 3"]


def test_front_matter_and_labels(spark):
    df = spark.range(1)
    meta = T.front_matter([("title", F.lit('a "b"'), "string"), ("none", F.lit(None).cast("string"), "string"), ("laws", F.array(F.lit("x"), F.lit("y")), "array"), ("empty", F.array().cast("array<string>"), "array"), ("pages", F.lit(3), "int")])
    assert df.select(meta).first()[0] == '---\ntitle: "a \\"b\\""\nlaws: ["x", "y"]\npages: 3\n---\n\n'
    assert df.select(T.page_label(F.lit(2), F.lit(2)), T.page_label(F.lit(2), F.lit(4)), T.part_label(F.lit(0), F.lit(3)), T.part_label(F.lit(0), F.lit(1))).first()[:] == ("page 2", "pages 2-4", " (part 1 of 3)", "")
    crumbs = T.crumbs_of(F.array(F.lit("Title 30-A: TOWNS"), F.lit("Part 2: X"), F.lit("Chapter 187: PLANNING AND USE")))
    assert df.select(crumbs).first()[0] == ["Title 30-A", "Chapter 187: Planning and Use"]
    assert df.select(T.client_ip(F.lit("1.1.1.1, 2.2.2.2"), F.lit("p")), T.client_ip(F.lit(None).cast("string"), F.lit("p"))).first()[:] == ("2.2.2.2", "p")


def test_token_counts_agree(spark):
    for text in ("a b_c, d-e 中 x", "", "..."):
        assert one(spark, text, count_tokens(F.col("x"))) == WORDS.count(text)
    assert "".join(WORDS.cut("a b c d e", 2)) == "a b c d e" and len(WORDS.cut("a b c d e", 2)) == 3


# -- packing


def groups(spark, sizes, limit=800):
    """Groups of pieces told as (text, tokens, kind)."""
    rows = [(k, t, n, kind) for k, (t, n, kind) in enumerate(sizes)]
    df = spark.createDataFrame([(rows,)], "p array<struct<ix:int,text:string,tokens:int,kind:string>>")
    found = df.select(pack_groups(F.col("p"), limit)).first()[0]
    return [[sizes[p.ix][0] for p in g] for g in found]


def test_pack_cases(spark):
    para = lambda *sizes: [(f"{k}:{n}", n, "para") for k, n in enumerate(sizes)]
    assert groups(spark, para(300, 300, 300, 500, 100)) == [["0:300", "1:300"], ["2:300", "3:500", "4:100"]]
    assert groups(spark, para(700, 100, 200)) == [["0:700", "1:100"], ["1:100", "2:200"]]
    assert groups(spark, [("a", 700, "para"), ("b", 100, "table"), ("c", 200, "para")]) == [["a", "b"], ["c"]]
    assert groups(spark, [("y", 600, "para"), ("x", 50, "para"), ("z", 150, "para"), ("x", 50, "para")]) == [["y", "x", "z"]]
    assert groups(spark, []) == []


def model(pieces, limit):
    out, size = [[]], 0
    for p in pieces:
        if out[-1] and size + p[1] > limit:
            last = out[-1][-1]
            carry = [last] if last[1] <= 120 and last[2] != "table" and last[1] + p[1] <= limit else []
            out.append(carry)
            size = sum(x[1] for x in carry)
        out[-1].append(p)
        size += p[1]
    if len(out) > 1 and sum(x[1] for x in out[-1]) < 120 and sum(x[1] for x in out[-1] + out[-2]) <= 1.25 * limit:
        tail = out.pop()
        out[-1] += [p for p in tail if p not in out[-1]]
    return [[p[0] for p in g] for g in out] if pieces else []


def test_pack_against_a_model(spark):
    import random

    r = random.Random(4)
    cases = [[(r.choice("abc") + str(n), n, r.choice(["para", "table"])) for n in (r.choice([5, 50, 100, 130, 300, 700]) for _ in range(r.randint(1, 12)))] for _ in range(120)]
    rows = [(k, [(i, *p) for i, p in enumerate(c)]) for k, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, p array<struct<ix:int,text:string,tokens:int,kind:string>>")
    for row in df.select("k", pack_groups(F.col("p")).alias("g")).collect():
        assert [[cases[row.k][p.ix][0] for p in g] for g in row.g] == model(cases[row.k], 800)


def test_pieces():
    rows = [f"| r{k} word word |" for k in range(6)]
    made = pieces_of([{"kind": "table", "text": "\n".join(["| h |", *rows]), "table_header": "| h |", "table_rows": rows}], 14, WORDS)
    assert all(p["text"].startswith("| h |\n") for p in made) and sum(p["text"].count("word word") for p in made) == 6
    wide = pieces_of([{"kind": "table", "text": "| a b c d e f |\n| x y |", "table_header": "| a b c d e f |", "table_rows": ["| x y |"]}], 4, WORDS)
    assert "".join(p["text"] for p in wide).replace("| a b c d e f |\n", "").replace(" ", "") == "|xy|"
    assert split_long("One two. Three four. Five six seven eight.", 4, WORDS)[0] == "One two."
    assert pieces_of([{"kind": "item", "text": "  - One two three. Four five six.", "table_header": None, "table_rows": None}], 5, WORDS)[0]["text"].startswith("  - ")


def test_pages(spark):
    rows = [("a", 1, "Code of X\none two\n| Code of X |"), ("a", 2, "**CODE of x**\nthree"), ("a", 3, "code of X\n9 Attachment 1:3\nfour"), ("b", 1, "Code of X\nfive")]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    got = {(r.doc_id, r.page): r.text for r in strip_repeated_lines(pages).collect()}
    assert got == {("a", 1): "one two\n| Code of X |", ("a", 2): "three", ("a", 3): "four", ("b", 1): "Code of X\nfive"}
    (chunk,) = page_chunks(spark.createDataFrame([("d", k, f"page {k} text") for k in (1, 2, 3)], "doc_id string, page int, text string")).collect()
    assert (chunk.page_start, chunk.page_end, chunk.body) == (1, 3, "page 1 text\n\npage 2 text\n\npage 3 text")


# -- parsers

CHAPTER = """<div id="content"><h1>x</h1><h2 class="title chapterTitle" id="c1">Chapter 9. Boards</h2>
<div class="content"><div class="history">[Adopted by <span class="loclaw">Ord. 5</span>]</div></div>
<h4 class="title partTitle" id="p1">Part 1. General</h4><h4 class="title articleTitle" id="a1">Article I. First</h4>
<h4 class="title sectionTitle" id="s1">§ 9-1. Purpose.</h4><div class="content"><div class="para">See<a class="footnoteref">[1]</a> <b>this</b>:</div>
<div class="level"><div class="litem"><a class="litem_number">A.</a><div class="litem_content"><div class="para">First<br>line</div>
<div class="litem"><a class="litem_number">(1)</a><div class="litem_content"><div class="para">inner</div></div></div></div></div></div>
<div class="footnotes"><div class="footnote"><a class="footnoterefnum">[1]</a><div class="ftpara">A note.</div></div></div>
<section class="definition"><dfn>TERM</dfn><div class="deftext">what it is</div><div class="deftext">more</div></section>
<div class="attachmentsContainer"><a class="nonxml" href="/a.pdf" data-title="File A">x</a></div><blockquote>odd text</blockquote></div>
<h4 class="title articleTitle" id="a2">Article II. Second</h4><h4 class="title sectionTitle" id="s2">§ 9-2. Fees</h4>
<div class="content"><div class="codeTable"><table><thead><tr><th colspan="2">Caption</th></tr><tr><th>A</th><th>B|C</th></tr></thead>
<tbody><tr><td rowspan="2">x</td><td>1</td></tr><tr><td><div class="para">2<sup>3</sup></div></td></tr><tr><td colspan="2">Group</td></tr><tr><td></td><td></td></tr></tbody></table></div>
<div class="codeTable"><table><tr><td>boxed</td></tr></table></div></div></div>"""


def test_chapter_tree(spark):
    pages = spark.createDataFrame([("d", CHAPTER)], "doc_id string, html string")
    nodes = {r.guid: r for r in markup.chapter_tree(pages).collect()}
    assert [a.guid for a in nodes["s2"].ancestors] == ["c1", "p1", "a2"] and nodes["a2"].parent_guid == "p1"
    assert (nodes["s1"].number, nodes["s1"].title, nodes["c1"].ordinances) == ("9-1", "Purpose.", ["Ord. 5"])
    texts = [b.text for b in nodes["s1"].blocks]
    assert texts == ["See[^1] **this**:", "- A. First line", "  - (1) inner", "**TERM**: what it is", "more", "**Attachments:**\n- File A (PDF, indexed as a separate document)", "odd text", "[^1]: A note."]
    table, box = nodes["s2"].blocks
    assert table.table_header == "**Caption**\n\n| A | B\\|C |\n| --- | --- |" and list(table.table_rows) == ["| x | 1 |", "| x | 2^3 |", "| Group |  |"]
    assert (box.kind, box.text) == ("quote", "> boxed")
    chunks = export.code_chunks(markup.chapter_tree(pages).withColumn("division", F.lit("Part One")), name="City", base_url="https://x")
    first = {r.node_guid: r for r in chunks.collect()}["s1"]
    assert first.content.startswith("City Code\nChapter 9. Boards > Part 1. General > Article I. First > § 9-1. Purpose.\n\nSee[^1]")
    assert (first.id, first.citation, first.part, first.article, first.chapter_title) == ("code-s1-0", "§ 9-1", "Part 1. General", "Article I. First", "Boards")
    (doc,) = export.node_markdown(markup.chapter_tree(pages)).collect()
    assert doc.path == "markdown/code/009-boards.md" and "\n#### § 9-1. Purpose.\n" in doc.markdown and "\n### Article I. First\n" in doc.markdown


def test_other_parsers(spark):
    toc = '<nav id="toc"><div class="contentTitle" data-guid="b">Part I</div><div class="contentTitle" data-guid="g1" data-full-title="Chapter 1" data-code-content-type="chapter">x</div></nav>'
    assert markup.toc_rows(toc) == [{"guid": "g1", "kind": "chapter", "full_title": "Chapter 1", "division": "Part I"}]
    page = '<div class="heading_structure"><div class="toc">Title 1: X</div></div><div class="MRSSection"><div class="heading_section">§1. Name</div><div class="mrs-text">Text , here<div class="mrs-text">A. inner</div></div><div class="mrs-text">2.<span class="bhistory">gone</span></div></div><div class="qhistory_list">PL 1 .</div>'
    found = markup.statute(page)
    assert [b["text"] for b in found["blocks"]] == ["Text, here", "A. inner", "2. (Repealed)"] and found["path"] == ["Title 1: X"] and found["history"] == "PL 1."
    title, blocks = markup.web_page("<body><nav><p>no way</p></nav><h1>T</h1><h2>Head</h2><ul><li><p>inner</p></li><li>item</li></ul><p>Home</p><p>ok text<p>next text</body>")
    assert title == "T" and [b["text"] for b in blocks] == ["## Head", "inner", "- item", "ok text", "next text"]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {w}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="TOC1"/></w:pPr><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:document>')
    raw = spark.createDataFrame([("f.docx", bytearray(data.getvalue()))], "path string, content binary")
    assert [r.text for r in readers.word_blocks(raw).orderBy("block_ix").collect()] == ["## Top", "a b"]
    laws = '<table id="newLawsTable"><tbody><tr data-document-id="L1" data-title="T" data-adopted="2026-01-02" data-subject="S"><td><a class="law" href="/l1">x</a></td></tr><tr data-document-id="L2"><td></td></tr></tbody></table>'
    (law,) = export.law_docs(markup.parsed(spark.createDataFrame([("p", laws)], "doc_id string, html string"), markup.new_law_rows, "id string, title string, subject string, adopted string, type string, href string")).collect()
    assert (law.doc_id, law.citation, str(law.adopted_date)[:10]) == ("newlaw-L1", "S", "2026-01-02")


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one\ftwo")
    pages = readers.pdf_pages(readers.raw_files(spark, str(tmp_path), "*.pdf"), lambda b: b[5:].decode().split("\f"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "b.html").write_bytes(b"a\xffb")
    assert readers.as_text(readers.raw_files(spark, str(tmp_path), "*.html")).first().html == "a�b"
    answers = deque([(503, b""), (200, b"ok")])
    waits = []
    assert readers.retried(lambda: answers.popleft(), wait=waits.append) == b"ok" and waits == [5.0]
    with pytest.raises(ValueError):
        readers.retried(lambda: (500, b""), tries=2, wait=waits.append)
    got = readers.fetch(spark.createDataFrame([("https://h/x",)], "url string"), lambda u: (200, u.encode()), delay=0).first()
    assert bytes(got.content) == b"https://h/x" and got.name.endswith(".html")


# -- checks, index, retrieval, conversations


def test_validation(spark):
    rows = [("ok-1", "x", 5, "2026-01-02T00:00:00Z", ["a"]), ("ok-1", "y", 5, None, ["a", None]), ("bad key", "z", 1 << 40, "not a time", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, content string, token_count long, crawled_at string, ordinances array<string>")
    errors = sorted(r.error for r in validate.validation_errors(df).collect())
    assert errors == ["bad key ", "bad key bad key", "bad key: crawled_at is not timestamp", "bad key: token_count is not int", "duplicate key ok-1", "ok-1: ordinances is not array<string>"]
    with pytest.raises(ValueError):
        validate.check(df)


def test_completeness(spark):
    a, b = (spark.createDataFrame([("c", x) for x in s], "chapter string, guid string") for s in ("xyy", "yz"))
    row = verify.completeness(a, b, ["chapter", "guid"]).first()
    assert (row.sections_parsed, row.sections_listed, row.missing, row.extra) == (2, 2, ["z"], ["x"])
    with pytest.raises(ValueError):
        verify.require_complete(verify.completeness(a, b, ["chapter", "guid"]))


def test_index(spark):
    chunks = spark.createDataFrame([("code-1", "alpha beta"), ("code-2", "alpha beta"), ("code-3", "gamma")], "id string, content string")
    cache = spark.createDataFrame([], "h string, v array<float>")
    embedded, new = index.embed_chunks(chunks, cache, index.HashEmbedder(dims=8))
    assert new.count() == 2 and all(abs(sum(x * x for x in r.content_vector) - 1) < 1e-6 for r in embedded.collect())
    assert index.to_embed(chunks, new, index.HashEmbedder(dims=8)).count() == 0
    old = embedded.where("id <> 'code-3'").unionByName(spark.createDataFrame([("code-9", "old", [1.0]), ("mine-1", "kept", [1.0])], "id string, content string, content_vector array<float>"))
    assert sorted(r.id for r in index.push(old, embedded).collect()) == ["code-1", "code-2", "code-3", "mine-1"]
    assert [r.id for r in index.key_page(chunks, 1, 1).collect()] == ["code-2"]
    seq = spark.createDataFrame([("h", [1.0], 1), ("h", [2.0], 2)], "h string, v array<float>, seq long")
    assert index.cached_vectors(seq).first().v == [2.0]


def test_gate(spark):
    def kept(scores):
        hits = spark.createDataFrame([(1, k, 0, k, s) for k, s in enumerate(scores)], "query_id int, id int, branch int, rank int, score double")
        return [r.score for r in retrieve.gate(hits).orderBy("n").collect()]

    assert kept([2.0, 1.0, 0.9, 0.8]) == [2.0, 1.0, 0.9] and kept([2.0, 1.5, 1.0, 0.9]) == [2.0, 1.5, 1.0] and kept([None]) == [0.0]


def test_search(spark):
    own = index.HashEmbedder()
    docs = spark.createDataFrame([(f"code-{k}", t, "code" if k % 2 else None) for k, t in enumerate(["dogs and cats", "fees for dogs", "zoning map", "dog fees dogs"])], "id string, content string, source_type string")
    docs = index.embed_texts(docs, own).withColumnRenamed("v", "content_vector").withColumns({"title": F.col("content"), "breadcrumb": F.col("content")})
    queries = index.embed_texts(spark.createDataFrame([(1, "dogs fees")], "query_id int, text string"), own, text_col="text").withColumnRenamed("v", "vector")
    got = retrieve.search(docs, queries).orderBy("n").collect()
    assert {r.id for r in got} >= {"code-1", "code-3"} and [r.n for r in got] == list(range(1, len(got) + 1)) and got[0].branch == 0


def test_chat(spark):
    long_, short = " ".join(["w"] * 12), " ".join(["w"] * 11)
    rows = [(1, 0, "user", "before"), (1, 1, "assistant", "a" * 3000), (1, 2, "user", short), (2, 0, "user", "before"), (2, 1, "user", long_), (3, 0, "system", "s"), (4, 0, "user", "  ")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert {r.conv_id: r.query for r in chat.retrieval_query(turns).collect()} == {1: f"before\n{short}", 2: long_, 4: "  "}
    assert {r.conv_id: r.reason for r in chat.guards(turns).collect()} == {1: None, 2: None, 3: "invalid messages", 4: "empty question"}
    hits = spark.createDataFrame([(1, k, f"c{k}" if k > 1 else "", f"t{k}", "A > B", "u", "code", f"text {k}", 2, 2 + k) for k in (1, 2, 3, 4)], "query_id int, n int, citation string, title string, breadcrumb string, url string, source_type string, content string, page_start int, page_end int")
    prompt = {r.conv_id: r.messages for r in chat.prompts(turns.where("conv_id = 1"), chat.prompt_context(hits), "Be kind.").collect()}[1]
    assert [m.role for m in prompt] == ["system", "system", "user", "assistant", "user"] and len(prompt[3].content) == 2000
    assert "[1] t1, pages 2-3 (City code)\ntext 1\n\n---\n\n[2] c2" in prompt[1].content
    answers = spark.createDataFrame([(1, "as [2: x] says, **bold**")], "query_id int, answer string")
    assert [r.n for r in chat.shown_sources(answers, hits).collect()] == [2]
    assert sorted(r.n for r in chat.shown_sources(answers.withColumn("answer", F.lit("none")), hits).collect()) == [1, 2, 3]
    html = answers.select(chat.rendered(F.lit("# Head\n- a [1]\n- **b**\n<x>"))).first()[0]
    assert html == '<p>Head</p><ul><li>a <a class="cite" href="#source-1">[1]</a></li><li><strong>b</strong></li></ul><p>&lt;x&gt;</p>'
    event = chat.source_events(hits).first().event
    assert event.startswith("event: sources\ndata: [") and json.loads(event.split("data: ")[1])[0]["crumb"] == "A"


# -- registry, streams, runs


def test_registry(spark):
    text = '[[source]]\nid = "s-1"\ntitle = "1 S. §§ 1-2. X"\nurl = "u/1"\nsections = ["1", "2-A"]\nurl_pattern = "u/{section}"\nkind = "statute"\ntier = "ingest"\n[[source]]\nid = "y"\ntitle = "Y"\nurl = "u"\nkind = "rule"\ntier = "skip"'
    got = [(r.id, r.url, r.citation) for r in registry.expand(registry.read_registry(spark, text)).orderBy("id").collect()]
    assert got == [("s-1", "u/1", "1 S. § 1"), ("s-2-a", "u/2-A", "1 S. § 2-A")]
    with pytest.raises(ValueError):
        registry.require_chunks(spark.createDataFrame([("d",)], "doc_id string"), spark.createDataFrame([], "doc_id string"))


def limited(rows, per_minute, per_day, overall=None):
    out, kept = {}, []
    for client, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        kept = [(c, t) for c, t in kept if at - t <= 86_400]
        own = [t for c, t in kept if c == client]
        reason = "all" if overall is not None and len(kept) >= overall else "day" if len(own) >= per_day else "minute" if sum(at - t <= 60 for t in own) >= per_minute else None
        if reason is None:
            kept.append((client, at))
        out[i] = reason
    return out


@pytest.mark.parametrize("overall", [None, 7])
def test_limiter(spark, overall):
    import random

    r = random.Random(6)
    rows = [(r.choice("ab"), i, float(r.randrange(0, 200_000, 20))) for i in range(60)] + [("c", 100 + k, float(k)) for k in range(7)] + [("c", 200, 60.0)]
    df = spark.createDataFrame(rows, "client string, id long, at double")
    got = {x.id: x.reason for x in limiter.limit_rows(df, per_minute=6, per_day=9, all_per_day=overall).collect()}
    assert got == limited(rows, 6, 9, overall)
    if overall is None:
        assert got[106] == "minute" and got[200] == "minute"


def test_limiter_stream(spark, tmp_path):
    rows = [("a", k, float(20 * k)) for k in range(12)] + [("b", 50, 1.0)]
    spark.createDataFrame(rows, "client string, id long, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, id long, at double").parquet(str(tmp_path / "in"))
    running = limiter.limit_stream(stream, per_minute=2, per_day=5, evict=False).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    assert {r.id: r.reason for r in spark.table("limited").collect()} == limited(rows, 2, 5)


@pytest.mark.parametrize("overall", [40, 400])
def test_limiter_over_all_clients(spark, tmp_path, overall):
    # A quiet day, three busy ones and quiet ones again; 400 never binds, 40 from the second day on.
    import random

    r = random.Random(9)
    schema = "client string, id long, at double"
    at = [r.uniform(0, 86_400) for _ in range(30)] + [r.uniform(90_000, 300_000) for _ in range(400)] + [r.uniform(500_000, 900_000) for _ in range(60)]
    rows = [(r.choice("abcdefghijkl"), i, round(t)) for i, t in enumerate(sorted(at))]
    rows = [(c, i, float(t)) for c, i, t in rows]
    want = limited(rows, 3, 6, overall)
    assert ("all" in want.values()) == (overall == 40)
    start = limiter.first_full(limiter.limit_rows(spark.createDataFrame(rows, schema), per_minute=3, per_day=6), overall)
    assert start is None if overall == 400 else 86_400 <= start <= 200_000
    # A request without a time is refused and counts for nobody.
    got = {x.id: x.reason for x in limiter.limit_rows(spark.createDataFrame([*rows, ("a", 9_000, None), (None, 9_001, float("nan"))], schema), per_minute=3, per_day=6, all_per_day=overall).collect()}
    assert got == want | {9_000: "time", 9_001: "time"}

    # As a stream in files of one batch each, stopped and started anew between them.
    given, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given + "/*")
    for k in range(3):
        part = [x for x in rows if x[1] * 5 // len(rows) in ((0,), (1, 2), (3, 4))[k]]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{given}/{k}")
        limiter.limit_stream_all(stream, out, state, per_minute=3, per_day=6, all_per_day=overall).awaitTermination()
    answers = [(x.id, x.reason) for x in limiter.decided(spark, out).collect()]
    assert len(answers) == len(rows) and dict(answers) == want
    kept = spark.read.parquet(f"{out}/held/2").collect()
    assert 0 < len(kept) <= overall and min(x["at"] for x in kept) >= rows[-1][2] - 86_400


@pytest.mark.parametrize("step", [40, 1_000])
def test_limiter_walks_by_ranges(spark, monkeypatch, step):
    import random

    r = random.Random(12)
    schema = "client string, id long, at double"
    rows = [(r.choice(["a", "a", "b", None, *map(str, range(6))]), i, float(r.randrange(0, 200_000, 400))) for i in range(300)]
    walk, walked = limiter._walk, []
    monkeypatch.setattr(limiter, "_walk", lambda part, *limits: walk(part if limits[-1] is None else walked.append(part.count()) or part, *limits))
    got = limiter.limit_rows(spark.createDataFrame([*rows, ("a", 9_000, None)], schema), per_minute=2, per_day=3, all_per_day=12, step=step).collect()
    want = limited(rows, 2, 3, 12)
    assert len(got) == len(rows) + 1 and {x.id: x.reason for x in got} == want | {9_000: "time"}
    assert {"all", "day", None} <= set(want.values())
    # No task has more than some ranges' rows and the state of a day.
    assert len(walked) >= len(rows) // step * 0.8 and max(walked) <= 3 * step + 24


def test_documents_are_packed_once(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (2, None), (3, " \n"), (4, "x " * 1_000)], "doc_id long, text string")
    packed = pack(line_blocks(docs).select("doc_id", "blocks")).select("doc_id", "chunk_index", "chunk_count", F.length("body").alias("n"))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("aggregate(transform") == 1
    assert sorted(map(tuple, packed.collect())) == [(1, 0, 1, 6), (4, 0, 2, 1_600), (4, 1, 2, 399)]


def test_idle_clients_leave_the_stream(spark, tmp_path):
    import time

    schema = "client string, id long, at double"
    given, state = str(tmp_path / "in"), str(tmp_path / "state")
    stream = spark.readStream.schema(schema).parquet(given + "/*")
    for k, client in enumerate("ab"):
        spark.createDataFrame([(client, k, float(k))], schema).write.parquet(f"{given}/{k}")
        if k == 0:
            limits = limiter.limit_stream(stream, idle=2.0)
            running = limits.writeStream.format("noop").outputMode("append").option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start()
        until = time.time() + 60
        while time.time() < until and sum(p["numInputRows"] for p in running.recentProgress) <= k:
            time.sleep(0.2)
        time.sleep(3 - 3 * k)
    running.stop()
    assert {x.key[0] for x in spark.read.format("statestore").load(state).select("key").collect()} == {"b"}


def test_relay(spark):
    chunk = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    lines = spark.createDataFrame([(1, 2, chunk("lo")), (1, 1, chunk("Hel")), (1, 0, ": ping"), (1, 3, "data: [DONE]"), (2, 0, 'data: {"error": {"message": "no"}}')], "conv_id int, seq int, line string")
    rows = relay.deltas(lines)
    got = {r.conv_id: (r.answer, r.done, r.error) for r in relay.answers(rows).collect()}
    assert got == {1: ("Hello", True, None), 2: ("", False, "no")}
    stream = "".join(r.sse for r in relay.events(rows).where("conv_id = 1").orderBy("seq").collect())
    assert [r.event for r in relay.parse_events(spark.createDataFrame([(1, stream)], "conv_id int, stream string")).orderBy("seq").collect()] == ["delta", "delta", "done"]


def test_run_and_refresh(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"line one of {k}\nline two", "s") for k in range(6)], "doc_id long, text string, source string")
    stats = pipeline.run(docs, str(tmp_path / "out")).first()
    assert stats.chunks == 6
    assert json.loads(spark.read.text(str(tmp_path / "out/manifest")).first()[0])["documents"] == {"s": 6}
    assert readers.read_chunks(spark, str(tmp_path / "out/chunks")).count() == 6
    docs.limit(4).coalesce(1).write.parquet(str(tmp_path / "in"))
    table = refresh.IndexTable(spark, str(tmp_path / "index"))
    start = lambda: refresh.refresh(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), pipeline.document_chunks, table, str(tmp_path / "cp")).awaitTermination()
    start()
    assert table.read().count() == 4
    docs.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start()
    assert table.read().count() == 6 and table.read().where("content_vector is null").count() == 0


def test_full_refresh(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text of {k}", "s") for k in range(4)], "doc_id long, text string, source string")
    table = refresh.IndexTable(spark, str(tmp_path / "index"))
    assert pipeline.refresh_index(docs, table).count() == 4
    got = pipeline.refresh_index(docs.where("doc_id > 0").unionByName(spark.createDataFrame([(9, "new", "s")], docs.schema)), table)
    assert sorted(r.doc_id for r in got.collect()) == ["ext-1", "ext-2", "ext-3", "ext-9"] and got.where("content_vector is null").count() == 0
    vectors = refresh.IndexTable(spark, str(tmp_path / "index-vectors"))
    assert vectors.read_all().count() == 5 and vectors.read().count() == 1
    with pytest.raises(ValueError):
        pipeline.refresh_index(docs.withColumn("text", F.lit("! ")).unionByName(docs), table)
    assert table.read().count() == 4
    table.clear()
    assert table.read().count() == 0


def test_markdown_files(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "rule", "A title", "u", "text"), ("d2", "rule", "B", None, "é")], "doc_id string, source_type string, title string, url string, text string")
    wrote = export.write_markdown(export.document_markdown(docs), str(tmp_path)).collect()
    assert {r.path for r in wrote} == {"markdown/rule/d1.md", "markdown/rule/d2.md"}
    assert (tmp_path / "markdown/rule/d1.md").read_text() == '---\ntitle: "A title"\nsource_type: "rule"\nurl: "u"\n---\n\n# A title\n\ntext\n'


def test_runs_of_parts():
    import random

    from lawloom.operators.chunking import runs

    r = random.Random(2)
    for _ in range(300):
        parts, limit = [r.randrange(1, 12) for _ in range(r.randrange(0, 40))], r.randrange(1, 40)
        want, at = [], 0
        while at < len(parts):
            end = at + 1
            while end < len(parts) and sum(parts[at : end + 1]) <= limit:
                end += 1
            want.append((at, end))
            at = end
        assert list(runs(parts, limit, sum)) == want


def test_pieces_counted_by_spark_are_those_of_python(spark):
    import random

    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["one.", "Two;", "three", "Four!", "five"]) for _ in range(n))
    rows = [(k, [{"kind": r.choice(["para", "item"]), "text": text(r.randrange(0, 40)), "table_header": None, "table_rows": None} for _ in range(r.randrange(0, 5))]) for k in range(40)]
    from lawloom.operators.chunking import with_pieces
    from lawloom.schemas import BLOCK

    got = with_pieces(spark.createDataFrame(rows, f"id int, blocks array<struct<{BLOCK.replace(' ', ':', 1).replace(', text ', ',text:').replace(', table_header ', ',table_header:').replace(', table_rows ', ',table_rows:')}>>"), limit=20).collect()
    assert {x.id: [p.asDict() for p in x.pieces] for x in got} == {k: pieces_of(b, 20, WORDS) for k, b in rows}


def test_deep_links_are_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)], "parent int, child int")
    roots = spark.createDataFrame([(0,)], "node int")
    assert verify.reachable(edges, roots).count() == 6
    with pytest.raises(ValueError):
        verify.reachable(edges, roots, max_rounds=3)


def test_vectors_of_their_own_table(spark):
    docs = spark.createDataFrame([(n, f"word{n % 3} other{n % 5}", f"t{n}", "b", "code" if n % 2 else "rule") for n in range(30)], "id long, content string, title string, breadcrumb string, source_type string")
    vectors = docs.select("id", "source_type", F.array(F.cos("id"), F.sin("id")).alias("content_vector"))
    queries = spark.createDataFrame([(1, "word1 other2", [1.0, 0.5])], "query_id int, text string, vector array<double>")
    joined = docs.join(vectors.drop("source_type"), "id")
    for one, two in ((retrieve.hybrid(docs, queries, 5, vectors=vectors), retrieve.hybrid(joined, queries, 5)), (retrieve.search(docs, queries, vectors=vectors), retrieve.search(joined, queries))):
        assert sorted(one.collect()) == sorted(two.collect()) and one.count() > 0


def test_all_benchmark_items_are_queries(spark, tmp_path):
    import duckdb

    docs = [(n, " ".join(f"word{(n % 7 * i) % 11}" for i in range(n % 9 + 1)) if n % 13 else None, "src1") for n in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [math.cos(n), math.sin(n)], n % 3) for n in range(30)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(n, f"Word{n} word{n + 3} other") for n in range(0, 60, 7)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as c:
        for name in ("documents", "embeddings", "benchmark"):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = sorted(c.execute(SQL["hybrid_rrf"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["hybrid_rrf"](spark, str(tmp_path)).collect())
    assert got == want and {r[0] for r in got} == set(range(0, 60, 7))


@pytest.mark.parametrize("held,tile,block,again", [(1 << 19, 512, 10_000, False), (40, 7, 3, False), (40, 7, 10_000, True)])
def test_lexical_top_is_that_of_all_pairs(spark, monkeypatch, held, tile, block, again):
    monkeypatch.setattr(retrieve, "HELD", held)
    monkeypatch.setattr(retrieve, "TILE", tile)
    docs = [(f"d{n}", " ".join(f"word{(n % 23 * i) % 17}" for i in range(n % 29)) if n % 13 else None) for n in range(300)] + [("e", ""), (None, "word3 \u0130 WORD4")]
    docs = spark.createDataFrame(docs + docs[:40] * again, "id string, content string").repartition(5)
    queries = spark.createDataFrame([(n, f"word{n} Word{n % 5 + 1} word{n % 3} i none") for n in range(12)] + [(50, None), (51, "nothing")], "query_id int, text string")
    want = retrieve.top(retrieve.bm25(docs, queries), 6)
    got = retrieve.bm25_top(docs, queries, 6, block=block)
    assert sorted((r.query_id, r["rank"], r.id or "", round(r.score, 8)) for r in got.collect()) == sorted((r.query_id, r["rank"], r.id or "", round(r.score, 8)) for r in want.collect())
    assert got.dtypes == want.dtypes and got.count() > 50
    empty = docs.limit(0)
    assert retrieve.bm25_top(empty, queries, 6).count() == 0 == retrieve.bm25_top(docs, queries.limit(0), 6).count()


def test_parsed_rows_leave_in_slices(spark):
    import pandas as pd

    pages = pd.DataFrame({"id": list("abcdefgh"), "html": ["x" * (markup.SLICE // 4)] * 7 + [None]})
    out = list(markup._in_slices(iter([pages]), lambda key, html: [{"id": key, "n": len(html or "")}] * 2, ["id", "n"]))
    assert [len(x) for x in out] == [8, 8] and [k for x in out for k in x["id"]] == [c for c in "abcdefgh" for _ in range(2)]
    markup.page_blocks(spark.createDataFrame([("a", "<p>b</p>")], "page_id string, html string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_walk_ends_where_the_sql_does(spark, tmp_path):
    import duckdb

    # A branch of 20 links, of which the query asks for 12, and cycles.
    ids = sorted({0, 1, 2, 5, 7, 10, 15, 16, 50, *(3**k for k in range(1, 21)), *(2 * 3**k for k in range(1, 21))})
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(c.execute(SQL["toc_traverse"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["toc_traverse"](spark, str(tmp_path)).collect())
    assert got == want and max(d for _, d in got) == 12


def test_queries_are_registered():
    assert set(SQL) <= set(QUERIES) and len(SQL) >= 35
