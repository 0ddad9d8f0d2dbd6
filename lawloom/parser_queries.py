"""Queries of the parsers and text functions over rows made from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawloom.functions import text as T
from lawloom.operators import chat, export, index, markup, validate
from lawloom.queries import query, table
from lawloom.sources.registry import require_chunks, route
from lawloom.streaming import relay

# -- text functions


@query(r"SELECT page_id, replace(replace(replace(trim(regexp_replace(url || ' , b ;  c .', '\s+', ' ', 'g')), ' ,', ','), ' ;', ';'), ' .', '.') AS tidy FROM pages")
def tidy_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.tidy(F.concat("url", F.lit(" , b ;  c ."))).alias("tidy"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id || '-A M.R.S. § ' || doc_id WHEN 1 THEN source || ' code' ELSE 'no mark ' || doc_id END AS citation FROM documents""")
def citation_starts(spark, sf_dir):
    kinds = (
        F.when(F.col("doc_id") % 3 == 0, F.concat("doc_id", F.lit("-A M.R.S. § "), "doc_id", F.lit(". Enforcement of "), "lang"))
        .when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(" code. Building")))
        .otherwise(F.concat(F.lit("no mark "), "doc_id"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", T.citation_of(kinds).alias("citation"))


@query(r"""SELECT item_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ('a', 'an', 'and', 'as', 'at', 'by', 'for', 'in', 'of', 'on', 'or', 'the', 'to')
    THEN x ELSE CASE WHEN x[1] = 'ß' THEN 'SS' ELSE upper(x[1]) END || x[2:] END), ' ') AS title FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM benchmark)""")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.smart_title(F.col("text")).alias("title"))


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS file, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem,
    replace(url_encode('a/' || page_id || ' ~*'), '%2F', '/') AS quoted, 'x y+' || page_id AS unquoted, CASE WHEN page_id < 100 THEN lpad(page_id::VARCHAR, 3, '0') ELSE page_id::VARCHAR END AS padded FROM pages""")
def path_parts(spark, sf_dir):
    number = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.file_name(F.col("url")).alias("file"), T.file_stem(F.col("url")).alias("stem"), T.url_quote(F.concat(F.lit("a/"), number, F.lit(" ~*"))).alias("quoted"),
        T.url_unquote(F.concat(F.lit("x%20y+"), number)).alias("unquoted"), T.zero_padded(number).alias("padded"),
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN event_id % 2 = 0 THEN '0' || (event_id % 9 + 1) || '-15-2026' END AS through,
    CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || event_id % 200 WHEN event_id % 3 = 1 THEN 'peer' ELSE 'unknown' END AS ip FROM events""")
def request_fields(spark, sf_dir):
    month = F.concat(F.lit("0"), F.col("event_id") % 9 + 1, F.lit("-15-2026"))
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Current through "), month, F.lit("."))).otherwise("No date")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("1.2.3.4, 10.0.0."), F.col("event_id") % 200))
    peer = F.when(F.col("event_id") % 3 == 1, F.lit("peer"))
    return table(spark, sf_dir, "events").select("event_id", T.iso_utc(F.col("ts")).alias("iso"), T.through_date(line).alias("through"), T.client_ip(forwarded, peer).alias("ip"))


@query("""SELECT doc_id, ['Title ' || doc_id, 'Chapter ' || doc_id % 9 || ': Of ' || upper(source[1]) || source[2:] || ' and Use'] AS crumbs, 'a > ' || source AS above FROM documents""")
def statute_crumbs(spark, sf_dir):
    path = F.array(F.concat(F.lit("Title "), "doc_id", F.lit(": TOWNS")), F.lit("Part 2: X"), F.concat(F.lit("Chapter "), F.col("doc_id") % 9, F.lit(": OF "), F.upper("source"), F.lit(" AND USE")))
    above = T.crumb_without_leaf(F.concat(F.lit("a > "), "source", F.lit(" > leaf")))
    return table(spark, sf_dir, "documents").select("doc_id", T.crumbs_of(path).alias("crumbs"), above.alias("above"))


@query("""SELECT doc_id, 'About ' || source || chr(10) || chr(10) || 'The full text of Model ' || doc_id || ' is copyrighted and is not included in this assistant''s sources. Read it at https://x.org/' || doc_id AS body FROM documents""")
def stub_bodies(spark, sf_dir):
    title, url = F.concat(F.lit("Model "), "doc_id", F.lit(". Building code")), F.concat(F.lit("https://x.org/"), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.stub_text(F.concat(F.lit("About "), "source"), title, url).alias("body"))


@query(r"""WITH l AS (SELECT item_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM (SELECT item_id, string_split(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')
        || ' **b** [2]' || chr(10) || '- one *i*' || chr(10) || '2) two' || chr(10) || '# Head', chr(10)) AS w FROM benchmark WHERE text IS NOT NULL)),
    m AS (SELECT item_id, i, regexp_matches(x, '^\s*([-*]|\d+[.)])\s+') AS item, regexp_replace(CASE WHEN regexp_matches(x, '^\s*([-*]|\d+[.)])\s+') THEN regexp_replace(x, '^\s*([-*]|\d+[.)])\s+', '') ELSE regexp_replace(x, '^#+\s*', '') END, '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g') AS x FROM l WHERE x <> ''),
    h AS (SELECT item_id, i, item, regexp_replace(regexp_replace(x, '\*([^*]+)\*', '<em>\1</em>', 'g'), '\[(\d+)\]', '<a class="cite" href="#source-\1">[\1]</a>', 'g') AS x FROM m)
    SELECT b.item_id, CASE WHEN b.text IS NOT NULL THEN regexp_replace(string_agg(CASE WHEN item THEN '<li>' || x || '</li>' ELSE '<p>' || x || '</p>' END, '' ORDER BY i), '((?:<li>.*?</li>)+)', '<ul>\1</ul>', 'g') END AS html
    FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY b.item_id, b.text""")
def rendered_answers(spark, sf_dir):
    """All benchmark texts, with marks of each kind added."""
    marks = F.lit(" **b** [2]\n- one *i*\n2) two\n# Head")
    return table(spark, sf_dir, "benchmark").select("item_id", chat.rendered(F.concat("text", marks)).alias("html"))


@query("""SELECT doc_id, '---' || chr(10) || 'title: ' || to_json(source)::VARCHAR || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'tags: [' || to_json(lang)::VARCHAR || ', "x"]' || chr(10) ELSE '' END || 'n: ' || doc_id || chr(10) || '---' || chr(10) || chr(10) AS meta FROM documents WHERE lang IS NOT NULL""")
def front_matters(spark, sf_dir):
    tags = F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit("x")))
    meta = T.front_matter([("title", F.col("source"), "string"), ("empty", F.lit(""), "string"), ("tags", tags, "array"), ("n", F.col("doc_id"), "int")])
    return table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", meta.alias("meta"))


# -- pages of law, written from documents

_ESCAPED = lambda x: T.escape_html(T.clean(F.col(x)))
_CLEAN = r"trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))"


def _chapter_pages(spark, sf_dir):
    """A chapter for each document: one article, in it a section with the text as a paragraph, a history and a table."""
    docs = table(spark, sf_dir, "documents").where(T.clean(F.col("text")) != "")
    at = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<div id="content"><h2 class="chapterTitle title" id="c'), at, F.lit('">Chapter '), at, F.lit('. Of things</h2><h4 class="articleTitle title" id="a'), at,
        F.lit('">Article I. </h4><h4 class="sectionTitle title" id="s'), at, F.lit('">§ 2-'), at, F.lit('. Text</h4><div class="section_content content"><div class="para">'), _ESCAPED("text"),
        F.lit('</div><div class="history"><span class="loclaw">Law '), at, F.lit('</span></div><div class="codeTable"><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td colspan="2">x</td></tr><tr><td>1</td><td>n'),
        at, F.lit("</td></tr></tbody></table></div></div></div>"),
    )
    return docs.select("doc_id", html.alias("html"))


@query(rf"""SELECT doc_id::VARCHAR AS doc_id, n.i::INTEGER AS node_ix, n.guid || doc_id AS guid, CASE n.i WHEN 1 THEN 'c' || doc_id WHEN 2 THEN 'a' || doc_id END AS parent_guid, n.kind AS kind,
        CASE n.i WHEN 0 THEN 'Chapter ' || doc_id || '. Of things' WHEN 1 THEN 'Article I.' ELSE '§ 2-' || doc_id || '. Text' END AS heading,
        CASE n.i WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'I' ELSE '2-' || doc_id END AS number, CASE n.i WHEN 0 THEN 'Of things' WHEN 1 THEN '' ELSE 'Text' END AS title,
        CASE WHEN n.i = 2 THEN 'Law ' || doc_id ELSE '' END AS laws,
        CASE WHEN n.i = 2 THEN {_CLEAN} || '~*Law ' || doc_id || '*~| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| x |  |' || chr(10) || '| 1 | n' || doc_id || ' |' ELSE '' END AS body
    FROM documents, (VALUES (0, 'c', 'chapter'), (1, 'a', 'article'), (2, 's', 'section')) n(i, guid, kind) WHERE {_CLEAN} <> ''""")
def chapter_nodes(spark, sf_dir):
    nodes = markup.chapter_tree(_chapter_pages(spark, sf_dir))
    body = F.array_join(F.transform("blocks", lambda b: b["text"]), "~")
    return nodes.select("doc_id", "node_ix", "guid", "parent_guid", "kind", "heading", "number", "title", F.array_join("ordinances", ",").alias("laws"), body.alias("body"))


@query(rf"""SELECT 'code-' || doc_id AS doc_id, '§ 2-' || doc_id AS citation, 'Law ' || doc_id AS history,
        'Chapter ' || doc_id || '. Of things > Article I. > § 2-' || doc_id || '. Text' AS breadcrumb, 'code-s' || doc_id || '-' AS id_head, true AS gapless
    FROM documents WHERE {_CLEAN} <> ''""")
def code_chunk_heads(spark, sf_dir):
    """What all chunks of each section of the chapters above have in common, and whether their keys are numbered without a gap."""
    nodes = markup.chapter_tree(_chapter_pages(spark, sf_dir)).withColumn("division", F.lit(None).cast("string"))
    chunks = export.code_chunks(nodes, name="Town", base_url="https://x.org")
    head, at = F.regexp_extract("id", r"^(.*-)\d+$", 1), F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    numbered = (F.min(at) == 0) & (F.max(at) + 1 == F.count("*")) & (F.count_distinct(at) == F.count("*"))
    return chunks.groupBy("doc_id", "citation", "history", "breadcrumb", head.alias("id_head")).agg(numbered.alias("gapless"))


@query("""SELECT source AS doc_id, (i - 1)::INTEGER AS ix, 'g' || id AS guid, 'chapter' AS kind, 'Chapter ' || id AS full_title, 'Division ' || source AS division
    FROM (SELECT source, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY source))""")
def contents_rows(spark, sf_dir):
    """A contents page for each source, with a division and a row for each document."""
    entry = lambda d: F.concat(F.lit('<div class="contentTitle" data-guid="g'), d.cast("string"), F.lit('" data-code-content-type="chapter" data-full-title="Chapter '), d.cast("string"), F.lit('">x</div>'))
    ids = F.array_sort(F.collect_list("doc_id"))
    head = F.concat(F.lit('<nav id="toc"><div class="contentTitle" data-guid="d" data-code-content-type="division" data-full-title="Division '), "source", F.lit('">x</div>'))
    pages = table(spark, sf_dir, "documents").groupBy("source").agg(ids.alias("ids")).select("source", F.concat(head, F.array_join(F.transform("ids", entry), ""), F.lit("</nav>")).alias("html"))
    return markup.parsed(pages, markup.toc_rows, "guid string, kind string, full_title string, division string", id_col="source")


@query(rf"""SELECT doc_id::VARCHAR AS doc_id, 0 AS ix, '§' || doc_id || '. Name' AS heading, 'Title ' || doc_id || ': A|Chapter 1: B' AS path,
    CASE WHEN text IS NULL OR {_CLEAN} = '' THEN '' ELSE replace(replace(replace({_CLEAN}, ' ,', ','), ' ;', ';'), ' .', '.') || CASE WHEN regexp_full_match({_CLEAN}, '[\p{{L}}\p{{N}}_()-]+\.') THEN ' (Repealed)' ELSE '' END || '|' END || '3. (Repealed)' AS body,
    'PL 1, c. ' || doc_id AS history FROM documents""")
def statute_pages(spark, sf_dir):
    at = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    html = F.concat(
        F.lit('<div class="heading_structure"><div class="toc">Title '), at, F.lit(': A</div><div class="toc">Chapter 1: B</div></div><div class="MRSSection"><h3 class="heading_section">§'), at,
        F.lit('. Name</h3><div class="mrs-text">'), _ESCAPED("text"), F.lit(' <span class="bhistory">gone</span></div><div class="mrs-text">3.</div></div><div class="qhistory_list">PL 1, c. '), at, F.lit("</div>"),
    )
    one = lambda page: [{"heading": s["heading"], "path": "|".join(s["path"]), "body": "|".join(b["text"] for b in s["blocks"]), "history": s["history"]} for s in [markup.statute(page)]]
    return markup.parsed(docs.select("doc_id", html.alias("html")), one, "heading string, path string, body string, history string")


@query(rf"""SELECT doc_id::VARCHAR AS id, 'Page ' || doc_id AS title, b.i::INTEGER AS block_ix,
        CASE b.i WHEN 0 THEN '## Part ' || doc_id WHEN 1 THEN '- item one' ELSE replace(replace(replace({_CLEAN}, ' ,', ','), ' ;', ';'), ' .', '.') END AS text
    FROM documents, (VALUES (0), (1), (2)) b(i) WHERE b.i < 2 OR length(replace(replace(replace({_CLEAN}, ' ,', ','), ' ;', ';'), ' .', '.')) > 2""")
def web_page_leaves(spark, sf_dir):
    """Pages with navigation, a sidebar and a list around the text of each document."""
    at = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    html = F.concat(
        F.lit("<html><body><nav><p>menu entry</p></nav><main><h1>Page "), at, F.lit('</h1><div class="sidebar"><p>aside text</p></div><h2>Part '), at, F.lit("</h2><ul><li>Home</li><li>item one</li></ul><p>"),
        _ESCAPED("text"), F.lit("</p><p>ok</p></main><footer><p>below the page</p></footer></body></html>"),
    )
    return markup.page_blocks(docs.select("doc_id", html.alias("html")), id_col="doc_id").select("id", "title", "block_ix", "text")


@query("""SELECT source AS doc_id, (i - 1)::INTEGER AS ix, id::VARCHAR AS id, 'T' || id AS title, 'S' AS subject, '2026-01-0' || (id % 9 + 1) AS adopted, 'Ord' AS type, '/l/' || id AS href
    FROM (SELECT source, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM documents WHERE doc_id % 5 > 0 GROUP BY source))""")
def new_laws(spark, sf_dir):
    """A table of new laws for each source; every fifth row has no link and is left out."""
    cell = lambda d: F.concat(
        F.lit('<tr data-document-id="'), d.cast("string"), F.lit('" data-title="T'), d.cast("string"), F.lit('" data-subject=" S " data-adopted="2026-01-0'), (d % 9 + 1).cast("string"), F.lit('" data-legislation-type="Ord"><td>'),
        F.when(d % 5 > 0, F.concat(F.lit('<a class="law" href="/l/'), d.cast("string"), F.lit('">law</a>'))).otherwise("none"), F.lit("</td></tr>"),
    )
    pages = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform("ids", cell), ""), F.lit("</table>"))
    return markup.parsed(pages.select("source", html.alias("html")), markup.new_law_rows, "id string, title string, subject string, adopted string, type string, href string", id_col="source")


# -- rows of chunks, streams and sources


@query("""WITH c AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'bad key ' || doc_id ELSE 'ext-' || (doc_id - doc_id % 7 % 2) END AS id, doc_id, octet_length(encode(text)) AS size FROM documents)
    SELECT id, 'bad key ' || id AS error FROM c WHERE doc_id % 4 = 0
    UNION ALL SELECT id, 'duplicate key ' || id FROM (SELECT id, unnest(range(1, count(*))) FROM c GROUP BY id)
    UNION ALL SELECT id, id || ': field other not in index' FROM c
    UNION ALL SELECT id, id || ': token_count is not int' FROM c WHERE doc_id % 6 = 0""")
def validation_rules(spark, sf_dir):
    """Keys, repeats, unknown fields and values out of a field's range."""
    key = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("bad key "), "doc_id")).otherwise(F.concat(F.lit("ext-"), F.col("doc_id") - F.col("doc_id") % 7 % 2))
    count = F.when(F.col("doc_id") % 6 == 0, F.lit(1 << 40)).otherwise(F.col("n_chars"))
    return validate.validation_errors(table(spark, sf_dir, "documents").select(key.alias("id"), F.lit("x").alias("content"), count.alias("token_count"), F.lit(1).alias("other")))


@query("""SELECT conv_id || '-' || turn AS conv_id, coalesce(text, '') || ' & more' AS answer, conv_id % 2 = 0 AS done, CASE WHEN conv_id % 3 = 0 THEN 'The answer was filtered.' END AS error
    FROM conversations""")
def relayed_answers(spark, sf_dir):
    """A model's event lines for each turn, as deltas and events, and put together again."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "conv_id", "text")
    said = lambda text: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("delta"))).alias("choices"))))
    stop = F.when(F.col("conv_id") % 3 == 0, F.lit('data: {"choices":[{"delta":{},"finish_reason":"content_filter"}]}')).otherwise(": keep alive")
    done = F.when(F.col("conv_id") % 2 == 0, F.lit("data: [DONE]")).otherwise("")
    lines = turns.select(F.col("key").alias("conv_id"), F.posexplode(F.array(said(F.col("text")), said(F.lit(" & more")), stop, done)).alias("seq", "line"))
    return relay.answers(relay.deltas(lines))


@query("""SELECT conv_id, 'event: delta' || chr(10) || 'data: {"text":"t' || conv_id || '"}' || chr(10) || chr(10) AS sse FROM (SELECT DISTINCT conv_id FROM conversations)""")
def relayed_events(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    rows = ids.select("conv_id", F.lit(0).alias("seq"), F.lit("delta").alias("event"), F.concat(F.lit("t"), "conv_id").alias("data"))
    return relay.events(rows).select("conv_id", "sse")


@query("""SELECT doc_id % 30 AS query_id, doc_id // 30 + 1 AS n FROM documents WHERE CASE WHEN doc_id % 30 % 2 = 0 THEN doc_id // 30 + 1 IN (2, 4) ELSE doc_id // 30 + 1 <= 3 END""")
def shown_sources(spark, sf_dir):
    """Answers that cite the second and fourth source, and answers that cite none."""
    hits = table(spark, sf_dir, "documents").select((F.col("doc_id") % 30).alias("query_id"), (F.floor(F.col("doc_id") / 30) + 1).alias("n"))
    answers = hits.select("query_id").distinct().withColumn("answer", F.when(F.col("query_id") % 2 == 0, "so [2] and [4: b]").otherwise("no source"))
    return chat.shown_sources(answers, hits.withColumn("n", F.col("n").cast("int"))).select("query_id", F.col("n").cast("long").alias("n"))


@query("""SELECT id, body FROM (SELECT 's' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'About it' || chr(10) || chr(10) || 'The full text of T' || doc_id || ' is copyrighted and is not included in this assistant''s sources. Read it at u'
    WHEN 1 THEN 'one paragraph' || chr(10) || chr(10) || 'and ' || doc_id ELSE 'web text of ' || doc_id END AS body FROM documents)""")
def routed_sources(spark, sf_dir):
    """Registry rows of three kinds, each through its own reader."""
    docs, at = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    kind = F.when(F.col("doc_id") % 3 == 0, "reference").when(F.col("doc_id") % 3 == 1, "md").otherwise("web")
    content = F.when(kind == "md", F.concat(F.lit("one paragraph\n\nand "), at)).when(kind == "web", F.concat(F.lit("<main><p>web text of "), at, F.lit("</p></main>")))
    rows = docs.select(
        F.concat(F.lit("s"), at).alias("id"), F.concat(F.lit("T"), at, F.lit(". Code")).alias("title"), F.lit("u").alias("url"), F.lit("rule").alias("kind"), F.when(kind == "reference", kind).otherwise("ingest").alias("tier"),
        F.when(kind == "md", F.concat(at, F.lit(".md"))).alias("file"), F.lit("About it").alias("summary"), content.alias("text"), F.lit(None).cast("binary").alias("data"),
    )
    found = route(rows)
    require_chunks(rows.select(F.col("id").alias("doc_id")), found.select(F.col("id").alias("doc_id")))
    return found.select("id", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("body"))


@query("""SELECT 'ext-' || doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'new' ELSE 'old' END AS state FROM documents d LEFT JOIN labels l USING (doc_id) WHERE doc_id % 3 = 2 OR l.doc_id IS NOT NULL""")
def pushed_index(spark, sf_dir):
    """An index after an upload: rows of other owners stay, owned ones that are not uploaded go."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    own = F.when(F.col("doc_id") % 3 == 2, "other-").otherwise("ext-")
    old = docs.select(F.concat(own, "doc_id").alias("id"), F.lit("old").alias("state"))
    new = labels.select(F.concat(own, "doc_id").alias("id"), F.lit("new").alias("state"))
    return index.push(old, new).select(F.concat(F.lit("ext-"), F.substring_index("id", "-", -1)).alias("id"), "state")


