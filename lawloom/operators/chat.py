"""Conversations: guards, the retrieval query, sources, the prompt and its citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions.text import CITED, cited_numbers, crumb_without_leaf, empty_to_null, page_label, sse, strip, word_count

# Turns looked at, the size of a short question, and cuts of turns, questions and messages.
TURNS, SHORT, HISTORY_CHARS, QUERY_CHARS, QUESTION_CHARS, MESSAGE_CHARS, MESSAGES = 6, 12, 2000, 1000, 1000, 8000, 20
LABELS = {"code": "City code", "attachment": "Code attachment", "new_law": "New law", "state_statute": "State statute", "state_rule": "State rule", "state_guidance": "State guidance", "model_code_ref": "Model code"}
BETWEEN = "\n\n---\n\n"


def last_turns(turns: DataFrame, n: int = TURNS) -> DataFrame:
    """The last n user and assistant turns of each conversation."""
    own = turns.where(F.col("role").isin("user", "assistant"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return own.withColumn("_back", F.row_number().over(order)).where(F.col("_back") <= n).drop("_back")


def guards(turns: DataFrame) -> DataFrame:
    """conv_id and the reason why a request is refused, null if it isn't."""
    valid = (F.length("text") <= MESSAGE_CHARS) & F.col("role").isin("user", "assistant")
    last = F.max_by(F.struct("role", "text"), "turn").alias("last")
    each = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and(valid).alias("valid"), last)
    reason = (
        F.when(~F.col("valid") | (F.col("n") > MESSAGES), "invalid messages")
        .when(F.col("last.role") != "user", "last message must be from the user")
        .when(strip(F.col("last.text")) == "", "empty question")
        .when(F.length("last.text") > QUESTION_CHARS, "question too long")
    )
    return each.select("conv_id", reason.alias("reason"))


def retrieval_query(turns: DataFrame) -> DataFrame:
    """conv_id, query: the last user text, with the user text before it if it has under 12 words, each cut to 1,000 characters."""
    users = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.col("text").alias("text")))))
    each = turns.groupBy("conv_id").agg(users.alias("users")).where(F.size("users") > 0)
    back = lambda k: F.get("users", F.size("users") - k)["text"]
    cut = lambda x: F.substring(x, 1, QUERY_CHARS)
    long_ = F.concat_ws("\n", cut(back(2)), cut(back(1)))
    return each.select("conv_id", F.when((word_count(back(1)) < SHORT) & (F.size("users") > 1), long_).otherwise(cut(back(1))).alias("query"))


def source_labels(hits: DataFrame) -> DataFrame:
    """hits (query_id, n, ...) with label (citation or title, pages, and the kind of source) and the text for the prompt."""
    kinds = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    pages = F.when(F.col("page_start").isNotNull(), F.concat(F.lit(", "), page_label(F.col("page_start"), F.col("page_end")))).otherwise("")
    label = F.concat(F.coalesce(empty_to_null(F.col("citation")), F.col("title")), pages)
    kind = F.coalesce(F.element_at(kinds, F.col("source_type")), F.col("source_type"))
    return hits.withColumns({"label": label, "block": F.concat(F.format_string("[%d] ", "n"), label, F.lit(" ("), kind, F.lit(")\n"), "content")})


def prompt_context(hits: DataFrame) -> DataFrame:
    """query_id, context: the sources' texts in order of n."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "block")))
    return source_labels(hits).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), BETWEEN).alias("context"))


def prompts(turns: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """conv_id, messages: system, sources, the cut turns before, and the question."""
    recent = last_turns(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    past = F.transform(F.slice("turns", F.lit(1), F.greatest(F.size("turns") - 1, F.lit(0))), lambda t: F.struct(t["role"].alias("role"), F.substring(t["text"], 1, HISTORY_CHARS).alias("content")))
    head = F.array(message("system", F.lit(system)), message("system", F.concat(F.lit("Sources:\n\n"), F.coalesce("context", F.lit("")))))
    asked = F.array(message("user", F.get("turns", F.size("turns") - 1)["text"]))
    joined = recent.join(contexts.select(F.col("query_id").alias("conv_id"), "context"), "conv_id", "left")
    return joined.select("conv_id", F.concat(head, past, asked).alias("messages"))


def shown_sources(answers: DataFrame, hits: DataFrame, *, fallback: int = 3) -> DataFrame:
    """The hits (query_id, n) that an answer (query_id, answer) cites, or the first three if it cites none."""
    cited = answers.select("query_id", cited_numbers(F.col("answer")).alias("cited"))
    joined = hits.join(cited, "query_id")
    known = Window.partitionBy("query_id")
    any_cited = F.max(F.array_contains("cited", F.col("n")).cast("int")).over(known) == 1
    keep = F.when(F.col("_any"), F.array_contains("cited", F.col("n"))).otherwise(F.col("n") <= fallback)
    return joined.withColumn("_any", any_cited).where(keep).drop("_any", "cited")


def rendered(answer: Column) -> Column:
    """An answer as HTML: escaped, with bold, italics, citation links, list items and paragraphs."""
    from lawloom.functions.text import escape_html

    line = lambda x: F.regexp_replace(F.regexp_replace(x, r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), r"\*([^*]+)\*", "<em>$1</em>")
    linked = lambda x: F.regexp_replace(x, CITED, '<a class="cite" href="#source-$1">$0</a>')

    def one(x: Column) -> Column:
        item = F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])\s+", "")
        listed = x.rlike(r"^\s*(?:[-*]|\d+[.)])\s+")
        return F.when(x == "", "").when(listed, F.concat(F.lit("<li>"), linked(line(item)), F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), linked(line(F.regexp_replace(x, r"^#+\s*", ""))), F.lit("</p>")))

    lines = F.filter(F.transform(F.split(escape_html(answer), "\n"), one), lambda x: x != "")
    return F.regexp_replace(F.array_join(lines, ""), "((?:<li>.*?</li>)+)", "<ul>$1</ul>")


def source_events(hits: DataFrame) -> DataFrame:
    """query_id, event: the sources of each query as one server-sent event."""
    shown = source_labels(hits).withColumn("crumb", crumb_without_leaf(F.col("breadcrumb")))
    listed = F.array_sort(F.collect_list(F.struct("n", "label", "crumb", "url", "source_type")))
    return shown.groupBy("query_id").agg(sse("sources", F.to_json(listed)).alias("event"))
