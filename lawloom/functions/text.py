"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str methods and \s take it; Java's (?U)\s lacks U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Words that stay lower-case inside a title.
SMALL_WORDS = ["a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to"]
# Patterns of headings; group 1 is the number, group 2 the title.
HEADINGS = {
    "chapter": r"^Chapter\s+(\S+)\.(?:\s+(.*))?$",
    "part": r"^Part\s+(\S+)\.(?:\s+(.*))?$",
    "article": r"^Article\s+(\S+)\.(?:\s+(.*))?$",
    "section": r"^(?:§|Section)\s*(\S+)\.(?:\s+(.*))?$",
}
# An attachment's running footer, and the marks around text in pictures.
FOOTER = r"(?i)^\s*[\w-]+ Attachment \d+(?::\d+)?\s*$"
PICTURE = r"(?i)<!--\s*(?:Start|End) of picture text\s*-->|\**-+\s*(?:Start|End) of picture text\s*-+\**"
# The end of a sentence, and a citation mark such as [2] or [2: part B].
SENTENCE = r"(?<=[.;:!?])\s+(?=[A-Z(\"'])"
CITED = r"\[(\d{1,2})(?:[.,:;\s][^\]\n]{0,40})?\]"


# A citation at the start of a title, with a section or chapter mark or else of words; group 1 is the citation.
CITATIONS = [r"(?U)^(.*?(?:§|ch\.)\s*[\w-]+)\.\s", r"(?U)^(.+?\w{2,}[\w-]*)\.\s+[A-Z]"]
# Fixed value: the text that stands for a document that may not be copied.
STUB = "The full text of {title} is copyrighted and is not included in this assistant's sources. Read it at {url}"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def clean(x: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def empty_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def tidy(x: Column) -> Column:
    """``clean``, and no space before a comma, semicolon or full stop."""
    out = F.regexp_replace(x, f"{SPACE}+", " ")
    for mark in ",;.":
        out = F.replace(out, F.lit(f" {mark}"), F.lit(mark))
    return F.trim(out)


def slug(x: Column, size: int = 80) -> Column:
    dashed = F.lower(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.regexp_replace(F.substring(dashed, 1, size), "-+$", "")


def index_key(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9_\-=]", "_")


def cache_name(url: Column, binary: bool = False) -> Column:
    return F.concat(F.substring(F.sha1(url), 1, 16), F.lit(".bin" if binary else ".html"))


def vector_hash(model: str, dims: int, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}|{dims}|"), text), 256)


def citation_of(title: Column) -> Column:
    """The citation at the start of a title, or the whole title."""
    return F.coalesce(*[empty_to_null(F.regexp_extract(title, pattern, 1)) for pattern in CITATIONS], title)


def smart_title(x: Column) -> Column:
    """Title case, but small words inside stay lower-case."""
    words = F.split(clean(F.lower(x)), " ")
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])
    up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(up(w))), " ")


def line_key(x: Column) -> Column:
    """A line as it is compared across pages: no marks, one space, lower-case."""
    return F.lower(F.trim(F.regexp_replace(x, rf"(?:[#*_]|{SPACE})+", " ")))


def is_footer(x: Column) -> Column:
    return strip(F.translate(x, "*_#", "")).rlike(FOOTER)


def clean_picture_text(x: Column) -> Column:
    return F.when(x.rlike(PICTURE), clean(F.replace(F.regexp_replace(x, PICTURE, ""), F.lit("<br>"), F.lit(" ")))).otherwise(x)


def sentences(x: Column) -> Column:
    return F.split(x, SENTENCE)


def paragraphs(x: Column, bullets: bool = False) -> Column:
    """Stripped paragraphs between blank lines; with bullets, a line that starts a list item too is one."""
    parts = F.split(x, r"\n\s*\n|\n(?=- )" if bullets else r"\n\s*\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def md_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def indent(depth: Column) -> Column:
    return F.repeat(F.lit("  "), depth)


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("page %d", start)).otherwise(F.format_string("pages %d-%d", start, end))


def part_label(i: Column, n: Column) -> Column:
    return F.when(n > 1, F.format_string(" (part %d of %d)", i + 1, n)).otherwise("")


def heading_number(kind: Column, heading: Column) -> tuple[Column, Column]:
    """Number and title of a heading; without a match "" and the heading."""
    number, title = F.lit(""), heading
    for name, pattern in HEADINGS.items():
        own = (kind == name) & heading.rlike(pattern)
        number = F.when(own, F.regexp_extract(heading, pattern, 1)).otherwise(number)
        title = F.when(own, F.regexp_extract(heading, pattern, 2)).otherwise(title)
    return number, title


def section_citation(kind: Column, heading: Column, number: Column, chapter: Column, article: Column) -> Column:
    """``§ n``; in the charter with the outermost article; the heading for what is no section."""
    art = F.when(article.isNotNull(), F.concat(F.lit(" Art. "), article, F.lit(","))).otherwise("")
    charter = F.concat(F.lit("Charter"), art, F.lit(" § "), number)
    own = F.when(chapter == "C", charter).otherwise(F.concat(F.lit("§ "), number))
    return F.when(kind == "section", own).otherwise(F.regexp_replace(heading, r"\.+$", ""))


def zero_padded(x: Column, size: int = 3) -> Column:
    """Padded but never cut, unlike lpad."""
    return F.when(F.length(x) < size, F.lpad(x, size, "0")).otherwise(x)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def url_quote(x: Column) -> Column:
    """Percent-encoding that keeps / and writes a space as %20."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url_unquote(x: Column) -> Column:
    """Percent-decoding that keeps +."""
    return F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def through_date(x: Column) -> Column:
    return empty_to_null(F.regexp_extract(x, r"through (\d{2}-\d{2}-\d{4})", 1))


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The last entry of the forwarding header, else the peer."""
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(empty_to_null(last), peer, F.lit("unknown"))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_replace(x, f"{SPACE}+", " "), " "), lambda w: w != ""))


def crumbs_of(path: Column) -> Column:
    """Title and chapter levels of a statute's path, the names of chapters in title case."""
    kept = F.filter(path, lambda p: p.rlike("^(Title|Chapter|Subchapter)"))
    name = lambda p: F.when(F.instr(p, ":") > 0, F.substring(p, F.instr(p, ":") + 1, F.length(p))).otherwise("")
    one = lambda p: F.when(p.startswith("Title"), F.trim(F.substring_index(p, ":", 1))).otherwise(
        F.concat(F.trim(F.substring_index(p, ":", 1)), F.lit(": "), smart_title(name(p)))
    )
    return F.transform(kept, one)


def stub_text(summary: Column, title: Column, url: Column, sentence: str = STUB) -> Column:
    """The summary, and a sentence with the title's first part and the url in their places."""
    filled = F.replace(F.replace(F.lit(sentence), F.lit("{title}"), F.substring_index(title, ". ", 1)), F.lit("{url}"), url)
    return F.concat(summary, F.lit("\n\n"), filled)


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def cited_numbers(answer: Column) -> Column:
    """Distinct numbers cited in an answer, in order of their first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITED), F.lit(1)), lambda n: n.cast("int")))


def crumb_without_leaf(crumb: Column) -> Column:
    parts = F.split(crumb, " > ")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " > ")


def sse(event: str, data: Column) -> Column:
    """A server-sent event with JSON data."""
    return F.concat(F.lit(f"event: {event}\ndata: "), data, F.lit("\n\n"))


def front_matter(fields: list[tuple[str, Column, str]]) -> Column:
    """Front matter of (name, value, type): null, "" and [] are left out; strings are JSON, arrays have ", " between items."""
    quoted = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    lines = []
    for name, value, kind in fields:
        if kind == "string":
            text = F.when(value != "", quoted(value))
        elif kind == "array":
            text = F.when(F.size(value) > 0, F.concat(F.lit("["), F.array_join(F.transform(value, quoted), ", "), F.lit("]")))
        else:
            text = value.cast("string")
        lines.append(F.when(text.isNotNull(), F.concat(F.lit(f"{name}: "), text)))
    body = F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")
    return F.concat(F.lit("---\n"), F.when(body != "", F.concat(body, F.lit("\n"))).otherwise(""), F.lit("---\n\n"))
