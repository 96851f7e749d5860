"""Text functions as Columns. Whitespace is the class of ECMAScript, spelt out, since engines differ on ``\\s``; offsets
count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EMPTY_PAGE_SUMMARY, MAX_TERMS, SNIPPET_MARGIN, STOP_WORDS, SUMMARY_PHRASES

WS_CHARS = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS, NOT_WS = f"[{WS_CHARS}]", f"[^{WS_CHARS}]"
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"  # WS, one by one
SEPARATORS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"  # what trim() of DuckDB takes away: no line ends or tabs


def trim(c: Column, spaces: str = SPACES) -> Column:
    return F.trim(c, F.lit(spaces))


def normalize_whitespace(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(NOT_WS)


def normalize_summary(c: Column, fallback: str = EMPTY_PAGE_SUMMARY) -> Column:
    return F.coalesce(F.nullif(normalize_whitespace(c), F.lit("")), F.lit(fallback))


def normalize_extracted(c: Column) -> Column:
    """Without NUL characters, trimmed."""
    return trim(F.replace(c, F.lit("\x00"), F.lit("")))


def tokens(c: Column) -> Column:
    """Words between whitespace. Spaces are made alike and cut at: a class of so many ranges costs a regular expression several
    times as much."""
    return F.array_remove(F.split(F.translate(c, SPACES, " " * len(SPACES)), " "), "")


def keyword_terms(c: Column) -> Column:
    """First distinct terms of a query: runs of [a-z0-9] and inner . _ / -, of three characters or with a digit, and no
    stop words."""
    terms = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9][a-z0-9._/-]*)"), F.lit(1))
    use = F.filter(terms, lambda t: ((F.length(t) >= 3) | t.rlike("[0-9]")) & ~t.isin(STOP_WORDS))
    return F.slice(F.array_distinct(use), 1, MAX_TERMS)


def lexical_query(c: Column) -> Column:
    terms = keyword_terms(c)
    return F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(trim(c))


def routes_to_summaries(c: Column) -> Column:
    return F.lower(c).rlike(f"(^|[^a-z0-9_])({SUMMARY_PHRASES})([^a-z0-9_]|$)")


def fallback_route(c: Column) -> Column:
    """The routing decision without a model: (standalone_query, retrieval_mode)."""
    return F.struct(
        F.coalesce(F.nullif(normalize_whitespace(c), F.lit("")), c).alias("standalone_query"),
        F.when(routes_to_summaries(c), "summaries").otherwise("chunks").alias("retrieval_mode"),
    )


def embedding_input(text: Column, chunk_index: Column) -> Column:
    """What is embedded for a chunk; a blank one is named by its index."""
    return F.when(is_blank(text), F.concat(F.lit("[No extractable text found in chunk "), chunk_index.cast("string"), F.lit(" of the PDF.]"))).otherwise(text)


def leading_integer(c: Column) -> Column:
    """An index given as text: its leading integer, else 0."""
    return F.coalesce(F.regexp_extract(c, rf"^{WS}*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def anchor_places(segments: Column) -> Column:
    """Begin and end of half-open slices of a text, one after the other. Indices may be text, empty or missing (0); a slice whose
    end lies before its start is empty; negative indices count as 0."""
    at = lambda s, name: F.greatest(leading_integer(s[name]), F.lit(0))
    return F.coalesce(F.flatten(F.transform(segments, lambda s: F.array(at(s, "startIndex"), at(s, "endIndex")))), F.array().cast("array<int>"))


def locate(needle: Column, hay: Column) -> Column:
    """Offset of the first literal occurrence, -1 if there is none."""
    return F.locate(needle, hay) - 1 if isinstance(needle, str) else (F.instr(hay, needle) - 1)


def snippet(text: Column, start: Column, end: Column) -> Column:
    """A passage with a margin on both sides; whether it is cut is decided before trimming."""
    a = F.greatest(start - SNIPPET_MARGIN, F.lit(0))
    b = F.least(end + SNIPPET_MARGIN, F.length(text))
    head = F.when(a > 0, "...").otherwise("")
    tail = F.when(b < F.length(text), "...").otherwise("")
    return F.concat(head, trim(F.substring(text, a + 1, b - a)), tail)


def conversation_title(c: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(trim(c), 1, 80), F.lit("")), F.lit("New conversation"))


def document_title(filename: Column) -> Column:
    return F.coalesce(F.nullif(trim(F.regexp_replace(filename, r"(?i)\.pdf$", "")), F.lit("")), F.lit("Untitled PDF"))


def object_name(prefix: Column, id_: Column, filename: Column) -> Column:
    return F.concat_ws("/", prefix, id_, F.regexp_replace(filename, "[^a-zA-Z0-9._-]+", "_"))


def parse_object_uri(c: Column) -> Column:
    """(bucket, object) of gs://bucket/object; null if it isn't one."""
    pattern = "^gs://([^/]+)/(.+)$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("bucket"), F.regexp_extract(c, pattern, 2).alias("object")))


def error_message(c: Column) -> Column:
    return F.when(F.length(c) > 240, F.concat(F.substring(c, 1, 237), F.lit("..."))).otherwise(c)


def middle_truncated(c: Column, most: int) -> Column:
    edge = (most - 3) // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, edge), F.lit("..."), F.right(c, F.lit(edge))))


def file_size(c: Column) -> Column:
    kb, mb = c / 1024.0, c / 1048576.0
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1048576, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("page "), start.cast("string"))).otherwise(F.concat(F.lit("pages "), start.cast("string"), F.lit("-"), end.cast("string")))


def clamp_page(page: Column, pages: Column) -> Column:
    return F.least(F.greatest(page, F.lit(1)), pages)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "").try_cast("int")


def initial(c: Column) -> Column:
    return F.upper(F.substring(c, 1, 1))


def decode_credentials(c: Column) -> Column:
    """JSON, or JSON in base64, as JSON text; null if it is neither."""
    raw = F.to_json(F.try_parse_json(c))
    return F.coalesce(raw, F.to_json(F.try_parse_json(F.try_to_binary(c, F.lit("base64")).cast("string"))))


def timestamp_label(ts: Column) -> Column:
    """Medium date and short time, as in English: Jan 5, 2024, 3:07 PM."""
    return F.date_format(ts, "MMM d, yyyy, h:mm a")


def title_prefix(c: Column, most: int = 40) -> Column:
    return F.substring(c, 1, most)


def every(items: Column, fine) -> Column:
    return F.forall(items, fine)


def some(items: Column, fine) -> Column:
    return F.exists(items, fine)


def find_first(items: Column, fine) -> Column:
    """The first element for which fine holds, in order; null if there is none."""
    return F.try_element_at(F.filter(items, fine), F.lit(1))


def setting(spark, name: str, default: str | None = None) -> str | None:
    """A value of the session's configuration under pagewright., else the default; blank counts as unset."""
    value = spark.conf.get(f"pagewright.{name}", None)
    return value if value and value.strip() else default
