"""String and JSON scalars as Column expressions. A null is treated as the empty string, as in the data model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOPWORDS = tuple("with up to this their the that or on of its it is into in from for by but be at as are and an a".split())
TOKEN = "[0-9a-z]+(?:['-][0-9a-z]+)?"
WORD = "[A-Za-z0-9']+"
WORD_LONG = "[0-9A-Za-z][-0-9A-Za-z_'’]*"
OUTER = r".,;:!?\"'()\[\]{}"


def text(c: Column) -> Column:
    """c as a string, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """c without white space of any kind at its ends (trim() knows spaces only)."""
    return F.regexp_replace(text(c), r"^\s+|\s+$", "")


def normalise_tag(c: Column) -> Column:
    """Lower case, only a-z, 0-9, hyphens and single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^-a-z0-9\s]", ""), r"\s+", " "))


def normalise_caption(c: Column, strip_outer: bool = False) -> Column:
    """Lower case, single spaces; with strip_outer also without punctuation at the ends."""
    out = strip(F.regexp_replace(F.lower(text(c)), r"\s+", " "))
    return strip(F.regexp_replace(out, f"^[{OUTER}]+|[{OUTER}]+$", "")) if strip_outer else out


def dedupe(a: Column, limit: int | None = None) -> Column:
    """Stripped, non-empty items in first-seen order, each once; the first `limit` of them."""
    out = F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), strip), lambda x: x != ""))
    return F.slice(out, 1, limit) if limit is not None else out


def parse_json_list(c: Column) -> Column:
    """The stripped, non-empty strings of a JSON list; an empty array for anything else. JSON nulls are dropped."""
    parsed = F.from_json(text(c), T.ArrayType(T.StringType()))
    return F.coalesce(F.filter(F.transform(parsed, lambda x: strip(x)), lambda x: x != ""), F.array().cast("array<string>"))


def parse_json_object(c: Column) -> Column:
    """A JSON object as a map of strings; an empty map for anything else."""
    return F.coalesce(F.from_json(text(c), T.MapType(T.StringType(), T.StringType())), F.create_map().cast("map<string,string>"))


def extract_json_object(c: Column) -> Column:
    """The JSON object in a model's answer: the answer without code fences, else from its first { to its last }; null if neither parses."""
    bare = strip(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)

    def valid(x: Column) -> Column:
        return F.when(x.startswith("{") & F.from_json(x, T.MapType(T.StringType(), T.StringType())).isNotNull(), x)

    return F.coalesce(valid(bare), valid(inner))


def tokens(c: Column) -> Column:
    """Lexical tokens, with inner hyphens and apostrophes, in order and with repeats."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0))


def content_tokens(c: Column, least: int = 3) -> Column:
    """Tokens of at least `least` characters that are no stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokens(c), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def simple_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))


def phrase(c: Column) -> Column:
    """Tokens with apostrophes joined by single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9']+"), F.lit(0)), " ")


def word_count(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_count(text(c), F.lit(pattern))


def phrases(c: Column, words: int = 8) -> Column:
    """Parts between punctuation, ' - ', ' and ' and ' with ', without quotes and brackets at the ends, cut at `words` words, each once."""
    parts = F.split(F.lower(text(c)), r"[,:;.!?]|\s+-\s+|\s+and\s+|\s+with\s+")
    tidy = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"""^[ '"()\[\]{}]+|[ '"()\[\]{}]+$""", ""))
    cut = F.transform(tidy, lambda p: F.array_join(F.slice(F.split(p, " "), 1, words), " "))
    return F.array_distinct(F.filter(cut, lambda p: p != ""))


def clip(c: Column, most: int) -> Column:
    """c if it has at most `most` characters, else its start up to the last space before that."""
    t = text(c)
    head = F.left(t, F.lit(most))
    return F.when(F.length(t) <= most, t).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*) ", 1), F.lit("")), head))


def split_on(c: Column, separator: str) -> Column:
    """Stripped non-empty parts between separators."""
    return F.filter(F.transform(F.split(text(c), re.escape(separator)), strip), lambda x: x != "")


def prefixed(c: Column, prefix: str) -> Column:
    """Values of space-separated `prefix---value` items."""
    mark = prefix + "---"
    return F.transform(F.filter(F.split(text(c), " "), lambda x: x.startswith(mark)), lambda x: F.substring(x, len(mark) + 1, 1 << 20))


def primary(a: Column, strategy: str = "longest") -> Column:
    """First or longest (the first of equals) item; empty if there is none."""
    if strategy == "first":
        return F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))
    return F.aggregate(a, F.lit(""), lambda m, x: F.when(F.length(x) > F.length(m), x).otherwise(m))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in columns), F.lit(""))


def combined(caption: Column, lyrics: Column) -> Column:
    return F.concat_ws(" ", F.nullif(strip(caption), F.lit("")), F.nullif(strip(lyrics), F.lit("")))


def tag_set(json_list: Column, csv: Column) -> Column:
    """Sorted distinct tags of a JSON list, or of a comma-separated column if the list has none."""
    parsed = parse_json_list(json_list)
    return F.sort_array(F.array_distinct(F.when(F.size(parsed) > 0, parsed).otherwise(split_on(csv, ","))))


def term_value(c: Column) -> Column:
    """Lower-case term; what follows its first colon, if it has one."""
    t = F.lower(strip(c))
    return F.when(F.instr(t, ":") > 0, strip(F.substring(t, F.instr(t, ":") + 1, F.lit(1 << 20)))).otherwise(t)


def parse_double(c: Column) -> Column:
    """Number of a string, null if it is none."""
    return strip(c).try_cast("double")
