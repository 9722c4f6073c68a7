"""Text functions as column expressions; everything here stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\x{3000}\x{00a0}]+|[\s\x{3000}\x{00a0}]+$"
TECH_TOKEN = r"[a-zA-Z][a-zA-Z0-9.+#_-]*|[0-9][a-zA-Z0-9.+#_-]*"
HAN = r"\x{4e00}-\x{9fff}"


def strip(c: Column) -> Column:
    """Without white space at both ends, ideographic and non-breaking blanks included."""
    return F.regexp_replace(c, _EDGE, "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def clean_list(c: Column) -> Column:
    """Stripped, non-empty, each once in the order of first occurrence; null becomes an empty list."""
    kept = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(kept)


def normal_email(c: Column) -> Column:
    return F.when(~blank(c), F.lower(strip(c)))


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def tokens(c: Column, user_words: Sequence[str] = ()) -> Column:
    """Lower-cased technical tokens and words of Han text, repeats kept.

    Without a segmentation dictionary Han runs give the given user words (longest first) and character pairs of the rest;
    a single character stands for itself.
    """
    words = "|".join(re.escape(w) for w in sorted(user_words, key=len, reverse=True))
    run = rf"[{HAN}]+?(?={words}|[^{HAN}]|$)" if words else rf"[{HAN}]+"
    pattern = f"{words}|{TECH_TOKEN}|{run}" if words else f"{TECH_TOKEN}|{run}"
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    known = F.array(*[F.lit(w) for w in user_words]) if user_words else F.array().cast("array<string>")

    def parts(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(t.rlike(f"^[{HAN}]") & ~F.array_contains(known, t) & (F.length(t) > 2), pairs).otherwise(F.array(F.lower(t)))

    return F.flatten(F.transform(found, parts))


def shared_terms(a: Column, b: Column, most: int = 12) -> Column:
    return F.slice(F.array_sort(F.array_intersect(tokens(a), tokens(b))), 1, most)


def snippet(c: Column, size: int = 320) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def language(c: Column) -> Column:
    """zh if Han characters exceed 8 and 4 % of the text, or if the text is empty; else en."""
    han = F.length(F.regexp_replace(c, rf"[^{HAN}]", ""))
    return F.when(blank(c), "zh").when(han > F.greatest(F.lit(8.0), F.length(c) * 0.04), "zh").otherwise("en")


def year_month(c: Column) -> Column:
    """2024-09, 2024, present or an empty string."""
    low = F.lower(F.coalesce(c, F.lit("")))
    pattern = r"((?:19|20)\d{2})\s*[./\-年]\s*(1[0-2]|0?[1-9])"
    year, month = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    only = F.regexp_extract(low, r"(?:19|20)\d{2}", 0)
    return (
        F.when(low.rlike("至今|现在|present|current|ongoing|在读"), "present")
        .when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0"))).otherwise(only)
    )


def time_key(c: Column) -> Column:
    """Sortable month number of a normalised year-month; present is last, unknown first."""
    year = F.regexp_extract(c, r"^\d{4}", 0)
    month = F.regexp_extract(c, r"^\d{4}-(\d{2})", 1)
    return F.when(c == "present", 9999 * 12 + 12).when(year != "", year.cast("int") * 12 + F.when(month != "", month.cast("int")).otherwise(1)).otherwise(-1)


def degree_rank(c: Column) -> Column:
    """Highest degree named: 3 doctor, 2 master, 1 bachelor, 0 college; null if none is."""
    return F.when(c.contains("博士"), 3).when(c.contains("硕士"), 2).when(c.contains("本科"), 1).when(c.contains("大专"), 0)


def grounded(fragment: Column, source: Column, relaxed: bool = False) -> Column:
    """True if the fragment stands in the source whatever the case; relaxed: comparing ideographs, letters and digits only."""
    a, b = F.lower(fragment), F.lower(source)
    if relaxed:
        a, b = (F.regexp_replace(x, rf"[^{HAN}a-z0-9]", "") for x in (a, b))
    return (F.coalesce(a, F.lit("")) == "") | F.coalesce(b.contains(a), F.lit(False))


def json_object(c: Column) -> Column:
    """The JSON object in a model's answer: the whole text, else the longest braces in it; null if neither parses."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    whole = F.when(strip(c).startswith("{") & F.try_parse_json(c).isNotNull(), strip(c))
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def file_kind(name: Column) -> Column:
    """text, office, pdf or image by suffix; anything unknown is read as pdf."""
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(suffix.isin("txt", "md"), "text").when(suffix.isin("doc", "docx"), "office").when(suffix.isin("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"), "image").otherwise("pdf")
    )
