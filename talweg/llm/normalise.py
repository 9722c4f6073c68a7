"""One consistent spelling for text that looks the same, by quick-check properties and splicing.

A character is *stable* if it has the normalisation quick-check property Yes, is no invisible or special blank or dash,
and belongs to no script that has look-alikes of Latin letters or ideographs. Text of stable characters alone is passed by in
the JVM. In other text the unstable segments are found, each is widened to its boundary context (back to a starter whose
composition it may change, on over the marks that follow; look-alike letters to their whole word), only the segment is normalised,
and the canonical segment is spliced into the unchanged rest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.charfold import BLANKS, DASHES, INVISIBLE, KANA_LOOKALIKE, LOOKALIKE, RADICALS, genuine_scripts, looks_otherwise, plain_form, settled

# Blocks in which every character is stable, as a Java and Python character class: ASCII, the composed Latin letters
# that are NFC and NFKC quick-check Yes, the unified ideographs, and CJK punctuation that has no decomposition.
STABLE_CLASS = r"\x00-\x7f¡-§©«¬®°±¶·»¿-İĴ-ľŁ-ňŊ-žƀ-ǃ、-〟㐀-鿿"
_STABLE = re.compile(f"[{STABLE_CLASS}]*")
_OTHER = set(INVISIBLE) | set(BLANKS) | set(DASHES) | set(RADICALS) | set(LOOKALIKE) | set(KANA_LOOKALIKE)


def may_be_unstable(text: Column) -> Column:
    """JVM-side quick check: true if any character is outside the stable blocks."""
    return text.rlike(f"[^{STABLE_CLASS}]")


def _unstable(c: str) -> bool:
    return c in _OTHER or unicodedata.combining(c) != 0 or not (looks_otherwise(c) or unicodedata.is_normalized("NFKC", c))


def segments(text: str) -> list[tuple[int, int]]:
    """Unstable stretches with their boundary context, in order and apart from each other."""
    n, spans, i = len(text), [], 0
    while i < n:
        if not _unstable(text[i]):
            i += 1
            continue
        a = b = i
        # Back to the starter, and over the letters of the word, which decide on look-alikes and on composition.
        while a > 0 and (text[a - 1].isalnum() or unicodedata.combining(text[a - 1])):
            a -= 1
        while b < n and (_unstable(text[b]) or text[b].isalnum() or unicodedata.combining(text[b])):
            b += 1
        if spans and a <= spans[-1][1]:
            a = spans.pop()[0]
        spans.append((a, b))
        i = b
    return spans


def normalise(text: str) -> str:
    """The consistent form of ``text``; only unstable segments are rewritten."""
    if _STABLE.fullmatch(text):
        return text
    # A genuine word of another script anywhere in the text speaks for that script in every segment.
    genuine = None
    out, done = [], 0
    for a, b in segments(text):
        piece = text[a:b]
        if genuine is None and any(c in LOOKALIKE for c in piece):
            genuine = genuine_scripts(settled(text))
        out += [text[done:a], plain_form(piece, genuine)]
        done = b
    return "".join([*out, text[done:]])


def normalise_column(df: DataFrame, text: str, out: str = "plain_text") -> DataFrame:
    """``df`` with the consistent form of column ``text`` as ``out``.

    Null stays null, empty stays empty; texts of any length are handled whole; repeated rows and other columns are kept as they
    are. If ``df`` already has a column ``out`` it is replaced. An empty table gives an empty table.
    """

    @F.pandas_udf("string")
    def fix(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else normalise(v))

    unstable = F.col(f"`{text}`").isNotNull() & may_be_unstable(F.col(f"`{text}`"))
    # A UDF in one branch of a CASE would still see every row: the stable rows go round it instead.
    steady = df.where(~F.coalesce(unstable, F.lit(False))).withColumn(out, F.col(f"`{text}`"))
    return steady.unionByName(df.where(unstable).withColumn(out, fix(F.col(f"`{text}`"))))


def changed_values(values: DataFrame, text: str = "value") -> DataFrame:
    """Rows whose value is not yet in the consistent form, with that form as ``plain_text``; nulls are no such rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plain = b[text].map(normalise)
            yield b.assign(plain_text=plain)[plain != b[text]]

    schema = ", ".join(f"`{n}` {t}" for n, t in values.dtypes) + ", plain_text string"
    return values.where(F.col(text).isNotNull() & may_be_unstable(F.col(text))).mapInPandas(run, schema)
