"""Personal data in free text: candidates by shape, kept by how much they disclose, replaced by typed placeholders.

The protected entities are the people of the structured records. Patterns only propose: e-mail and street addresses, numbers of personal form, and
name-like terms (a family-name character with given-name characters, two capitalised words with or without an initial, a capitalised word after a short
one). What a candidate discloses is estimated from the corpus, in bits, as a sum of weights of evidence for the class of protected names:

* its parts: how much likelier its words are in protected names than in other candidates; a word that no record has counts by the Good-Turing
  share of parts that are seen once only. Ideographs are all of protected names already, each in its place;
* its surroundings: how many of the terms next to the same two words (or characters) to the left, one to the left, one to the right are protected
  names, each share smoothed by the coarser one, and weaker where the records cover few of the names.

A number is personal unless the word before it is one after which numbers seldom have a personal form. What discloses at least ``LEAST_BITS`` is
removed. No cue, title or stop word is given: they are all learnt. The protected person's own name is removed wherever it stands.
Statistics are joins and aggregates over candidates; only a handful of totals per kind and the characters of names (never more than there are
characters) come to the driver.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.charfold import plain_form
from talweg.functions.text import tokens
from talweg.session import bounded, cut, spread

LEAST_BITS = -2.0
#: Terms that a share counts as seen besides those that were.
SMOOTHING = 2.0
#: How sure a term of name characters is a name before its surroundings are looked at.
HAN_SHARE = 0.8
#: Terms next to a word before it tells how many of the names the records have.
LEAST_TERMS = 8
#: Bits that the personal form of a number gives it; the share of such numbers after the word before it takes bits away.
SHAPE_BITS = 2.0

_LOCAL = r"[A-Za-z0-9_](?:[A-Za-z0-9._+\-]{0,63}[A-Za-z0-9_])?"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_.+\-]){_LOCAL}\s?(?:@|＠|\(at\)|\[at\]|\{{at\}})\s?[A-Za-z0-9\-]+(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9\-]+)+|(?<![A-Za-z0-9_.+\-]){_LOCAL} at [A-Za-z0-9\-]+(?: dot [A-Za-z0-9\-]+)+", re.IGNORECASE
)
ID_NUMBER = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:[1-9]\d{5}[ ]?(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ ]?\d{3}[\dXx]|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{7,8})(?![A-Za-z0-9_])"
)
PHONE = re.compile(
    r"(?<![A-Za-z0-9_.+\-/])(?:"
    r"(?:(?:\(\+86\)|\+86|0086)[\- ]?)?1[3-9]\d[\-. ]?\d{4}[\-. ]?\d{4}"
    r"|(?:\+1[\-. ]?)?(?:\(\d{3}\)[ ]?|\d{3}[\-.])\d{3}[\-. ]\d{4}(?:\s(?:ext|x)\.?\s?\d+)?"
    r"|(?:\+44 ?(?:\(0\))?7\d{3}|07\d{3}) ?\d{6}|(?:\+44 ?|0)20 ?\d{4} ?\d{4}|(?:\+49 ?|0)\d{2,4} \d{4,5} \d{3,4}"
    r"|\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{3,4}){2,3}"
    r"|0\d{2,3}-\d{7,8})(?![A-Za-z0-9_\-]|\.\d)"
)
_HAN = r"[㐀-鿿]"
ADDRESS_HAN = re.compile(
    rf"(?:{_HAN}{{1,6}}?[市县])?(?:{_HAN}{{1,4}}?区)?{_HAN}{{1,4}}?(?:路|街|大道|巷|弄|胡同)\n?\d+\n?(?:号|弄)(?:\n?\d+\n?(?:号|弄|栋|幢|座|单元|室))*"
    rf"|(?:{_HAN}{{1,6}}?[市县])?{_HAN}{{1,6}}?(?:小区|公寓|花园|新村)\n?\d+\n?(?:单元|栋|幢|号)(?:\n?\d+[室号]?)?"
)
ADDRESS_LATIN = re.compile(
    r"\bFlat\s\d+[A-Za-z]?,\s\d+\s[A-ZÀ-Ž][\w'’\-]+\s(?:Court|House|Road|Street|Lane)"
    r"|\b\d{1,5}[A-Za-z]?\s(?:[A-ZÀ-Ž][\w'’\-]+\s){1,3}(?:St\.?|Rd\.?|Ave\.?|Ln\.?|Blvd\.?|Street|Road|Avenue|Lane|Court|Crescent|Drive|Boulevard|Square|Terrace|Way)(?![\w])(?:,\s(?:Apt|Unit|Suite|Flat)\.?\s\w+)?(?:,\s[A-ZÀ-Ž][\w\-]+)?"
    r"|\b(?:rue|avenue|boulevard|place|calle|via)\s[A-ZÀ-Ž][\w'’\-]+\s\d{1,4}\b(?:,\s[A-ZÀ-Ž][\w\-]+)?"
    r"|\b[A-ZÀ-Ž][\w\-]*(?:stra(?:ss|ß)e|gasse|weg|platz)\s\d{1,4}\b(?:,\s\d{5}\s[A-ZÀ-Ž][\w\-]+)?"
)
_WORD = r"\p{Lu}[\p{L}\p{M}]*\p{Ll}[\p{L}\p{M}]*"
_TERM = re.compile(r"[A-Za-z][A-Za-z0-9.+#_-]*|[0-9][A-Za-z0-9.+#_-]*")
_FULL_WORD = regex.compile(rf"{_WORD}(?![\w@])")
_AFTER_SHORT = re.compile(r"(?<![\w@.\-])[A-Z][a-z]{1,3}\.?\s(?=[^\W\d_a-z])")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_.+\-])[(+]?\d(?:[\d\-. ()/]{0,30}?\d){6,30}(?![A-Za-z0-9_])")
_CUE = re.compile(r"[a-zà-ʯа-яё]+|[㐀-鿿]{1,4}", re.IGNORECASE)
LATIN_NAME = regex.compile(rf"(?=(?<![\w@.\-])({_WORD})(\s+\p{{Lu}}\.)?\s+({_WORD})(?![\w@]))")


# What a text must hold for the costlier patterns to be tried at all.
_MAY_MAIL = re.compile(r"[@＠]|[\[({]at[\])}]| at ", re.IGNORECASE)
_MAY_LIVE_HAN = re.compile(r"(?:路|街|大道|巷|弄|胡同|小区|公寓|花园|新村)\n?\d")
_MAY_LIVE_LATIN = re.compile(r"\d[\w]*,? |[a-z] \d")
_WRAPPED = re.compile(r"(?<=[⺀-\U0010ffff])\n(?=[⺀-\U0010ffff])")


class Flat:
    """A text with the line ends between ideographs closed up; ``at`` gives the place in the text of a place in ``flat``."""

    def __init__(self, text: str) -> None:
        gone = [m.start() for m in _WRAPPED.finditer(text)] if "\n" in text else []
        self.flat = _WRAPPED.sub("", text) if gone else text
        self._before, self._gone = [p - k for k, p in enumerate(gone)], gone

    def at(self, place: int) -> int:
        return place + bisect_right(self._before, place)

    def flat_at(self, place: int) -> int:
        """The place in ``flat`` of a place in the text."""
        return place - bisect_left(self._gone, place)


def shaped_spans(text: str, whole: Flat | None = None) -> list[tuple[str, int, int]]:
    """(type, start, end) of e-mail addresses, phone and identity numbers and street addresses in ``text``."""
    whole = whole or Flat(text)
    flat = whole.flat
    found: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    for kind, pattern, hint in (("email", EMAIL, _MAY_MAIL), ("id_number", ID_NUMBER, None), ("phone", PHONE, None), ("address", ADDRESS_HAN, _MAY_LIVE_HAN), ("address", ADDRESS_LATIN, _MAY_LIVE_LATIN)):
        if hint is not None and not hint.search(flat):
            continue
        for m in pattern.finditer(flat):
            a, b = m.start(), m.end()
            if not free(a, b):
                continue
            if kind in ("id_number", "phone") and ("://" in flat[max(0, a - 60) : a].rpartition(" ")[2] or "\n" in m[0]):
                continue
            taken.append((a, b))
            found.append((kind, whole.at(a), whole.at(b - 1) + 1))
    return found


def number_cue(flat: str, a: int) -> str:
    """The word before a number on its line: ``^`` at a line's start, ``@`` after an address."""
    line = flat[max(0, a - 40) : a].rpartition("\n")[2]
    words = _CUE.findall(line.casefold())
    return "@" if line.split() and "@" in line.split()[-1] else words[-1] if words else "^"


def other_numbers(flat: str, taken: list[tuple[int, int]]) -> list[str]:
    """Cues of the long numbers of ``flat`` that have no personal form."""
    return [number_cue(flat, m.start()) for m in _NUMBER.finditer(flat) if all(m.end() <= x or m.start() >= y for x, y in taken)]


def _right_cue(after: str) -> str:
    c, then = after[:1], after[1:2]
    if c in ("", "\n"):
        return "$"
    return c if c != " " else " " + ("a" if then.islower() else "A" if then.isalpha() else "0" if then.isdigit() else then)


def name_terms(text: str, han_name: re.Pattern | None, whole: Flat | None = None) -> list[tuple[str, str, int, int, str, str, str]]:
    """(kind, term, start, end, two words or characters to the left, one, right cue) of every name-like term."""
    whole = whole or Flat(text)
    flat = whole.flat
    found = []
    if han_name is not None:
        found += [("han", m[1], m.start(1), m.end(1)) for m in han_name.finditer(flat)]
    found += [("latin", f"{m[1]} {m[3]}", m.start(1), m.end(3)) for m in LATIN_NAME.finditer(flat)]
    for m in _AFTER_SHORT.finditer(flat):
        word = _FULL_WORD.match(flat, m.end())
        if word:
            found.append(("word", word[0], m.end(), word.end()))
    out = []
    for kind, term, a, b in found:
        line = flat[max(0, a - 32) : a].rpartition("\n")[2]
        if kind == "han":
            line = line.rstrip(" ")
            left2, left1 = line[-2:], line[-1:]
        else:
            words = line.casefold().split()
            left2, left1 = " ".join(words[-2:]), (words or [""])[-1]
        out.append((kind, term, whole.at(a), whole.at(b - 1) + 1, left2 or "^", left1 or "^", _right_cue(flat[b : b + 2])))
    return out


def name_parts(names: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Family-name characters, double family names and given-name characters of Han names; no more than there are characters."""
    han = names.where(F.col("name").rlike("^[\\u3400-\\u9fff]{2,4}$")).select("name").distinct()
    double = [r[0] for r in han.where("length(name) = 4").select(F.substring("name", 1, 2)).distinct().collect()]
    simple = han.where(~F.substring("name", 1, 2).isin(double or [""]) & (F.length("name") < 4))
    family = [r[0] for r in simple.select(F.substring("name", 1, 1)).distinct().collect()]
    rest = han.select(F.when(F.substring("name", 1, 2).isin(double or [""]), F.substring("name", 3, 2)).otherwise(F.substring("name", 2, 2)).alias("g"))
    given = [r[0] for r in rest.select(F.explode(F.split("g", "")).alias("g")).where("g <> ''").distinct().collect()]
    return sorted(family), sorted(double), sorted(given)


def _han_pattern(family: list[str], double: list[str], given: list[str]) -> str | None:
    if not family or not given:
        return None
    heads = "|".join([*map(re.escape, double), "[" + "".join(map(re.escape, family)) + "]"])
    return f"(?=((?:{heads})[{''.join(map(re.escape, given))}]{{1,2}}))"


def find_personal_data(texts: DataFrame, names: DataFrame, entity: str | None = None, least_bits: float = LEAST_BITS) -> DataFrame:
    """Spans of personal data: key columns of ``texts`` with pii_type, start_at, end_at (0-based, end exclusive).

    ``texts`` has any key columns, ``raw_text`` and ``own_name`` (may be null); ``names`` has ``name``. ``entity`` names the key column that says
    whom a text is about (the first one by default). Null and empty texts give no rows; long texts are read whole; repeated rows give
    repeated spans; with no names known, only own names are found as names; an empty table gives no rows.
    """
    keys = [c for c in texts.columns if c not in ("raw_text", "own_name")]
    entity = entity or keys[0]
    plain = names.where("name is not null and trim(name) <> ''").select("name").distinct()

    @F.pandas_udf("string")
    def consistent(values: pd.Series) -> pd.Series:
        return values.map(lambda v: " ".join(plain_form(v).split()))

    known = cut(plain.select(consistent("name").alias("name")).distinct())
    pattern = _han_pattern(*name_parts(known))
    types = dict(texts.dtypes)
    columns = [*keys, "pii_type", "start_at", "end_at", "kind", "term", "left2", "left1", "right1"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        han = re.compile(pattern) if pattern else None
        for b in batches:
            rows = []
            for row in b[[*keys, "raw_text", "own_name"]].itertuples(index=False, name=None):
                text, own, key = row[-2], row[-1], row[:-2]
                whole = Flat(text)
                spans = shaped_spans(text, whole)
                taken = []
                for shape, x, y in spans:
                    numeric = shape in ("phone", "id_number")
                    if numeric:
                        taken.append((whole.flat_at(x), whole.flat_at(y)))
                    rows.append((*key, shape, x, y, "number" if numeric else None, None, None, number_cue(whole.flat, taken[-1][0]) if numeric else None, None))
                rows += [(*key, None, None, None, "number", None, None, cue, None) for cue in other_numbers(whole.flat, taken)]
                own = " ".join(plain_form(own).split()) if own else ""
                if len(own) > 1:
                    line = text.replace("\n", " ")
                    x = line.find(own)
                    while x >= 0:
                        rows.append((*key, "name", x, x + len(own), None, own, None, None, None))
                        spans.append(("name", x, x + len(own)))
                        x = line.find(own, x + len(own))
                for kind, term, x, y, *cues in name_terms(text, han, whole):
                    if not any(x < q and y > p for _, p, q in spans):
                        rows.append((*key, "name", x, y, kind, term, *cues))
            yield pd.DataFrame(rows, columns=columns)

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["pii_type string, start_at int, end_at int, kind string, term string, left2 string, left1 string, right1 string"])
    spans = cut(spread(texts.where("raw_text is not null and raw_text <> ''")).mapInPandas(scan, schema))
    columns = [*keys, "pii_type", "start_at", "end_at"]
    certain = spans.where("kind is null").select(*columns)
    numbers = spans.where("kind = 'number' and pii_type is not null").join(bounded(impersonal_cues(spans)), "left1", "left_anti").select(*columns)
    terms = spans.where("kind <> 'number'")
    context = ["kind", "term", "left2", "left1", "right1"]
    disclosing = name_disclosure(terms.select(F.col(f"`{entity}`").alias("entity"), *context), known).where(F.col("bits") >= least_bits)
    named = terms.join(disclosing.select(*context), context, "left_semi").select(*columns)
    return certain.unionByName(numbers).unionByName(named)


def impersonal_cues(spans: DataFrame) -> DataFrame:
    """Words (left1) after which a number of personal form discloses nobody, since most numbers there have no such form."""
    counted = spans.where("kind = 'number'").groupBy("left1").agg(F.count("*").alias("n"), F.count("pii_type").alias("k"))
    share = (F.col("k") + SMOOTHING) / (F.col("n") + SMOOTHING)
    return counted.where((SHAPE_BITS + F.log2(share) < 0) & ~F.col("left1").isin("^", "@")).select("left1")


def _odds(p: float) -> float:
    """Log-odds in bits, never surer than 0.97 nor than one in a million."""
    p = min(max(p, 1e-6), 0.97)
    return math.log2(p / (1 - p))


def _odds_of(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(0.97))
    return F.log2(p / (1 - p))


def name_disclosure(seen: DataFrame, known: DataFrame) -> DataFrame:
    """bits that each distinct (kind, term, left2, left1, right1) discloses of a protected name. ``seen`` has an entity besides; ``known`` has ``name``."""
    context = ["kind", "term", "left2", "left1", "right1"]
    base = seen.distinct()
    words = F.split("name", " ")
    full = known.where("name is not null")
    latin = full.where(F.col("name").contains(" ")).select(F.element_at(words, 1).alias("a"), F.element_at(words, -1).alias("b"))
    first, last = (latin.groupBy(c).agg(F.count("*").alias("n")) for c in ("a", "b"))
    once = {}
    for c, part in (("a", first), ("b", last)):
        r = part.agg(F.count_if(F.col("n") == 1).alias("one"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        once[c] = (r["one"] + 1) / (r["n"] + 4)
    halves = F.split("term", " ")
    distinct = base.select("kind", "term").distinct().withColumn("a", F.when(F.col("kind") == "latin", F.element_at(halves, 1))).withColumn("b", F.when(F.col("kind") != "han", F.element_at(halves, -1)))
    marked = distinct.join(first.select("a", F.lit(True).alias("has_a")), "a", "left").join(last.select("b", F.lit(True).alias("has_b")), "b", "left")
    marked = marked.join(full.select(F.col("name").alias("term"), F.lit(True).alias("is_known")).distinct(), "term", "left").fillna(False, ["has_a", "has_b", "is_known"])
    like = F.when(F.col("kind") == "han", F.col("is_known")).when(F.col("kind") == "latin", F.col("has_a") & F.col("has_b")).otherwise(F.col("has_b"))
    rows = cut(base.join(marked.select("kind", "term", "has_a", "has_b", like.alias("like")), ["kind", "term"]))

    def table(*cue: str) -> DataFrame:
        return rows.groupBy("kind", *cue).agg(F.count("*").alias("n"), F.count_if("like").alias("k"))

    purest = F.max(F.when(F.col("n") >= LEAST_TERMS, (F.col("k") + 0.5) / (F.col("n") + 1)))
    pure = {r["kind"]: r["p"] or 0.0 for r in table("left1").groupBy("kind").agg(purest.alias("p")).collect()}  # one row a kind
    totals = rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("like").alias("k"), F.count_if("has_a").alias("a"), F.count_if("has_b").alias("b")).collect()
    figures = []
    for r in totals:
        han, p0 = r["kind"] == "han", (r["k"] + 0.5) / (r["n"] + 4)
        # how many of the names the records have: by the parts they are made of, or by the terms after the surest words
        cover = p0 if han else max(pure[r["kind"]], (1 - once["b"]) * (1 - once["a"] if r["kind"] == "latin" else 1))
        names = r["k"] / cover
        others = max(r["n"] - names, 1.0)

        def part(has: int, unseen: float, names: float = names, others: float = others) -> tuple[float, float]:
            q = min(max(0.5, has - (1 - unseen) * names) / (others + 1), 0.9)
            return math.log2((1 - unseen) / q), math.log2(unseen / (1 - q))

        a = part(r["a"], once["a"]) if r["kind"] == "latin" else (0.0, 0.0)
        b = part(r["b"], once["b"]) if not han else (0.0, 0.0)
        figures.append((r["kind"], p0, cover, SMOOTHING / cover, p0 if han else p0 * cover, _odds(HAN_SHARE if han else p0), *a, *b))
    numbers = ", ".join(f"{c} double" for c in ("p0", "cover", "m", "start", "prior", "a_yes", "a_no", "b_yes", "b_no"))
    figures = rows.sparkSession.createDataFrame(figures, f"kind string, {numbers}")
    out = rows.select(*context, "has_a", "has_b").distinct()
    for name, cue in (("l2", ["left2", "left1"]), ("l1", ["left1"]), ("r1", ["right1"])):
        out = out.join(table(*cue).withColumnsRenamed({"n": f"n_{name}", "k": f"k_{name}"}), ["kind", *cue])
    out = out.join(F.broadcast(figures), "kind")  # three rows

    def share(name: str, start: Column) -> Column:
        return (F.col(f"k_{name}") + F.col("m") * start) / (F.col(f"n_{name}") + F.col("m"))

    def weight(p: Column) -> Column:
        """Evidence of a share: in odds, or, where few names are known and an unknown one says little, as a ratio."""
        return F.when(F.col("kind") == "han", F.log2(p / F.col("p0"))).otherwise(_odds_of(p / F.col("cover")) - F.col("prior"))

    left, right = weight(share("l2", share("l1", F.col("start")))), weight(share("r1", F.col("start")))
    parts = F.when(F.col("has_a"), F.col("a_yes")).otherwise(F.col("a_no")) + F.when(F.col("has_b"), F.col("b_yes")).otherwise(F.col("b_no"))
    return out.select(*context, (F.col("prior") + left + right + parts).alias("bits"))


def revealing_terms(texts: DataFrame, entity: str, least_bits: float, least_texts: int = 2) -> DataFrame:
    """Terms that disclose which entity a text is about: entity, term, bits.

    A term of n out of N entities discloses log2(N / n) bits. Words of letters and numbers of four or more digits count, in texts
    of one entity at least ``least_texts`` times apart, so that a word seen once by chance does not.
    """
    words = F.array_distinct(F.filter(tokens(F.col("raw_text")), lambda t: t.rlike("^[a-z][a-z0-9.+#_-]{2,}$|^[0-9]{4,}$")))
    rows = texts.where(F.col(entity).isNotNull()).select(F.col(entity), F.explode(words).alias("term"))
    counted = rows.groupBy(entity, "term").agg(F.count("*").alias("n_texts"))
    spread_over = counted.groupBy("term").agg(F.count("*").alias("n_entities"))
    everyone = texts.agg(F.countDistinct(entity).alias("n_all"))
    known = counted.where(F.col("n_texts") >= least_texts).join(spread_over, "term").crossJoin(F.broadcast(everyone))  # one row
    bits = F.log2(F.col("n_all") / F.col("n_entities"))
    return known.select(entity, "term", bits.alias("bits")).where(F.col("bits") >= least_bits)


def redact(texts: DataFrame, names: DataFrame, entity: str | None = None, least_bits: float | None = None, **how) -> DataFrame:
    """``texts`` with ``clean_text``: every found span replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME]; the rest as it was.

    With ``entity`` and ``least_bits`` terms that disclose the entity by as many bits are generalised to [TERM] too. Null texts stay
    null; repeated rows come back as often as they came.
    """
    keys = [c for c in texts.columns if c not in ("raw_text", "own_name")]
    spans = find_personal_data(texts, names, **({"entity": entity} if entity else {}), **how).select(*keys, "start_at", "end_at", "pii_type")
    if entity is not None and least_bits is not None:
        mine = revealing_terms(texts, entity, least_bits).groupBy(entity).agg(F.collect_set("term").alias("terms"))
        types = dict(texts.dtypes)

        def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for row in b[[*keys, "raw_text", "terms"]].itertuples(index=False, name=None):
                    wanted = set(row[-1])
                    rows += [(*row[:-2], m.start(), m.end(), "term") for m in _TERM.finditer(row[-2] or "") if m[0].lower() in wanted]
                yield pd.DataFrame(rows, columns=[*keys, "start_at", "end_at", "pii_type"])

        schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["start_at int, end_at int, pii_type string"])
        spans = spans.unionByName(texts.join(mine, entity).mapInPandas(mark, schema))
    gathered = spans.groupBy(*keys).agg(F.collect_set(F.struct("start_at", "end_at", "pii_type")).alias("spans"))

    @F.pandas_udf("string")
    def replace(values: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_replaced(v, s) for v, s in zip(values, found, strict=True)])

    return texts.join(gathered, keys, "left").withColumn("clean_text", replace("raw_text", "spans")).drop("spans")


def _replaced(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    # a personal span stands before a mere term at the same place
    order = sorted((s["start_at"], s["pii_type"] == "term", -s["end_at"], s["pii_type"]) for s in spans)
    out, done = [], 0
    for a, _, b, kind in order:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
            done = -b
    return "".join([*out, text[done:]])
