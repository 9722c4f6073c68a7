"""Mapping free-entered values to the closest entry of a reference list by a prefix-filter set-similarity join.

Distinct values and the entries' labels become sets of q-gram tokens (letters and letter pairs with their occurrence numbers, over the folded text
with stated decorations removed). A token weighs by its rarity, ln(1 + sets / sets that have it), so that what all schools have in common
says little and what one has says much. Tokens are ordered by global rarity; values and labels meet only over the rare prefix that two sets of
the needed Jaccard similarity must share; the length filter and the positional filter thin the meetings; weighted Jaccard is then
computed exactly and alone decides, and the best label of each value is kept. Every value takes this way, equal and short ones too.
Values are joined, never rows, so a value that a third of the rows repeat is compared once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.charfold import fold, plain_form
from talweg.functions.vectors import bound
from talweg.session import cut


@dataclass(frozen=True)
class Vocabulary:
    """What may be taken off or rewritten before two strings of one kind are compared; ``aliases`` are exact spellings of a label."""

    strip: tuple[str, ...] = ()
    rewrite: tuple[tuple[str, str], ...] = ()
    aliases: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: Weighted Jaccard similarity that a value and a label need.
    least: float = 0.5


# How skill levels, campuses, faculties and degrees are written around or instead of the value itself.
SKILLS = Vocabulary(
    strip=(
        r"^(?:精通|熟练掌握|熟练使用|熟练|熟悉|擅长|掌握|了解|proficient in|experienced in|skilled in|familiar with|expert in|knowledge of)[\s:]*",
        r"\s*\([^()]*\)\s*$", r"(?<=.)(?:经验|能力|技能)$",
        r"\s*[,\-/|]+\s*(?:beginner|basic|intermediate|advanced|expert|fluent|native)\s*$", r"\s+\d+\+?\s*(?:yrs?|years?)\.?$",
    ),
    least=0.4,
)
SCHOOLS = Vocabulary(
    strip=(
        r"^(?:毕业于|就读于|the\s)\s*", r"\s*\([^()]*\)?\s*$", r"\s*-+\s*(?:faculty|school|department|dept\.?) of .*$", r",\s*[^,]* campus$",
        r"(?<=大学|学院)\s*(?:本部|分校|总校)$", r"(?<=大学|学院)[^大]*(?:学院|系|院)$", r"(?<=大学|学院)\s+[^\s]{2,}$",
    ),
    rewrite=(
        (r"\buniv\b\.?|\bu\.(?=\s|$)", "university"), (r"\bi\.\s?t\.(?=\s|$)", "institute technology"), (r"\binst\b\.?", "institute"), (r"\btech\b\.?", "technology"), (r"\bmed\b\.?|\bmedicine\b", "medical"),
        (r"\bcoll\b\.?", "college"), (r"\bnorm\b\.?", "normal"), (r"\b(?:of|the)\b", " "),
    ),
)
DEGREES = Vocabulary(
    strip=(r"^(?:大学|全日制|职业|普通|在职|非全日制)(?=.)", r"(?:学历|学位|毕业|在读|\((?:统招|mba|hons|全日制)\))$", r"\s*(?:degree|diploma)s?$", r"^(?:executive)\s+"),
    rewrite=((r"^(?:工学|理学|文学|管理学|经济学|法学|医学|教育学|农学)(?=学士|硕士|博士)", ""), (r"'s\b", ""), (r"^研究生\((.+)\)$", r"\1"), (r"^高职\((.+)\)$", r"\1")),
    aliases=(
        ("Bachelor", ("b.a.", "ba", "b.sc.", "bsc", "b.eng.", "beng", "b.s.", "bs", "b.com.", "llb", "bachelors", "bachelor of engineering", "bachelor of arts", "bachelor of science", "本科生", "学士学位")),
        ("Master", ("m.a.", "ma", "m.sc.", "msc", "m.eng.", "meng", "m.s.", "ms", "masters", "master of arts", "master of science", "master of engineering", "研究生", "硕士学位")),
        ("Doctorate", ("ph.d.", "ph.d", "phd", "dphil", "doctor of philosophy", "doctoral", "doctor", "博士研究生", "博士生")),
        ("Associate", ("a.a.s.", "aas", "a.a.", "a.s.", "assoc.", "assoc", "associate of arts", "大学专科", "高职")),
        ("MBA", ("m.b.a.", "master of business administration", "emba", "工商管理")),
        ("High School", ("highschool", "high-school", "secondary school", "senior high school")),
        ("Vocational Secondary", ("vocational secondary school", "vocational school", "secondary vocational", "中职")),
    ),
)
VOCABULARIES = {"skill": SKILLS, "school": SCHOOLS, "degree": DEGREES}

#: What sums of weights in another order may differ by.
SLACK = 1e-6
_SPACED_HAN = re.compile(r"(?<=[㐀-鿿])\s+(?=[㐀-鿿])")
_SINGLE_SPACED = re.compile(r"^(?:\S\s)+\S$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_SEPARATORS = re.compile(r"[\s_,'’‘\-·]+")


def compare_key(value: str, vocabulary: Vocabulary = Vocabulary()) -> str:
    """The text that is compared: folded, decorations stripped, rewrites applied, blanks and separators removed."""
    text = " ".join(plain_form(value).split())
    if vocabulary.rewrite:
        text = _CAMEL.sub(" ", text)
    text = fold(text)
    if _SINGLE_SPACED.match(text):
        text = text.replace(" ", "")
    for _ in range(3):
        before = text
        for pattern in vocabulary.strip:
            shorter = re.sub(pattern, "", text).strip()
            text = shorter or text
        if text == before:
            break
    text = _SPACED_HAN.sub("", text)
    for pattern, to in vocabulary.rewrite:
        text = re.sub(pattern, to, text).strip()
    for _, spellings in vocabulary.aliases:
        if text in spellings:
            return "=" + _SEPARATORS.sub("", spellings[0])
    return _SEPARATORS.sub("", text)


def tokens(key: str) -> list[str]:
    """Letters and letter pairs, each with its occurrence number, so that a set stands for the multiset. An alias is one token."""
    if key.startswith("="):
        return [key]
    padded = "^" + key + "$"
    grams = [*key, *(padded[i : i + 2] for i in range(len(padded) - 1))] if key else []
    seen: Counter = Counter()
    out = []
    for g in grams:
        seen[g] += 1
        out.append(f"{g}{seen[g]}")
    return out


def _tokenised(values: DataFrame, vocabularies: dict[str, Vocabulary]) -> DataFrame:
    """kind, value → with compare_key and tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [compare_key(v, vocabularies.get(k, Vocabulary())) for k, v in zip(b["kind"], b["value"], strict=True)]
            yield b.assign(compare_key=keys, tokens=[tokens(k) for k in keys])

    return values.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in values.dtypes) + ", compare_key string, tokens array<string>")


def similarity_join(left: DataFrame, right: DataFrame, least: float | dict[str, float]) -> DataFrame:
    """Pairs (kind, left_id, right_id, jaccard) of weighted Jaccard similarity at least ``least`` within one ``kind``.

    Both sides: id, kind, tokens (array of distinct strings). ``least`` may differ by kind (0.5 for kinds not named). Sets without tokens meet none.
    """
    both = left.select("kind", "tokens").unionAll(right.select("kind", "tokens"))
    sets = both.groupBy("kind").agg(F.count("*").alias("sets"))
    rarity = both.select("kind", F.explode("tokens").alias("t")).groupBy("kind", "t").agg(F.count("*").alias("df"))
    rarity = rarity.join(F.broadcast(sets), "kind").select("kind", "t", "df", F.log(1 + F.col("sets") / F.col("df")).alias("w"))  # one row a kind
    needs = least if isinstance(least, dict) else {}
    need = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(v))) for k, v in needs.items()], F.lit(0.5 if needs or isinstance(least, dict) else float(least)))

    def ordered(side: DataFrame) -> DataFrame:
        counted = side.select("id", "kind", F.explode("tokens").alias("t")).join(rarity, ["kind", "t"])
        earlier = Window.partitionBy("id", "kind").orderBy("df", "t").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("before", F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
        return cut(counted.groupBy("id", "kind").agg(F.collect_list(F.struct("t", "w", "before")).alias("s"), F.sum("w").alias("total")))

    def prefixes(side: DataFrame) -> DataFrame:
        """The tokens before which at most so much weight has passed that the rest can still reach the needed share of the whole."""
        seen = side.select("id", "kind", "total", F.explode("s").alias("x")).select("id", "kind", "total", "x.before", "x.t")
        return seen.where(F.col("total") - F.col("before") >= need * F.col("total") - SLACK)

    mine, theirs = ordered(left), ordered(right)
    a, b = prefixes(mine).alias("a"), prefixes(theirs).withColumnRenamed("kind", "k2").alias("b")
    wa, wb = F.col("a.total"), F.col("b.total")
    most = F.least("a.before", "b.before") + F.least(wa - F.col("a.before"), wb - F.col("b.before"))
    met = a.join(b, (F.col("kind") == F.col("k2")) & (F.col("a.t") == F.col("b.t"))).where(
        (wa >= wb * need - SLACK) & (wb >= wa * need - SLACK) & (most >= (wa + wb) * need / (1 + need) - SLACK))
    # Only ids go through the distinct; the sets are fetched for the pairs that are left.
    pairs = met.select("kind", F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
    whole = pairs.join(mine.select("kind", F.col("id").alias("left_id"), "s", F.col("total").alias("wa")), ["kind", "left_id"])
    whole = whole.join(theirs.select("kind", F.col("id").alias("right_id"), F.col("s").alias("z"), F.col("total").alias("wb")), ["kind", "right_id"])
    bare = lambda c: F.transform(c, lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w")))
    compared = whole.withColumn("common", F.aggregate(F.array_intersect(bare("s"), bare("z")), F.lit(0.0), lambda a, x: a + x["w"]))
    similar = compared.select("kind", "left_id", "right_id", F.round(F.col("common") / (F.col("wa") + F.col("wb") - F.col("common")), 9).alias("jaccard"))
    return similar.where(F.col("jaccard") >= need)


def map_values(values: DataFrame, entries: DataFrame, vocabularies: dict[str, Vocabulary] | None = None) -> DataFrame:
    """The entry meant by each distinct (kind, value): columns kind, value, ref_id (0: the list has none), jaccard, compare_key.

    ``entries``: ref_id, ref_kind, label_text, alt_labels. The best label of at least the similarity that the kind's vocabulary states is meant;
    ties go to the smaller ref_id. Null and blank values give no row; very long values are compared whole; repeated values
    count once; an empty list gives 0 for every value.
    """
    vocabularies = VOCABULARIES if vocabularies is None else vocabularies
    aliases = [(kind, label, spelling) for kind, v in vocabularies.items() for label, spellings in v.aliases for spelling in spellings]
    spark = values.sparkSession
    labels = entries.select("ref_id", F.col("ref_kind").alias("kind"), "label_text", F.explode(F.concat(F.array("label_text"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("value"))
    if aliases:
        extra = spark.createDataFrame(aliases, "kind string, label_text string, value string")
        named = entries.select("ref_id", F.col("ref_kind").alias("kind"), "label_text").join(F.broadcast(extra), ["kind", "label_text"])
        labels = labels.unionByName(named)
    labels = labels.where("value is not null and trim(value) <> ''").select("ref_id", "kind", "value").distinct()
    right = cut(_tokenised(labels, vocabularies).dropDuplicates(["kind", "ref_id", "compare_key"])
                .withColumn("id", F.concat_ws("\u0001", F.col("ref_id").cast("string"), "compare_key")))
    distinct = values.select("kind", "value").where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\s\p{Z}]*$")).distinct()
    keyed = cut(_tokenised(distinct, vocabularies).drop("tokens"))
    # Many spellings share one key; only distinct keys enter the join.
    keys = keyed.where("compare_key <> ''").select("kind", "compare_key").distinct().withColumn("id", F.col("compare_key"))
    found = similarity_join(_key_tokens(keys), right.select("id", "kind", "tokens"), {kind: v.least for kind, v in vocabularies.items()})
    ref = F.element_at(F.split("right_id", "\u0001"), 1).cast("int")
    # the best label, then the smaller ref_id, in an aggregate that is combined before it is shuffled
    best = found.groupBy("kind", F.col("left_id").alias("compare_key")).agg(F.max(F.struct("jaccard", (-ref).alias("r"))).alias("m"))
    answers = best.select("kind", "compare_key", (-F.col("m.r")).alias("ref_id"), "m.jaccard")
    return keyed.join(answers, ["kind", "compare_key"], "left").select("kind", "value", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), "jaccard", "compare_key")


def _key_tokens(keys: DataFrame) -> DataFrame:
    """id, kind, tokens of compare keys, by built-in functions: the same tokens as :func:`tokens`."""
    chars = F.filter(F.split("compare_key", ""), lambda c: c != "")
    padded = F.concat(F.lit("^"), F.col("compare_key"), F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("compare_key") + 1), lambda i: F.substring(padded, i, F.lit(2)))
    grams = F.concat(chars, pairs)
    numbered = bound(grams, lambda all_: F.transform(all_, lambda g, i: F.concat(g, F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda h: h == g)).cast("string"))))
    return keys.select("id", "kind", F.when(F.col("compare_key").startswith("="), F.array("compare_key")).otherwise(numbered).alias("tokens"))


def map_rows(rows: DataFrame, entries: DataFrame, keys: Sequence[str], **how) -> DataFrame:
    """Each row's value with its entry: ``keys``, kind, value, ref_id. Rows equal to a label character for character are left out.

    The list is small by nature, and its size decides how it meets the rows (adaptive execution); a hot value meets one mapping row, in a
    join that adaptive execution splits.
    """
    known = entries.select(F.col("ref_kind").alias("kind"), F.col("label_text").alias("value")).distinct()
    free = rows.where("value is not null").join(known, ["kind", "value"], "left_anti")
    return free.join(map_values(free, entries, **how).drop("compare_key"), ["kind", "value"])
