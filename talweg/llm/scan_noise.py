"""Repair of text from scanned pages: misread characters, words divided by hyphens, running headers, page numbers.

One pass over the texts notes their facts (words and character contexts, hyphenated line ends, line shapes, page-number lines)
in a compressed table; everything else is SQL over it.

* Misread characters: every word has an anagram hash, the sum of its characters' values. Taking a known confusion
  (read ``a`` for ``b``) back changes the hash by value(b) - value(a), so a rare word and its frequent variant meet in an equi-join
  on the hash, whatever the position; the variant is then verified letter by letter, and corrections are ranked by the variant's frequency.
  For ideographs the words are the two- and three-character contexts of confusable characters.
* Hyphens: a divided word is joined if the corpus has the joined form more often than the hyphenated one.
* Headers: a running header recurs within texts. It is known by the whole line (digits and the file's person masked) or, where a part of it varies from
  file to file, by its last word with the forms of the words before it; lines of another form stay whatever they end in.
  Edge lines of the pages go wherever they stand in the text. Page numbers are lines of their own form.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.session import bounded, cut, spread

# What a scan reads, and what stood there.
LATIN_CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("rn", "m"), ("m", "rn"), ("li", "h"), ("h", "li"),
    ("vv", "w"), ("w", "vv"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("2", "z"), ("q", "g"), ("nn", "m"), ("tl", "d"), ("ln", "m"),
)
HAN_CONFUSIONS = tuple(zip(
    "旳埋聪纨桯エ朗敎糸闩顸贵没人焙暈琚努尸末己曰土干大失刃壬孑午戍囗ロ力カニ二亻冂夭沒侍侯",
    "的理联统程工期数系门预责设入培量据务户未已日士千太矢刀任子牛戌口口刀力二工人门天没待候", strict=True,
))
HYPHENS = "-‐‑¬­"
LEAST_SEEN = 5
TIMES = 8
# The forms of a page number on its own line.
PAGE_NO = re.compile(
    r"^\s*(?:[-–—·•~*]\s*\d{1,3}\s*[-–—·•~*]|\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}|\d{1,3}\s*[/|]\s*\d{1,3}|第\s*\d{1,3}\s*页(?:\s*[,，/]?\s*共\s*\d{1,3}\s*页)?"
    r"|页码\s*[:：]?\s*\d{1,3}|(?:page|pg|p)\.?\s*\d{1,3}(?:\s*(?:of|/)\s*\d{1,3})?|\d{1,3}\s+of\s+\d{1,3})\s*$", re.IGNORECASE
)
BULLET = re.compile(r"^\s*(?:[•·*▪●\-–]\s|\d{1,2}[.)、]\s?(?!\d))")
# Lines that stand for themselves: dates and labels at their start, columns, links.
_STRUCTURAL = re.compile(r"^\s*(?:\d{4}[./\-]\d{1,2}\s*[-–—]|[^\W\d_]{1,12}(?: [^\W\d_]{1,12})?\s?[:：])|\s\|\s|://|\S\s{2,}\S")
_LATIN = re.compile(r"[A-Za-z][A-Za-z]*(?:[0-9][A-Za-z]+)+|[0-9][A-Za-z]{3,}|[A-Za-z]{3,}[0-9]?(?![0-9])|[A-Za-z]{2,}")
_NUMBER = re.compile(r"(?<![A-Za-z0-9._@/+\-])(?=[0-9lO]*[lO])(?=[lO]*[0-9]|[lO]{1,4}(?=[㐀-鿿%]))[0-9lO]{1,12}(?![A-Za-z0-9_@/]|\.\w|-\w)")
_COMPOUND = re.compile(r"[A-Za-z]+-[A-Za-z]+")
_HAN_KEYS = {c for pair in HAN_CONFUSIONS for c in pair}
_LINE_END = re.compile(rf"([A-Za-z]+)([{HYPHENS}])[ \t]*$")
_LINE_START = re.compile(r"^[ \t]*([a-z]+)")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


_FORMS = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+")


def _form(part: str) -> str:
    """The words of a part of a line by their form alone: ideographs, with a capital, without one."""
    return _FORMS.sub(lambda m: "H" if m[0][0] > "⺀" else "A" if m[0][0].isupper() else "a", part)


def line_shapes(line: str, own: str) -> tuple[str, ...]:
    """What running headers of one kind have in common: the masked line, and its last word after the forms of the others. Empty for lines that cannot be one."""
    line = line.strip()
    if not 4 <= len(line) <= 60 or line[-1] in "。.；;，,、:：!！?？%" or BULLET.match(line) or PAGE_NO.match(line):
        return ()
    line = re.sub(r"\d+", "9", line)
    if not any(c.isalpha() for c in line):
        return ()
    before, blank, last = line.rpartition(" ")
    whole = line.replace(own, "N") if own else line
    return (whole, f"{_form(before)} \0{last}") if blank and any(c.isalpha() for c in last) and len(last) > 2 else (whole,)


def _contexts(text: str) -> set[str]:
    """Two- and three-character contexts of confusable ideographs, across line ends, digits masked."""
    flat = re.sub(r"\d", "9", text.replace("\n", ""))
    out = set()
    for i, c in enumerate(flat):
        if c in _HAN_KEYS:
            for a, b in ((i - 1, i + 1), (i, i + 2), (i - 1, i + 2)):
                gram = flat[max(0, a) : b]
                if len(gram) == b - a and not gram.isspace():
                    out.add(gram)
    return out


def without_noise_lines(lines: list[str], headers: set[int], own: str) -> list[str]:
    kept = []
    for line in lines:
        if not PAGE_NO.match(line) and not (headers and any(_hash(shape) in headers for shape in line_shapes(line, own))):
            kept.append(line)
    return kept


def facts_of(text: str, own: str) -> dict:
    """What one text tells: see :func:`text_facts`."""
    lines = text.replace("\r\n", "\n").split("\n")
    exact = Counter(x.strip() for x in lines if len(x.strip()) > 3)
    of_line = {x: line_shapes(x, own) for x in exact}
    shapes = {s for found in of_line.values() for s in found}
    twice = {s for x, n in exact.items() if n > 1 for s in of_line[x]}
    plain = [x for x in lines if not PAGE_NO.match(x)]
    hyphens = []
    # Headers may stand between the halves of a word, so lines that may be one are passed over.
    for i, line in enumerate(plain):
        end = _LINE_END.search(line)
        if not end:
            continue
        for step, then in enumerate(plain[i + 1 :], start=1):
            start = _LINE_START.match(then)
            if start:
                hyphens.append({"head": end[1], "mark": end[2], "tail": start[1], "step": step})
            if start or (then.strip() and not of_line.get(then.strip())):
                break
    body = "\n".join(lines)
    words = {m[0].lower() for m in _LATIN.finditer(re.sub(rf"[{HYPHENS}][ \t]*\n|\S*(?:@|://)\S*", " ", body))}
    words |= {m[0].lower() for m in _COMPOUND.finditer(body)}
    return {
        "words": sorted(words) + sorted(_contexts(body)), "numbers": sorted({m[0] for m in _NUMBER.finditer(body)}),
        "shapes": sorted(_hash(s) for s in shapes), "twice": sorted(_hash(s) for s in twice), "hyphens": hyphens,
        "has_page": len(plain) < len(lines),
    }


FACTS = "words array<string>, numbers array<string>, shapes array<bigint>, twice array<bigint>, hyphens array<struct<head:string,mark:string,tail:string,step:int>>, has_page boolean"


def text_facts(texts: DataFrame) -> DataFrame:
    """The facts of every text: its key columns and FACTS. ``texts``: key columns, raw_text, own_name."""
    keys = [c for c in texts.columns if c not in ("raw_text", "own_name")]
    types = dict(texts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            facts = [facts_of(t, o or "") for t, o in zip(b["raw_text"], b["own_name"], strict=True)]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(facts, columns=["words", "numbers", "shapes", "twice", "hyphens", "has_page"])], axis=1)

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys]) + ", " + FACTS
    return spread(texts.where("raw_text is not null and raw_text <> ''")).mapInPandas(run, schema)


def anagram_hash(word: Column) -> Column:
    """Sum of the characters' values; the same for all orders of the same characters."""
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a + F.shiftright(F.xxhash64(c), 16))


def corrections(counts: DataFrame, confusions: tuple[tuple[str, str], ...]) -> DataFrame:
    """word → variant for rare words with a frequent variant; ``counts``: word, n. Best-ranked variant only."""
    spark = counts.sparkSession
    table = F.broadcast(spark.createDataFrame(list(confusions), "seen string, meant string").withColumn("shift", anagram_hash(F.col("meant")) - anagram_hash(F.col("seen"))))
    hashed = counts.withColumn("h", anagram_hash(F.col("word")))
    frequent = hashed.where(F.col("n") >= LEAST_SEEN).select(F.col("word").alias("variant"), F.col("n").alias("variant_n"), F.col("h").alias("vh"))
    # The places of a word where a confusion may be seen meet the table by equality; words too frequent for any variant stay out.
    lengths = sorted({len(seen) for seen, _ in confusions})
    most = counts.agg(F.coalesce(F.max("n"), F.lit(0)) / TIMES).first()[0]
    places = F.sequence(F.lit(1), F.length("word"))
    pieces = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring("word", i, F.lit(k)) for k in lengths]))))
    rare = hashed.where((F.col("n") <= most) & (F.length("word") > 0)).withColumn("seen", F.explode(pieces)).join(table, "seen").withColumn("key", F.col("h") + F.col("shift"))
    met = rare.join(frequent, F.col("key") == F.col("vh")).where(F.col("variant_n") >= F.col("n") * TIMES)
    word, seen, meant = F.col("word"), F.col("seen"), F.col("meant")
    places = F.sequence(F.lit(1), F.length(word) - F.length(seen) + 1)
    fits = F.exists(places, lambda i: (F.substring(word, i, F.length(seen)) == seen) & (
        F.concat(F.substring(word, F.lit(1), i - 1), meant, F.substring(word, i + F.length(seen), F.length(word))) == F.col("variant")))
    ranked = met.where(fits).groupBy("word").agg(F.max_by(F.struct("variant", "seen", "meant"), F.struct("variant_n", "variant")).alias("best"))
    return ranked.select("word", "best.variant", "best.seen", "best.meant")


def find_noise(texts: DataFrame) -> dict[str, DataFrame]:
    """Evidence tables over ``texts``: facts, fixes (word, variant, seen, meant), headers (shape), joins (head, tail)."""
    facts = cut(text_facts(texts))
    counts = cut(facts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    latin = F.col("word").rlike("^[a-z0-9]+$")
    fixes = cut(
        corrections(counts.where(latin & (F.length("word") > 1)), LATIN_CONFUSIONS)
        .unionByName(corrections(counts.where(~F.col("word").rlike("^[a-z0-9-]+$")), HAN_CONFUSIONS))
    )
    shape_counts = facts.select(F.explode("shapes").alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))
    repeated = facts.select("resume_id", F.explode("twice").alias("shape")).groupBy("shape").agg(F.count("*").alias("k"), (F.min("resume_id") < F.max("resume_id")).alias("in_files"))
    headers = cut(repeated.where("in_files").join(shape_counts, "shape").where("k >= 0.04 * n").select("shape"))
    divided = facts.select(F.explode("hyphens").alias("h")).select("h.head", "h.tail", "h.mark").distinct()
    # The four counts of a divided word are asked for at once.
    asked = divided.select("*", F.posexplode(F.array(F.lower(F.concat("head", "tail")), F.lower(F.concat_ws("-", "head", "tail")), F.lower("head"), F.lower("tail"))).alias("which", "word"))
    asked = asked.join(counts.select("word", "n"), "word", "left").groupBy("head", "tail", "mark").agg(
        *[F.coalesce(F.max(F.when(F.col("which") == i, F.col("n"))), F.lit(0)).alias(name) for i, name in enumerate(("whole_n", "dashed_n", "head_n", "tail_n"))])
    always = F.col("mark").isin("¬", "­")
    known = F.col("whole_n") > F.col("dashed_n")
    unknown = (F.col("whole_n") == 0) & (F.col("dashed_n") == 0) & ~((F.col("head_n") >= LEAST_SEEN) & (F.col("tail_n") >= LEAST_SEEN))
    joins = cut(asked.where((always & (F.col("whole_n") >= F.col("dashed_n"))) | known | unknown).select("head", "tail", "mark").distinct())
    return {"facts": facts, "fixes": fixes, "headers": headers, "joins": joins}


def noise_kinds(found: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per text and kind of damage: the keys and noise_kind."""
    facts = found["facts"]
    page = facts.where("has_page").select(*keys, F.lit("page_no").alias("noise_kind"))
    header = facts.select(*keys, F.explode("shapes").alias("shape")).join(bounded(found["headers"]), "shape", "left_semi").select(*keys, F.lit("header").alias("noise_kind"))
    divided = facts.select(*keys, F.explode("hyphens").alias("h")).select(*keys, "h.head", "h.tail", "h.mark")
    hyphen = divided.join(bounded(found["joins"]), ["head", "tail", "mark"], "left_semi").select(*keys, F.lit("hyphen").alias("noise_kind"))
    words = facts.select(*keys, F.explode("words").alias("word")).join(bounded(found["fixes"].select("word")), "word", "left_semi")
    digits = facts.where(F.size("numbers") > 0)
    misread = words.select(*keys).unionByName(digits.select(*keys)).withColumn("noise_kind", F.lit("misread"))
    return page.unionByName(header).unionByName(hyphen).unionByName(misread).distinct()


def repaired(text: str | None, own: str, fixes: dict[str, tuple[str, str, str]], headers: set[int], joins: set[tuple[str, str]]) -> str | None:
    """The text as continuous paragraphs without its noise; a text without noise comes back as it is."""
    if text is None:
        return None
    lines = without_noise_lines(text.replace("\r\n", "\n").split("\n"), headers, own)
    numbers = _NUMBER.search(text)
    if not (fixes or joins or numbers or len(lines) < len(text.replace("\r\n", "\n").split("\n"))):
        return text
    widths = [sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in x) for x in lines]
    full = max(widths, default=0)
    out: list[str] = []
    for i, line in enumerate(lines):
        if out:
            before, end, start = out[-1], _LINE_END.search(out[-1]), _LINE_START.match(line)
            if end and start and (end[1], start[1]) in joins:
                out[-1] = before[: end.start(2)] + line.lstrip()
                continue
            if end and start:
                out[-1] = before.rstrip() + line.lstrip()
                continue
            wrapped = widths[i - 1] >= 0.72 * full and not BULLET.match(line) and not _STRUCTURAL.search(line) and not _STRUCTURAL.search(lines[i - 1]) and before.strip() and line.strip() and before.rstrip()[-1] not in "。.!！?？:："
            if wrapped or (line.strip() and line.strip()[0] in "。，；、！？"):
                out[-1] = before + ("" if before[-1] > "⺀" or line[0] > "⺀" else " ") + line
                continue
        out.append(line)
    clean = "\n".join(out)
    clean = _NUMBER.sub(lambda m: m[0].replace("l", "1").replace("O", "0"), clean)
    for word, (variant, seen, meant) in sorted(fixes.items(), key=lambda x: -len(x[0])):
        if word.isascii():
            def swap(m: re.Match, variant: str = variant) -> str:
                return variant.capitalize() if m[0][0].isupper() or (not m[0][0].isalpha() and m.start() and clean[m.start() - 2 : m.start()] in (". ", "\n", "- ", "• ")) else variant
            clean = re.sub(rf"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", swap, clean, flags=re.IGNORECASE)
        else:
            pattern = "".join("(\\d)" if c == "9" else re.escape(c) for c in word)
            clean = re.sub(pattern, lambda m, s=seen, b=meant: m[0].replace(s, b), clean)
    return clean


def repair(texts: DataFrame) -> DataFrame:
    """``texts`` with ``clean_text``. Keys must include resume_id.

    Null texts stay null, empty ones empty; texts of any length are read whole; repeated rows are repaired alike and come back once each;
    a text without noise is unchanged; an empty table gives an empty table. With few texts there is little evidence, so
    only damage of its own form (page numbers, digits) is sure to go.
    """
    keys = [c for c in texts.columns if c not in ("raw_text", "own_name")]
    found = find_noise(texts)
    facts = found["facts"]
    fixes = facts.select(*keys, F.explode("words").alias("word")).join(bounded(found["fixes"]), "word").groupBy(*keys).agg(F.collect_set(F.struct("word", "variant", "seen", "meant")).alias("fixes"))
    headers = facts.select(*keys, F.explode("shapes").alias("shape")).join(bounded(found["headers"]), "shape", "left_semi").groupBy(*keys).agg(F.collect_set("shape").alias("headers"))
    joins = facts.select(*keys, F.explode("hyphens").alias("h")).select(*keys, "h.head", "h.tail", "h.mark").join(bounded(found["joins"]), ["head", "tail", "mark"], "left_semi")
    joins = joins.groupBy(*keys).agg(F.collect_set(F.struct("head", "tail")).alias("joins"))

    @F.pandas_udf("string")
    def mend(text: pd.Series, own: pd.Series, fix: pd.Series, head: pd.Series, join: pd.Series) -> pd.Series:
        return pd.Series([
            repaired(
                t, o or "", {} if f is None else {x["word"]: (x["variant"], x["seen"], x["meant"]) for x in f}, set() if h is None else {int(x) for x in h},
                set() if j is None else {(x["head"], x["tail"]) for x in j},
            )
            for t, o, f, h, j in zip(text, own, fix, head, join, strict=True)
        ])

    whole = texts.join(fixes, keys, "left").join(headers, keys, "left").join(joins, keys, "left")
    return whole.withColumn("clean_text", mend("raw_text", "own_name", "fixes", "headers", "joins")).drop("fixes", "headers", "joins")
