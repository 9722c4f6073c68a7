"""Readers of résumé files: text, office documents, pages of layout JSON; page images go to a pluggable reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.text import file_kind, strip

# Layout blocks that hold no running text.
SKIPPED_BLOCKS = ("image", "chart", "seal", "footer_image", "header_image", "number", "footnote", "aside_text")
PAGES = "array<struct<page_index:int,parsing_res_list:array<struct<block_label:string,block_content:string,block_order:int,block_bbox:array<int>>>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def office_text(content: bytes) -> str:
    """Non-empty paragraphs of a word-processing file, parted by blank lines; anything unreadable gives an empty text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, NotImplementedError):
        return ""
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n\n".join(p.strip() for p in paragraphs if p.strip())


def read_files(spark: SparkSession, path: str, page_reader: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, kind and file_text of every file under ``path``.

    Text is decoded as UTF-8 with bad bytes replaced; office files give their paragraphs; PDF and image files have no text layer
    here and go to ``page_reader`` (bytes to text), without which they are empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").withColumn("kind", file_kind(F.col("path")))
    plain = files.where("kind = 'text'").select("path", "kind", strip(F.make_valid_utf8(F.col("content").cast("string"))).alias("file_text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [office_text(c) if k == "office" else (page_reader(c) if page_reader else "") for k, c in zip(b["kind"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "kind": b["kind"], "file_text": texts})

    return plain.unionByName(files.where("kind <> 'text'").mapInPandas(read, "path string, kind string, file_text string"))


def page_text(pages: Column) -> Column:
    """Running text of layout pages (type PAGES): by page, block order (missing last), then top and left; a blank line after each block."""
    blocks = F.flatten(F.transform(pages, lambda p: F.transform(p["parsing_res_list"], lambda b, i: F.struct(
        F.coalesce(p["page_index"], F.lit(0)).alias("page"), F.coalesce(b["block_order"], F.lit(10**9)).alias("order"), F.coalesce(F.get(b["block_bbox"], 1), F.lit(0)).alias("top"),
        F.coalesce(F.get(b["block_bbox"], 0), F.lit(0)).alias("left"), i.alias("seq"), F.coalesce(b["block_label"], F.lit("")).alias("label"), strip(F.coalesce(b["block_content"], F.lit(""))).alias("content")))))
    kept = F.filter(blocks, lambda b: (b["content"] != "") & ~b["label"].isin(*SKIPPED_BLOCKS))
    return F.coalesce(F.array_join(F.transform(F.array_sort(kept), lambda b: b["content"]), "\n\n"), F.lit(""))


def pages_of(json_text: Column) -> Column:
    return F.from_json(json_text, PAGES)


def recognised_texts(json_text: Column) -> Column:
    """All texts in lists under any key ``rec_texts``, in the order of the document."""
    lists = F.regexp_extract_all(F.coalesce(json_text, F.lit("")), F.lit(r'"rec_texts"\s*:\s*(\[(?:[^\]"]|"(?:[^"\\]|\\.)*")*\])'), F.lit(1))
    items = F.flatten(F.transform(lists, lambda t: F.from_json(t, "array<string>")))
    return F.filter(F.transform(items, lambda t: strip(t)), lambda t: t != "")


def word_list(text: str) -> list[str]:
    """Words of a dictionary text, one a line; # starts a comment."""
    return [w for w in (re.sub(r"#.*", "", line).strip() for line in text.splitlines()) if w]
