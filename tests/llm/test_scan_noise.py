import pytest

from talweg.llm.scan_noise import HAN_CONFUSIONS, LATIN_CONFUSIONS, PAGE_NO, corrections, facts_of, find_noise, line_shapes, noise_kinds, repair


@pytest.mark.parametrize("line", ["p. 1/5", "1 | 4", "第9页", "第 9 页 共 9 页", "页码:1", "- 3 -", "· 2 ·", "7", "2/3", "Pg 4", "Page 2 of 9", "[3]"])
def test_page_numbers(line):
    assert PAGE_NO.match(line)


@pytest.mark.parametrize("line", ["2019", "Page 9 of the handbook was my part.", "99%.", "12 months", "第9页码表", "13800001234", ""])
def test_no_page_numbers(line):
    assert not PAGE_NO.match(line)


def test_corrections_by_anagram_hash(spark):
    words = [("service", 90), ("5ervice", 2), ("scrvice", 1), ("requests", 50), ("reqiiests", 2), ("srnall", 1), ("small", 40), ("rare", 2), ("rarc", 1), ("listen", 80), ("silent", 1), ("common", 60), ("cornmon", 55), ("the", 900), ("fhe", 1)]
    got = {r["word"]: r["variant"] for r in corrections(spark.createDataFrame(words, "word string, n bigint"), LATIN_CONFUSIONS).collect()}
    assert got == {"5ervice": "service", "scrvice": "service", "reqiiests": "requests", "srnall": "small", "fhe": "the"}  # an anagram is no variant, and a frequent word no misreading
    grams = [("性的", 900), ("性旳", 3), ("人小", 50), ("入小", 1), ("返エ率", 2), ("返工率", 70)]
    got = {r["word"]: r["variant"] for r in corrections(spark.createDataFrame(grams, "word string, n bigint"), HAN_CONFUSIONS).collect()}
    assert got == {"性旳": "性的", "返エ率": "返工率"}
    assert corrections(spark.createDataFrame([], "word string, n bigint"), LATIN_CONFUSIONS).count() == 0


def test_facts():
    f = facts_of("The packag-\ning work\n3\nmoderat- \nDervoave Systems - recruitment copy\nion gate", "")
    assert [(h["head"], h["tail"]) for h in f["hyphens"]] == [("packag", "ing"), ("moderat", "ion")] and f["has_page"]
    assert facts_of("历时l0个月 版本 v1l https://x/1l", "")["numbers"] == ["l0"]
    assert "pneumonoultramicroscopicsilicovolcanoconioses" in facts_of("a pneumonoultramicroscopicsilicovolcanoconioses b", "")["words"]
    two = facts_of("The loc-\nSome Header Here\n3\nAnother Header Here\nalised work", "")["hyphens"]
    assert [(h["head"], h["tail"]) for h in two] == [("loc", "alised")]


def test_shapes_of_lines():
    assert line_shapes("• item", "") == () and line_shapes("方舟晴 个人简历", "方舟晴")[0] == "N 个人简历"
    shared = lambda a, b: set(line_shapes(a, "")) & set(line_shapes(b, ""))
    assert shared("方舟晴 个人简历", "简初辰 个人简历") and shared("Brais Cloat | Resume", "Лучана Ожегран | Resume")
    assert not shared("Acme Corp confidential resume", "I maintained my own resume") and not shared("Acme Corp confidential", "was kept confidential")


def corpus():
    good = "Owned the packaging work of the service desk and raised the requests.\nWants to keep working on customer-facing tools."
    rows = [(f"g{i}", good, None) for i in range(60)]
    rows += [(f"h{i}", f"CONFIDENTIAL FILE 1{i:04d}\n{good}\nCONFIDENTIAL FILE 1{i:04d}", None) for i in range(4)]
    rows += [
        ("a", "Owned the packag-\ning work of the 5ervice desk and raised the reqiiests.\np. 1/5\nWants to keep working on customer-\nfacing tools.", None), ("b", "Wants to keep working on customer-\nfacing tools.", None),
        ("c", None, None), ("d", "", None), ("e", "2019\nBudget of 13,982,465 credits kept.", None), ("f", "word " * 100_000, None), ("b", "Wants to keep working on customer-\nfacing tools.", None),
    ]
    return [(i, "work_raw_block", 1, t, o) for i, t, o in rows]


def test_kinds_and_repair(spark):
    texts = spark.createDataFrame(corpus(), "resume_id string, field_name string, item_no int, raw_text string, own_name string")
    keys = ["resume_id", "field_name", "item_no"]
    got = {}
    for r in noise_kinds(find_noise(texts), keys).collect():
        got.setdefault(r["resume_id"], set()).add(r["noise_kind"])
    assert got == {"a": {"hyphen", "misread", "page_no"}, **{f"h{i}": {"header"} for i in range(4)}}
    clean = {r["resume_id"]: (r["raw_text"], r["clean_text"]) for r in repair(texts.distinct()).collect()}
    assert clean["a"][1] == "Owned the packaging work of the service desk and raised the requests.\nWants to keep working on customer-facing tools."
    assert clean["c"][1] is None and clean["d"][1] == "" and "FILE" not in clean["h1"][1]
    assert all(clean[k][0] == clean[k][1] for k in ("b", "e", "f", "g1"))
    assert noise_kinds(find_noise(texts.limit(0)), keys).count() == 0
