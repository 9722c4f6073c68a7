import math
import random

import pytest

from talweg.llm.pii import Flat, find_personal_data, redact, revealing_terms, shaped_spans

SHAPES = [
    ("mail a.b@inbox.test / (415) 555 0114", {"email", "phone"}), ("x+jobs (at) inbox.test", {"email"}), ("y[at]post[dot]orrow[dot]example", {"email"}), ("z at inbox dot test", {"email"}), ("q＠mailnest.example", {"email"}),
    ("手机:145.0000.0872", {"phone"}), ("电话008615800006763", {"phone"}), ("Tel (+86)199-0000-8158", {"phone"}), ("+44 7700 900611", {"phone"}), ("020 7946 0424", {"phone"}), ("030 23125 040", {"phone"}), ("303.555.0110 ext. 54", {"phone"}),
    ("证件:998328200408139336", {"id_number"}), ("身份证号 998407 19850401 7922", {"id_number"}), ("ID: 999-12-3456", {"id_number"}), ("National no. QQ 92 11 23 C", {"id_number"}), ("ID ZZ0686479.", {"id_number"}),
    ("现居 临汀市云庭小区17单元1702", {"address"}), ("办公地点在临栾市柳墩街133弄14号", {"address"}), ("235 Werhannd St., Apt 16B, Whoflum", {"address"}), ("Flat 9, 188 Whandinrn Court", {"address"}), ("rue Folins 307, Fatrinm", {"address"}),
    ("Lives at Darteandstrasse 322, 10322 Grelrelr", {"address"}),
    ("Alice and 13800001234 called", {"phone"}), ("Sam and 555-12-3456", {"id_number"}), ("在 @all 群内发布68次通知", set()), ("Serial SN-9361-3919-517 retired.", set()), ("接口版本 12.3.45.6", set()), ("https://folio.example/1bb5cc13800001234", set()),
    ("Parcel no. 4749 8612 5888 3275 arrived", set()), ("预算合计 13,982,465 元", set()), ("城市:云浦市", set()), ("2021.03 - 2024.06", set()), ("", set()),
]


@pytest.mark.parametrize(("text", "kinds"), SHAPES)
def test_shapes(text, kinds):
    assert {k for k, _, _ in shaped_spans(text)} == kinds


def test_places_across_line_ends():
    text = "办公地点在临栾市柳墩\n街133弄14号 end"
    (kind, a, b), = shaped_spans(text)
    assert kind == "address" and text[a:b].endswith("14号") and Flat("a\nb").flat == "a\nb"
    flat = Flat("一\n二三\nx\n四\n五")
    assert flat.flat == "一二三\nx\n四五" and [flat.at(i) for i in range(9)] == [0, 2, 3, 4, 5, 6, 7, 9, 10]


TEXTS = [
    ("1", "汇报对象为褚言遥\n预算", "方舟晴"), ("2", "接替骆牧岚担任组长,交接人阮沐辰", None), ("3", "方舟晴 的简历\n建数据库", "方舟晴"), ("4", "Reported to Clarck Clartwell during it. Machine Learning helped.", None),
    ("5", "Took over from Ms. Šarvík and trained Vaick Terckby.", None), ("6", None, None), ("7", "", None), ("8", "Stinpath Systems " * 20_000, None), ("2", "接替骆牧岚担任组长,交接人阮沐辰", None),
]
NAMES = ["褚言遥", "骆牧岚", "阮沐辰", "方舟晴", "程知岚", "程言辰", "褚牧遥", "骆言遥", "阮知晴", "方牧辰", "程沐遥", "Clarck Terckby", "Vaick Clartwell", None, " "]


def test_names_and_redaction(spark):
    texts = spark.createDataFrame([(i, t, o, "x") for i, t, o in TEXTS], "rec string, raw_text string, own_name string, extra string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = {}
    for r in find_personal_data(texts, names).collect():
        found.setdefault(r["rec"], set()).add(TEXTS[int(r["rec"]) - 1][1][r["start_at"] : r["end_at"]])
    assert found.pop("4") >= {"Clarck Clartwell"}  # with two Latin names known little tells others from names
    assert found == {"1": {"褚言遥"}, "2": {"骆牧岚", "阮沐辰"}, "3": {"方舟晴"}, "5": {"Vaick Terckby"}}
    clean = {r["rec"]: r["clean_text"] for r in redact(texts, names).collect()}
    assert clean["2"] == "接替[NAME]担任组长,交接人[NAME]" and clean["5"] == "Took over from Ms. Šarvík and trained [NAME]."
    assert clean["3"] == "[NAME] 的简历\n建数据库" and clean["6"] is None and clean["7"] == ""
    assert find_personal_data(texts.limit(0), names).count() == 0
    assert {r["rec"] for r in find_personal_data(texts, names.limit(0)).collect()} >= {"3"}


def _people(n, seed):
    rng = random.Random(seed)
    syllables = ["ba", "den", "kor", "li", "mos", "nar", "pel", "rin", "sta", "tov", "vel", "wick", "zan", "gor"]
    word = lambda: "".join(rng.choices(syllables, k=3)).capitalize()
    return [f"{word()} {word()}" for _ in range(n)]


def test_cues_are_learnt_from_the_corpus(spark):
    """Sentences that no list of cue words has: unknown people are found where known ones stand, the same words elsewhere are not."""
    people, places = _people(60, 1), _people(60, 2)
    known, unknown = people[:30], people[30:]
    rows = [(f"k{i}", f"The crane was signed off by {p} last spring.", None) for i, p in enumerate(known)]
    rows += [(f"u{i}", f"The crane was signed off by {p} last spring.", None) for i, p in enumerate(unknown)]
    rows += [(f"t{i}", f"On the way we thanked Mdm. {p.split()[1]} for it", None) for i, p in enumerate(known[:15] + unknown[:5])]
    rows += [(f"p{i}", f"We went as far as {p} on that day.", None) for i, p in enumerate(places)]
    rows += [(f"n{i}", f"Consignment 1380000{i:04d} left the yard" if i % 9 == 0 else f"Consignment 77{i:07d} left the yard", None) for i in range(60)]
    rows += [(f"m{i}", f"my mobile 1380001{i:04d} is on", None) for i in range(20)]
    texts = spark.createDataFrame(rows, "rec string, raw_text string, own_name string")
    names = spark.createDataFrame([(p,) for p in known], "name string")
    got = {(r["rec"], r["pii_type"]) for r in find_personal_data(texts, names).collect()}
    want = {(r, "name") for r, _, _ in rows if r[0] in "kut"} | {(r, "phone") for r, _, _ in rows if r[0] == "m"}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)
    # without what co-occurrence discloses nobody is found by name
    assert {k for _, k in ((r["rec"], r["pii_type"]) for r in find_personal_data(texts, names, least_bits=math.inf).collect())} == {"phone"}


def test_revealing_terms(spark):
    rows = [(f"r{i}", k, "common words about kafka", None) for i in range(8) for k in (0, 1)] + [("r1", 2, "project Zyxquill for kafka 20231", None), ("r1", 3, "Zyxquill again, a.b@c.test", None), ("r2", 2, "Onceword", None), (None, 9, "x", None), ("r3", 5, None, None)]
    texts = spark.createDataFrame(rows, "rec string, part int, raw_text string, own_name string")
    names = spark.createDataFrame([], "name string")
    got = {(r["rec"], r["term"]): r["bits"] for r in revealing_terms(texts, "rec", 2.5).collect()}
    assert got == {("r1", "zyxquill"): 3.0}
    clean = {(r["rec"], r["part"]): r["clean_text"] for r in redact(texts, names, entity="rec", least_bits=2.5).collect()}
    assert clean["r1", 2] == "project [TERM] for kafka 20231" and clean["r1", 3] == "[TERM] again, [EMAIL]" and clean["r3", 5] is None and clean["r0", 0] == rows[0][2]
