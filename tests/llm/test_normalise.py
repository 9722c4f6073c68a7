import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from talweg.functions.charfold import plain_form
from talweg.llm.normalise import changed_values, normalise, normalise_column, segments

CASES = {
    "Ｓｗｉｆｔ（熟练）": "Swift(熟练)", "Lucía": "Lucía", "Re​dis­": "Redis", "Data Visualization": "Data Visualization", "Product‑Management": "Product-Management",
    "Руthоn": "Python", "ВАЅН": "BASH", "Αnsibble": "Ansibble", "⽅砚序": "方砚序", "前端开发能カ": "前端开发能力", "proﬁcient": "proficient", "Луча​на": "Лучана",
}
STEADY = ["", "Русский язык", "Ελληνικά", "日本語 N2", "Zoë Hölzbrück", "墨州大學", "plain text, as it is", "カタカナ"]


def test_cases():
    for raw, plain in CASES.items():
        assert normalise(raw) == plain
    for text in STEADY:
        assert normalise(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAzéе́рＣ１－​ 　⼤大カ.，ο", max_size=24))
def test_same_as_whole_text_and_stable(text):
    out = normalise(text)
    assert out == plain_form(text)
    assert unicodedata.is_normalized("NFC", out)


def test_segments_are_apart_and_cover_unstable():
    text = "ok é ok​ok Ｑ end"
    spans = segments(text)
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert [text[a:b] for a, b in spans] == ["é", "ok​ok", "Ｑ"]


def test_long_text():
    text = "word " * 200_000 + "Ｑ"
    assert normalise(text) == "word " * 200_000 + "Q"


def test_columns(spark):
    rows = [("1", None, 1), ("2", "", 1), ("3", "Ｃ＋＋", 1), ("3", "Ｃ＋＋", 1), ("4", "C++", 1)]
    df = spark.createDataFrame(rows, "id string, value string, plain_text int")
    assert sorted((r["id"], r["plain_text"] or "") for r in normalise_column(df, "value").collect()) == [("1", ""), ("2", ""), ("3", "C++"), ("3", "C++"), ("4", "C++")]
    found = changed_values(df.drop("plain_text"))
    assert [(r["id"], r["plain_text"]) for r in found.collect()] == [("3", "C++")] * 2
    assert normalise_column(df.limit(0), "value").count() == changed_values(df.drop("plain_text").limit(0)).count() == 0


def test_what_looks_otherwise_is_no_case(spark):
    rows = [("C²",), ("x½",), ("①组",), ("Ꭺpple",), ("Ｃ²",)]
    got = {r["value"]: r["plain_text"] for r in changed_values(spark.createDataFrame(rows, "value string")).collect()}
    assert got == {"Ꭺpple": "Apple", "Ｃ²": "C²"}
