from talweg.functions.charfold import fold, plain_form


def test_forms():
    assert plain_form("Ｓｗｉｆｔ（熟练）") == "Swift(熟练)"
    assert plain_form("Руthоn") == "Python"
    assert plain_form("ВАЅН") == "BASH"
    assert plain_form("前端开发能カ") == "前端开发能力"
    assert plain_form("⼤学​") == "大学"
    assert plain_form("Русский язык") == "Русский язык"
    assert plain_form("日本語 N2") == "日本語 N2"
    assert fold(" Deep  LEARNING ") == "deep learning"
    assert plain_form("Ꭺpple") == "Apple" and plain_form("ᎣᏏᏲ") == "ᎣᏏᏲ"


def test_what_looks_otherwise_stays():
    for text in ("C²", "x½", "①组", "H₂O", "㎡ 測", "Node™"):
        assert plain_form(text) == text
    assert plain_form("Ｃ² ｅ́") == "C² é"
