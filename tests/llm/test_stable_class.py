"""The shortcut past Python lets no character by that the operator would replace."""

import re

from talweg.functions.charfold import LOOKALIKE
from talweg.llm.normalise import STABLE_CLASS, _unstable, changed_values, normalise


def test_stable_class_holds_stable_characters_only():
    stable = re.compile(f"[{STABLE_CLASS}]")
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert [c for c in every if stable.match(c) and (c in LOOKALIKE or _unstable(c))] == []


def test_values_of_one_such_character(spark):
    wanted = {"Lınux": "Linux", "Ĳssel": "IJssel", "coĿlega": "coL·lega", "Ĵo": None}
    got = {r["value"]: r["plain_text"] for r in changed_values(spark.createDataFrame([(v,) for v in wanted], "value string")).collect()}
    assert got == {v: plain for v, plain in wanted.items() if plain} and normalise("Ĵo") == "Ĵo"
