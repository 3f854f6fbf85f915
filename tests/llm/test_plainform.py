import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import lookalikes
from ledgerloom.llm.plainform import UNTOUCHED, learn_script_scores, plain, plain_with_offsets
from ledgerloom.operators.scratch import Scratch

SCHEMA = "id string, captured_text string, excerpt string, url string, field string, form string, value string"


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "stored, seen",
    [
        ("Ｗｉｄｅ　ｔｅｘｔ", "Wide text"),
        ("zero​width­", "zerowidth"),
        ("a b c", "a b c"),
        ("ﬁne ﬂow", "fine flow"),
        ("café", "café"),
        ("Тһе ledger", "The ledger"),
        ("рlugіn fоr tһе ԝіn", "plugin for the win"),
        ("Задача с весны", "Задача с весны"),
        ("Зaдaчa c вecны", "Задача с весны"),
        ("soft‑hyphen‐kind", "soft-hyphen-kind"),
        ("wait…", "wait..."),
        ("ｶﾞﾗｽ｡", "ガラス。"),
        ("“quoted” — dash", "“quoted” — dash"),
        ("keep\ttabs\nand  spaces", "keep\ttabs\nand  spaces"),
        ("", ""),
    ],
)
def test_plain(stored, seen):
    assert plain(stored) == seen


def test_equal_looking_forms_agree_whatever_is_stored():
    variants = ["с весны", "c весны"]
    assert len({plain(v + " зависает") for v in variants}) == 1


def test_learned_scores_never_part_equal_looking_values():
    from ledgerloom.llm.plainform import CYRILLIC, GREEK, ScriptScores

    greek = ScriptScores({(GREEK, a, b): 9 for a, b in (("", "τ"), ("τ", "κ"), ("κ", "τ"), ("τ", ""))} | {(CYRILLIC, "", "с"): 5})
    assert plain("ΤΚΤ-1也", greek) == plain("TKT-1也", greek) == "TKT-1也"
    assert plain("c весны", greek) == plain("с весны", greek) == "с весны"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_plain_is_stable_and_offsets_point_back(text):
    form, offsets = plain_with_offsets(text)
    assert form == plain(text)
    if offsets is not None:
        assert len(offsets) == len(form) and offsets == sorted(offsets)
        assert all(0 <= o < len(text) for o in offsets)


def test_untouched_texts_are_their_own_form(spark):
    texts = ["plain", "¿qué?", "日本語、です。", "a\tb\n", "ÀÖß", "İ"]
    flags = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(UNTOUCHED)).collect()]
    assert all(plain(t) == t for t, f in zip(texts, flags) if f)
    assert all(plain(t) == unicodedata.normalize("NFC", t) for t in texts)


def test_pairs_excerpts_nulls_and_repeats(spark):
    rows = _rows(spark, [
        ("a", "Ｈello", "Hello", "http://x"), ("b", "Hello", None, "http://х"), ("c", "Hello", "Nope", None), ("c", "Hello", "Nope", None),
        ("d", None, "x", ""), ("e", "   ", None, " "), ("f", "​", None, None), (None, "Hеllo", None, None), ("g", "Hеllо there", "Hello", None),
    ])
    got = {tuple(r) for r in lookalikes.equal_looking(rows, Scratch(spark)).collect()}
    assert got == {("captured_text", "a", "b"), ("captured_text", "a", "c"), ("url", "a", "b"), ("excerpt", "a", "a"), ("excerpt", "g", "g")}


def test_empty_table_and_learning(spark):
    none = _rows(spark, []) if False else spark.createDataFrame([], SCHEMA)
    assert lookalikes.equal_looking(none, Scratch(spark), learn_script_scores(none, "captured_text")).count() == 0
    rows = _rows(spark, [("a", "the cat sat " * 50, None, None), ("b", None, None, None), ("c", "", None, None)])
    scores = learn_script_scores(rows, "captured_text")
    assert scores.log[0, "t", "h"] > scores.log.get((0, "t", "x"), -99)
    assert [r.captured_text for r in lookalikes.plain_values(rows, ("captured_text",), scores).orderBy("id").collect()][1:] == [None, ""]


def test_very_long_text(spark):
    text = "Ａ" * 300_000
    assert plain(text) == "A" * 300_000
