"""Names through whole texts: parts, titles, scripts, country codes."""

from __future__ import annotations

import re

import pytest

from tallyscope.llm import surrogates


def new_texts(spark, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in surrogates.replaced(docs).orderBy("doc_id").collect()]


def test_one_person_under_several_titles(spark):
    text = "Mr. John Smith met Dr. John Smith. Smith said hello; John Smith agreed. Mr Smith left. SMITH'S hat, Johnson's coat."
    new = new_texts(spark, text)[0]
    found = re.fullmatch(r"Mr\. (\w+) (\w+) met Dr\. (\w+) (\w+)\. (\w+) said hello; (\w+) (\w+) agreed\. Mr (\w+) left\. (\w+)'S hat, Johnson's coat\.", new)
    a, b, c, d, e, f, g, h, i = found.groups()
    assert a == c == f and b == d == e == g == h == i.capitalize() and a != b and not {"John", "Smith"} & {a, b}
    assert a.endswith("nor"), "John is called Mr"


def test_gender_belongs_to_the_person(spark):
    german, other = new_texts(spark, "Frau Anna Müller traf Prof. Dr. Anna Müller. Anna Müller und Herr Müller gingen.", "Dr. Anna Weber kam, Anna blieb.")
    a, b = re.match(r"Frau (\w+) (\w+) traf", german).groups()
    assert german == f"Frau {a} {b} traf Prof. Dr. {a} {b}. {a} {b} und Herr {b} gingen."
    assert a.endswith("na") and b.endswith("ni") and other.count(a) == 2 and "Weber" not in other and "Anna" not in german + other


def test_scripts_are_kept(spark):
    greek, russian, chinese = new_texts(spark, "Dr Νίκος Παπαδόπουλος και Παπαδόπουλος", "господин Иванов и Иванов", "我见到王先生和李小明教授。")
    assert re.fullmatch(r"Dr [Α-ω]+ ([Α-ω]+) και \1", greek) and "Παπαδ" not in greek
    assert re.fullmatch(r"господин ([А-я]+нов) и \1", russian) and "Иванов" not in russian
    assert re.fullmatch(r"我见到\w先生和\w{3}教授。", chinese) and "王" not in chinese and "李小明" not in chinese


@pytest.mark.parametrize("phone", ["+44 7700 900123", "+1 (743) 555-3824", "+971 50 123 4567", "07700 900123", "020 7946 0018"])
def test_country_codes_and_national_numbers(spark, phone):
    new = new_texts(spark, f"call {phone} now")[0][5:-4]
    code = re.match(r"\+\d+|0", phone)[0]
    assert new != phone and new.startswith(code) and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", phone)


def test_other_words_stay(spark):
    texts = ["Smith has no title here, nor 0123 45 or 2024-01-02.", "The Prof said so. Mr", "Mr O'Brien met Straß, Mrs Straß and Ms Strass; J. Strass, STRASS."]
    new = new_texts(spark, *texts)
    assert new[:2] == texts[:2]
    assert "Brien" not in new[2] and "Stra" not in new[2] and "STRASS" not in new[2] and "; J. " in new[2]


def test_names_of_different_gender_stay_distinct(spark):
    rows = [("name", f"{g} {a}{b}") for g, ab in (("m", "李王"), ("f", "赵陈"), ("n", "周何")) for a in ab for b in "一二三四五六七八九十"] + [("name", f"n {x}") for x in "张刘孙马朱胡郭林高罗郑梁谢宋唐许韩邓冯曹"]
    got = surrogates.mapping(spark.createDataFrame(rows, "kind string, canon string")).collect()
    forms = [r.form[2:] for r in got]
    assert len(got) == len(rows) == len(set(forms)) and not set(forms) & {r.canon[2:] for r in got}


def test_key_of_the_session(spark):
    text = "Mr Smith, a@b.example"
    first = new_texts(spark, text)
    spark.conf.set(surrogates.KEY_SETTING, "another key")
    try:
        second = new_texts(spark, text)
    finally:
        spark.conf.unset(surrogates.KEY_SETTING)
    assert first != second and new_texts(spark, text) == first
