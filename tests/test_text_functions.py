"""Text functions on literals of the scripts that they are for, and against plain Python."""

import re

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import analytics, segmentation
from tessera.sources import tables

JAPANESE = "次の文章を読んで、問題に答えなさい。グラフから読み取れることはどれですか。"


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def classes(c):
    for name, pattern in (("hira", "[぀-ゟ]"), ("kata", "[゠-ヿｦ-ﾝ]"), ("kanji", "[一-鿿㐀-䶿]"), ("han", "[가-힣]"), ("digit", "[0-9０-９]"), ("latin", "[A-Za-zＡ-Ｚａ-ｚ]")):
        if re.match(pattern, c):
            return name
    return "punct" if c in "。、・「」『』（）()［］【】，．,.!?！？：:;；…ー―─-—–%％&/／＝=+×÷±°〜~|｜’'\"“”" else "other"


def brute_score(text):
    chars = [c for c in text if not c.isspace()]
    if not chars:
        return 0.0, 1.0
    kinds = [classes(c) for c in chars]
    runs = sum(len(m[0]) for m in re.finditer(r"(?s)(.)\1{3,}", text)) + sum(len(m[0]) for m in re.finditer(r"(?s)((.)(?!\2).)\1{2,}", text))
    broken = min(1.0, (kinds.count("other") + 0.5 * runs) / len(chars))
    meaningful = sum(k not in ("punct", "other") for k in kinds) / len(chars)
    return max(0.0, 100 - 70 * broken - 30 * (1 - meaningful) - (25 if len(text) < 10 else 8 if len(text) < 25 else 0)), broken


@pytest.mark.parametrize("text", [JAPANESE, "경제 성장률을 구하시오. 다음 그래프를 보고 답하시오.", "short", "", " 　\n", "ーーーーーー＊＊＊＊■■□□◆", "ﾊﾞｰﾊﾞｰﾊﾞｰﾊﾞｰ ababababab", "Ｔｈｅ ｅｃｏｎｏｍｙ ２０２０", "naïve café über alles, très bien"])
def test_quality_of_scripts(spark, text):
    score, broken = brute_score(text)
    assert value(spark, t.quality_score, text) == pytest.approx(score) and value(spark, t.broken_share, text) == pytest.approx(broken)


def test_quality_scores_of_documents(spark):
    rows = tables.table(spark, DATA, "documents").select("text", t.quality_score(F.col("text")).alias("s")).collect()
    assert all(r.s == pytest.approx(brute_score(r.text)[0], abs=1e-6) for r in rows)


def test_japanese_is_not_noise(spark):
    assert value(spark, t.quality_score, JAPANESE) > 85 and value(spark, t.text_quality, JAPANESE) > 0.9
    assert not value(spark, t.garbled, JAPANESE) and value(spark, t.garbled, "バーバーバーバー") and value(spark, t.garbled, "■□◆◇") and value(spark, t.garbled, "ああああああ")
    assert value(spark, t.text_key, JAPANESE) != value(spark, t.text_key, "別の問題です。") != ""
    assert value(spark, t.normal_key, "問 12　次の（Ａ）を、読め。") == "次のAを読め"
    shares = value(spark, t.script_shares, "漢字かなカナABC12")
    assert shares.kanji == pytest.approx(2 / 11) and shares.latin == pytest.approx(3 / 11) and shares.digit == pytest.approx(2 / 11)


def test_japanese_normal_forms(spark):
    assert value(spark, t.japanese_spacing, "日 本　の 経済 は GDP が") == "日本の経済は GDP が"
    assert [value(spark, t.kanji_number, x) for x in ("七", "十", "十二", "三十", "四十五", "人", "")] == [7, 10, 12, 30, 45, None, None]
    assert value(spark, t.without_readings, "経済(けいざい)と貿易（ぼうえき）") == "経済と貿易"
    assert [(r.kanji, r.reading) for r in value(spark, t.readings, "経済(けいざい)と貿易（ぼうえき）")] == [("経済", "けいざい"), ("貿易", "ぼうえき")]
    assert value(spark, t.repaired_markers, "間12 次の\n同 3 図") == "問12 次の\n問3 図"
    assert value(spark, t.formulas, "so y = 2x + 1 and E=mc^2, fine") == ["y = 2x + 1", "E=mc^2"]
    assert value(spark, lambda c: t.bridged(F.split(c, " "), {"a": ["b", "c"], "x": ["y"]}), "a d c") == ["a", "d", "c", "b"]
    assert value(spark, lambda c: t.longest_of(c, F.lit("a much longer reading"), F.lit(None).cast("string")), "short") == "a much longer reading"


def test_choices_of_either_kind(spark):
    rows = [(1, "どれか。①市場 ②政府 ③家計 ④企業"), (2, "Pick:\n1. one\n2. two\n3. three\n7. seven"), (3, "1. one\n3. three"), (4, "A) x\nB) y\nC) z")]
    found = segmentation.choices(spark.createDataFrame(rows, "id int, text string"), ["id"], "text").collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r.ordinal)):
        got.setdefault(r.id, []).append((r.label, r.choice))
    assert got == {1: [("①", "市場"), ("②", "政府"), ("③", "家計"), ("④", "企業")], 2: [("1", "one"), ("2", "two"), ("3", "three")], 4: [("A", "x"), ("B", "y"), ("C", "z")]}


def test_platt_scaling_is_the_optimum(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = rng.random(400) < 1 / (1 + np.exp(-(1.7 * x - 0.4)))
    a, b = analytics.platt(spark.createDataFrame([(float(u), int(v)) for u, v in zip(x, y)], "x double, y int"), "x", F.col("y"))
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    loss = lambda a, b: -(target * np.log(1 / (1 + np.exp(-(a * x + b)))) + (1 - target) * np.log(1 - 1 / (1 + np.exp(-(a * x + b))))).sum()
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-6 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01)) and 1 < a < 2.5
