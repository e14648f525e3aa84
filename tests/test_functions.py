import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plenum.functions import numbers, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("1.234", 1234.0), ("1,5 mln", 1.5e6), ("2 mrd", 2e9), ("€ 1.234", 1234.0), ("12%", 12.0), ("1.5", 1.5), ("1,5mln", 1.5e6), ("2mrd", 2e9), ("3 mlj", 3e6), ("$ 5", 5.0), ("1.234.567,5", 1234567.5), ("1.5.6", 156.0), ("-1.234", -1234.0), ("x", None), (None, None)])
def test_dutch_number(spark, raw, want):
    assert value(spark, numbers.dutch_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("1.234,56", "1234.56"), ("(1.234)", "-1234.00"), ("1.234-", "-1234.00"), ("- 5", "-5.00"), ("3.14", "3.14"), ("1 234", "1234.00"), ("200000000000", None), ("abc", None), ("2,345", "2.34")])
def test_euro_amount(spark, raw, want):
    assert value(spark, numbers.euro_amount(F.lit(raw))) == (want and Decimal(want))


def test_multiplier_and_format(spark):
    assert value(spark, numbers.multiplier(F.lit("bedragen x € 1.000"))) == 1000
    assert value(spark, numbers.multiplier(F.lit("jaar"))) == 1
    assert value(spark, numbers.short_money(F.lit(2.5e6))) == "€ 2.5 mln"


D = datetime.date


@pytest.mark.parametrize("q, want", [("sinds 2019", (D(2019, 1, 1), None)), ("na 2019", (D(2019, 1, 1), None)), ("since 2019", (D(2019, 1, 1), None)), ("from 2019", (D(2019, 1, 1), None)), ("voor 2019", (None, D(2019, 12, 31))), ("last year", (D(2023, 1, 1), D(2023, 12, 31))), ("this year", (D(2024, 1, 1), D(2024, 12, 31))), ("afgelopen maand", (D(2024, 3, 3), D(2024, 6, 1))), ("tot 2019", (None, D(2019, 12, 31))), ("in 2020", (D(2020, 1, 1), D(2020, 12, 31))), ("vorig jaar", (D(2023, 1, 1), D(2023, 12, 31))), ("tussen 2018 en 2020", (D(2018, 1, 1), D(2020, 12, 31))), ("niets", (None, None))])
def test_year_range(spark, q, want):
    assert tuple(value(spark, text.year_range(F.lit(q), F.lit("2024-06-01").cast("date")))) == want


def test_texts(spark):
    assert value(spark, text.clean_name(F.lit("zzz Raad"))) == "Raad"
    assert value(spark, text.clean_name(F.lit(" 123 "))) is None
    assert value(spark, text.budget_years(F.lit("begroting 2018-2020 en 2025, 2001-2030"))) == [2001, 2018, 2019, 2020, 2025]
    assert value(spark, text.dutch_date(F.lit("op 5 maart 2024 om"))) == D(2024, 3, 5)
    assert value(spark, text.seconds(F.lit("1:02:03.5"))) == 3723.5
    assert value(spark, text.surname_key(F.lit("dhr. J. van der Berg-Smit"))) == "berg"
    assert value(spark, text.vote_outcome(F.lit("De motie wordt met 20 stemmen voor verworpen"))) == "verworpen"
    assert tuple(value(spark, text.vote_counts(F.lit("met 20 stemmen voor en 25 stemmen tegen")))) == (20, 25)
    assert value(spark, text.vote_outcome(F.lit("het amendement is aangenomen"))) == "aangenomen"
    assert value(spark, text.vote_outcome(F.lit("aangenomen: motie over groen"))) == "aangenomen"
    assert value(spark, text.vote_outcome(F.lit("aangenomen" + "x" * 201 + "motie"))) is None
    assert tuple(value(spark, text.vote_counts(F.lit("met algemene stemmen aangenomen")))) == (45, 0)
    assert value(spark, text.vote_counts(F.lit("unaniem aangenomen, 20 voor"))) is None
    assert value(spark, text.attribution(F.lit("a  b"), F.lit("x A b c"))) == "whitespace"
    assert value(spark, text.attribution(F.lit("a"), F.lit(None).cast("string"))) == "missing"
    assert value(spark, text.jaccard(text.word_set(F.lit("a b")), text.word_set(F.lit("b c")))) == pytest.approx(1 / 3)
    assert value(spark, text.grounded_share(F.lit("In 2024 kreeg Rotterdam 5 euro"), F.lit("rotterdam 2024"))) == pytest.approx(2 / 3)
    import hashlib

    assert value(spark, text.point_id(F.lit("d1"), F.lit(7))) == int(hashlib.md5(b"d1_7").hexdigest()[:15], 16)


def test_sentences_and_parties(spark):
    got = value(spark, text.sentences(F.lit("Dhr. Jansen sprak o.a. over 2024. Het college stemt in! Wat nu? ja, d.w.z. niets. 3 punten")))
    assert got == ["Dhr. Jansen sprak o.a. over 2024.", "Het college stemt in!", "Wat nu? ja, d.w.z. niets.", "3 punten"]
    assert value(spark, text.party_in_query(F.lit("aandachtspunten"))) is None
    assert value(spark, text.party_in_query(F.lit("vindt 50+ of de SP dit?"))) == "50PLUS"
    assert value(spark, text.motion_number(F.lit("Motie nr. M2023-042"))) == "M2023-042"
