"""Golden values of the personal-data scanner and mask strategies."""

from pyspark.sql import functions as F

from gatewise.functions import pii as PF
from gatewise.functions import strategies as S


def _scan(spark, text, patterns=None, whitelist=None):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(PF.scan(F.col("t"), patterns, whitelist).alias("m")).first()["m"]


def test_pan_and_email(spark):
    m = _scan(spark, "My card is 4111111111111111", ["pan"])
    assert [(x.pii_type, x.value, x.classification, x.placeholder) for x in m] == [("pan", "4111111111111111", "L4", "[REDACTED_PAN]")]
    assert _scan(spark, "Card: 4111111111111112", ["pan"]) == []
    m = _scan(spark, "Card 4111111111111111 email user@test.com")
    assert {x.pii_type for x in m} == {"pan", "email"}


def test_families(spark):
    assert [x.pii_type for x in _scan(spark, "TC: 10000000146", ["tc_kimlik"])] == ["tc_kimlik"]
    assert _scan(spark, "TC: 12345678901", ["tc_kimlik"]) == []
    assert [x.value for x in _scan(spark, "IP: 192.168.1.100", ["ip_address"])] == ["192.168.1.100"]
    assert _scan(spark, "Localhost: 127.0.0.1", ["ip_address"]) == []
    assert [x.value for x in _scan(spark, "Born: 1990-05-13", ["dob"])] == ["1990-05-13"]
    m = _scan(spark, "Phone: +905321234567", ["msisdn"])
    assert [(x.pii_type, x.field_type) for x in m] == [("msisdn", "phone")]
    assert [x.pii_type for x in _scan(spark, "IBAN: TR330006100519786457841326", ["iban"])] == ["iban_tr"]
    assert _scan(spark, "Contact admin@internal.com", ["email"], ["admin@internal.com"]) == []
    assert [x.value for x in _scan(spark, "imei 490154203237518", ["imei"])] == ["490154203237518"]
    assert _scan(spark, "imei 123456789012345", ["imei"]) == []


def test_ascii_word_boundary(spark):
    # accented letters are not word characters for the scanner (bytewise semantics)
    assert [x.value for x in _scan(spark, "é4111111111111111é", ["pan"])] == ["4111111111111111"]
    assert _scan(spark, "a4111111111111111", ["pan"]) == []


def test_mask_text(spark):
    df = spark.createDataFrame([("Card 4111111111111111 email a@b.com",), ("Contact user+tag@example.com please",), (None,), ("",)], "t string")
    out = df.select(PF.mask_text(F.col("t"), PF.scan(F.col("t"))).alias("m"), F.size(PF.scan(F.col("t"))).alias("n")).collect()
    assert (out[0].m, out[0].n) == ("Card [REDACTED_PAN] email [REDACTED_EMAIL]", 2)
    assert (out[1].m, out[1].n) == ("Contact [REDACTED_EMAIL] please", 1)
    assert out[2].m is None and out[2].n == 0
    assert (out[3].m, out[3].n) == ("", 0)


def _m(spark, strategy, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(S.apply_strategy(F.col("v"), strategy).alias("o")).first()["o"]


def test_strategies(spark):
    assert _m(spark, "last4", "4111111111111111") == "************1111"
    assert _m(spark, "last4", "1234") == "1234"
    assert _m(spark, "last4", "12345") == "*2345"
    assert _m(spark, "first2last2", "john.doe@example.com") == "jo****************om"
    assert _m(spark, "first2last2", "abcde") == "ab*de"
    assert _m(spark, "mask:email", "john.doe@example.com") == "j***@e***.com"
    assert _m(spark, "mask:email", "user@mail.example.co.uk") == "u***@m***.uk"
    assert _m(spark, "mask:email", "noatsign") == "[REDACTED]"
    assert _m(spark, "mask:email", "user@localhost") == "u***@l***"
    for p in ["+905321234567", "+90 532 123 4567", "+90-532-123-4567"]:
        assert _m(spark, "mask:phone", p) == "+9053***4567"
    assert _m(spark, "mask:phone", "5321234567") == "53212***4567"
    assert _m(spark, "mask:phone", "12345") == "[REDACTED]"
    assert _m(spark, "mask:national_id", "12345678901") == "****56789**"
    assert _m(spark, "mask:national_id", "123456") == "[REDACTED]"
    assert _m(spark, "mask:iban", "TR330006100519786457841326") == "TR33******************1326"
    assert _m(spark, "mask:iban", "TR33 0006 1005 1978 6457 8413 26") == "TR33******************1326"
    assert _m(spark, "mask:iban", "TR33") == "[REDACTED]"
    assert _m(spark, "mask:ip", "192.168.1.100") == "192.168.*.*"
    assert _m(spark, "mask:dob", "1990-05-13") == "****-**-13"
    assert _m(spark, "mask:dob", "nodash") == "****-**-**"
    assert _m(spark, "full", "x") == "x"
    assert _m(spark, "no-such", "x") == "[REDACTED]"
    assert _m(spark, "last4", None) is None
    h = _m(spark, "hash", "secret")
    assert len(h) == 16 and h == _m(spark, "hash", "secret")
