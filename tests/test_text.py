"""Cleaning operators on literal strings; expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from penprint.functions import text as t

CASES = [
    (t.remove_urls, "ver https://t.co/aB1. y http://x.es fin", "ver  y  fin"),
    (t.remove_urls, "fin https://t.co/x", "fin "),
    (t.remove_mentions, "@a @b hola @pepe y a@b.c con @xuser fin", "hola [USUARIO] y a@b.c con @xuser fin"),
    (t.remove_mentions, "á@ana ñ @ana, ok", "á@ana ñ [USUARIO], ok"),
    (t.remove_mentions, "ay @USER @USER x", "ay [USUARIO] [USUARIO] x"),
    (lambda c: t.remove_mentions(c, collapse=True), "ay @ana @eva x", "ay [USUARIO] x"),
    (t.expand_hashtags, "di #CamelCase y #ABCWord", "di Camel Case y ABC Word"),
    (t.expand_hashtags, "#with2digits #año2020Madrid # solo", "with2 digits año2020 Madrid # solo"),
    (t.remove_hashtags, "#uno y #dós", "#[HASHTAG]_uno y #[HASHTAG]_dós"),
    (t.remove_percentages, "50% y 3,5% de 10AM%", "[PORCENTAJE] y [PORCENTAJE] de [PORCENTAJE]"),
    (t.remove_digits, "12 12,5 10AM Ñandú2 3º", "[NUMERO] [NUMERO] [NUMERO] Ñandú2 3º"),
    (t.remove_whitespaces, "a\t\nb", "a b"),
    (t.remove_whitespaces, "a. . b - c — d", "a. b. c. d"),
    (t.remove_whitespaces, "hola ?! y", "hola!  y"),
    (t.remove_emojis, "a👨‍👩‍👧b1️⃣c🇪🇸d☎️e👍🏽f é 1", "abcdef é 1"),
    (t.remove_quotations, "«a» “b” 'c' \"d\"", "a b c d"),
    (t.remove_elongations, "jajjaja muajaja", "jajaja jajaja"),
    (t.remove_elongations, "no!!! ¿¿qué??", "no! ¿qué?"),
    (t.remove_elongations, "hoolaaa leer LEER Eeh xEe", "hóla lér LÉR Éh xÉ"),
    (lambda c: t.remove_elongations(c, accent_vowels=False), "leer holaaa", "leer hola"),
    (t.to_lower, "ÁBC", "ábc"),
    (t.remove_punctuation, "a.b|c+(d) [e]", "abcd [e]"),
    (t.expand_gender, "amig@s AMIG@S ana@s.com x@sa", "amigos y amigas AMIGos y AMIGas anaos y anaas.com x@sa"),
    (t.expand_chat_terms, "q xq? ad+ d dl tb D", "que porque? además de del también de"),
    (t.expand_chat_terms, "el 03 ene y 21 de feb, 09may", "el 03 ene y 21 de febrero, 09 de mayo"),
    (t.expand_chat_terms, "sin nada, año", "sin nada, año"),
    (t.expand_acronyms, "la UE y el pp; G. Mixto", "la Unión Europea y el Partido Popular; Grupo Mixto"),
    (lambda c: t.replace_substring(c, "a.b", "-"), "a.b axb", "- axb"),
    (t.strip, " .?¿hola, ?", "¿hola"),
    (t.strip, " ,.? ", ""),
    (t.trim_ending_ellipsis, "fin……", "fin"),
]


@pytest.mark.parametrize("step, before, after", CASES)
def test_cleaner(spark, step, before, after):
    row = spark.createDataFrame([(before,)], "text string").select(step(F.col("text")).alias("out")).first()
    assert row["out"] == after


def test_terms_see_earlier_replacements(spark):
    terms = {"a": "b c", "b": "x", "c d": "y", "x": "z"}
    row = spark.createDataFrame([("a d A",)], "text string").select(t.expand_terms(F.col("text"), terms).alias("out")).first()
    # a -> "b c", b -> "x", then the pattern "c d" -> "y", and x -> "z".
    assert row["out"] == "z y z c"


def test_word_count(spark):
    rows = spark.createDataFrame([("",), ("  a  b ",), ("x\ny\tz",)], "text string").select(t.word_count(F.col("text"))).collect()
    assert [r[0] for r in rows] == [0, 2, 3]


def test_default_pipeline_and_language(spark):
    df = spark.createDataFrame([("@eva ¡q guay!!! https://t.co/1 (#Sol) 12",)], "text string")
    spanish = t.add_clean_columns(df, "text").first()
    assert spanish["text_clean"] == "¡que guay! #[HASHTAG]_Sol [NUMERO]"
    assert spanish["text_clean_lowercase"] == spanish["text_clean"].lower()
    assert t.clean(df, "text", language="en").first()["text"].startswith("¡q guay")
    assert t.clean(df, "text", [t.to_lower]).first()["text"] == df.first()["text"].lower()


def test_long_text_does_not_overflow(spark):
    text = "@a " * 20000 + "#AbC " * 20000 + "ja" * 20000
    row = t.clean(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert row["text"].startswith("#[HASHTAG]_AbC")
    out = spark.createDataFrame([(text,)], "text string").select(t.expand_hashtags(F.col("text")).alias("o")).first()["o"]
    assert out.count("Ab C") == 20000
