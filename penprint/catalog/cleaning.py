"""Queries for the cleaning operators, over the whole texts."""

import re

from pyspark.sql import functions as F

from penprint.catalog.base import query, table, texts
from penprint.functions import lexicon as lx
from penprint.functions import text as t
from penprint.functions.arrays import (
    argmax, f1, month_number, month_period, name_category, parse_time, row_max, row_mean, row_mode, split_labels,
)
from penprint.operators import curate, stats
from penprint.session import stored


def _cleaned(spark, sf, step, name="documents", key=("doc_id",)):
    return texts(spark, sf, name).select(*key, step(F.col("text")).alias("text"))


def _each(sql: str, name="documents", key="doc_id") -> str:
    return f"SELECT {key}, {sql} AS text FROM {name}"


@query(r"SELECT page_id, regexp_replace('see ' || url || ' or ' || url || chr(10) || 'end', 'https?://[^\s\x0b\x1c-\x1f\x85\p{Z}]+', '', 'g') AS text FROM pages")
def remove_urls(spark, sf):
    """Texts that quote the address of each page twice."""
    said = F.concat(F.lit("see "), "url", F.lit(" or "), "url", F.lit("\nend"))
    return table(spark, sf, "pages").select("page_id", t.remove_urls(said).alias("text"))


# A handle that ends in "user" stays: its sign is set aside while the others are replaced.
@query(_each(r"""replace(regexp_replace(regexp_replace(regexp_replace(text, '^(@[A-Za-z0-9_]+\s?)+', ''), '\B@([A-Za-z0-9_]*user)\b', chr(1) || '\1', 'g'),
    '\B@([A-Za-z0-9_]+)\b', '[USUARIO]', 'g'), chr(1), '@')"""))
def remove_mentions(spark, sf):
    return _cleaned(spark, sf, t.remove_mentions)


@query("""SELECT p_partkey, 'a ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
                 || p_size || ', ' || p_size || '.' AS text FROM part""")
def expand_hashtags(spark, sf):
    """Hashtags in camel case made of the words of a part's name and its size, and one of digits alone."""
    tag = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.col("p_size").cast("string"))
    said = F.concat(F.lit("a #"), tag, F.lit(", #"), F.col("p_size").cast("string"), F.lit("."))
    return table(spark, sf, "part").select("p_partkey", t.expand_hashtags(said).alias("text"))


@query(r"SELECT p_partkey, regexp_replace(p_brand || ' #' || p_type || ' ' || p_name, '#([\p{L}0-9_]+)', '#[HASHTAG]_\1', 'g') AS text FROM part")
def remove_hashtags(spark, sf):
    """A brand, in which a number sign stands, and a type with one put before it."""
    said = F.concat("p_brand", F.lit(" #"), "p_type", F.lit(" "), "p_name")
    return table(spark, sf, "part").select("p_partkey", t.remove_hashtags(said).alias("text"))


@query(_each(r"regexp_replace(text, '\b(\d+[.,]?\d*|\d{2}[AP]M)%', '[PORCENTAJE]', 'g')"))
def remove_percentages(spark, sf):
    return _cleaned(spark, sf, t.remove_percentages)


@query(_each(r"regexp_replace(text, '\b(\d+[.,]?\d*|\d{2}[AP]M)\b', '[NUMERO]', 'g')"))
def remove_digits(spark, sf):
    return _cleaned(spark, sf, t.remove_digits)


_SPACES = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x0b]+', ' ', 'g'),
    '[.\s]{2,}', '. ', 'g'), ' [-—] ', '. ', 'g'), ' [-—] ', '. ', 'g'), '\s+([?!])+', '\1 ', 'g')"""


@query(_each(_SPACES))
def remove_whitespaces(spark, sf):
    return _cleaned(spark, sf, t.remove_whitespaces)


_EMOJIS = ("\U0001F600", "\U0001F680", "☀️", "\U0001F44D\U0001F3FD", "\U0001F469‍\U0001F680", "")


@query(_each("text || ' ' || ' end'"))
def remove_emojis(spark, sf):
    """An emoji, plain or joined of several signs, is put behind every text; the texts hold none themselves."""
    emoji = F.get(F.array(*[F.lit(e) for e in _EMOJIS]), (F.col("doc_id") % len(_EMOJIS)).cast("int"))
    return texts(spark, sf).select("doc_id", t.remove_emojis(F.concat("text", F.lit(" "), emoji, F.lit(" end"))).alias("text"))


@query("""SELECT page_id, translate(html || ' «a» “b” ‘c’ ' || chr(39), '"“”''«»‘’', '') AS text FROM pages""")
def remove_quotations(spark, sf):
    """The source of each page, which quotes its attributes."""
    said = F.concat("html", F.lit(" «a» “b” ‘c’ '"))
    return texts(spark, sf, "pages").select("page_id", t.remove_quotations(said).alias("text"))


@query()
def remove_elongations(spark, sf):
    return _cleaned(spark, sf, t.remove_elongations)


@query("""SELECT p_partkey, replace(replace(replace(replace(replace(p_name, 'aa', 'á'), 'ee', 'é'), 'ii', 'í'), 'oo', 'ó'), 'uu', 'ú')
                 || ' soz jajaja!' || CASE WHEN p_partkey % 3 > 0 THEN '?' ELSE '' END || ' bé' AS text FROM part""")
def elongated_names(spark, sf):
    """Names of parts with their double vowels, then a long letter, a long laugh, long marks and a vowel drawn out."""
    n = F.col("p_partkey").cast("int")
    said = F.concat(
        "p_name", F.lit(" so"), F.repeat(F.lit("z"), 3 + n % 4), F.lit(" jaja"), F.repeat(F.lit("ja"), n % 3), F.repeat(F.lit("!"), 2 + n % 2),
        F.repeat(F.lit("?"), n % 3), F.lit(" b"), F.repeat(F.lit("e"), F.lit(2)))
    return table(spark, sf, "part").select("p_partkey", t.remove_elongations(said).alias("text"))


@query("""SELECT p_partkey, 'que ' || p_name || ' porque, también Televisión Española el ' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') || ' de marzo. Estados Unidos x1' AS text FROM part""")
def chat_terms(spark, sf):
    """Chat terms, acronyms and a short date around the names of parts."""
    day = F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0")
    said = F.concat(F.lit("q "), "p_name", F.lit(" xq, TB tve el "), day, F.lit(" de mar. EEUU x1"))
    return table(spark, sf, "part").select("p_partkey", t.expand_acronyms(t.expand_chat_terms(said)).alias("text"))


@query(_each("lower(text)"))
def to_lower(spark, sf):
    return _cleaned(spark, sf, t.to_lower)


@query(_each(r"regexp_replace(text, '[.|+()]+', '', 'g')"))
def remove_punctuation(spark, sf):
    return _cleaned(spark, sf, t.remove_punctuation)


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w || 'os y ' || w || 'as'), ' ') || ' a@sb' AS text FROM part""")
def expand_gender(spark, sf):
    """Every word of a part's name written for both genders, and one that only looks so."""
    said = F.concat(F.replace("p_name", F.lit(" "), F.lit("@s ")), F.lit("@s a@sb"))
    return table(spark, sf, "part").select("p_partkey", t.expand_gender(said).alias("text"))


@query()
def expand_terms(spark, sf):
    return _cleaned(spark, sf, lambda text: t.expand_acronyms(t.expand_chat_terms(text)))


@query(_each("replace(text, 'the', 'THE')"))
def replace_substring(spark, sf):
    return _cleaned(spark, sf, lambda c: t.replace_substring(c, "the", "THE"))


@query(_each("trim(text, ' ' || chr(13) || chr(10) || chr(9) || ',.?')"))
def strip(spark, sf):
    return _cleaned(spark, sf, t.strip)


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '… ' ELSE '' END || rtrim(text, '…') AS text FROM conversations")
def trim_ending_ellipsis(spark, sf):
    """Texts with none, one or two signs of omission at the end, and some with one at the start."""
    before = F.when(F.col("turn") % 3 == 0, "… ").otherwise("")
    said = F.concat(before, "text", F.repeat(F.lit("…"), (F.col("turn") % 3).cast("int")))
    return texts(spark, sf, "conversations").select("conv_id", "turn", t.trim_ending_ellipsis(said).alias("text"))


def written(spark, sf):
    """Names of parts in a text that holds something for every step of the standard cleaning."""
    n = F.col("p_partkey").cast("int")
    said = F.concat(
        F.lit("@juan @ana Oye, q "), "p_name", F.lit(" xq EEUU el "), F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0"), F.lit(" de mar: https://a.b/"),
        F.col("p_partkey").cast("string"), F.lit("?x=1 #"), F.initcap(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit(" visto por @pedro,  jajaja"), F.repeat(F.lit("ja"), n % 3),
        F.lit(" goo"), F.repeat(F.lit("o"), n % 4), F.lit("l "), F.col("p_size").cast("string"), F.lit(" o 3,5 km - «así» \U0001F600 (a|b) . . fin !"), F.repeat(F.lit("!"), n % 3), F.lit(" …"))
    return texts(spark, sf, "part").select("p_partkey", said.alias("text"))


CLEAN_SQL = """'Oye, que ' || p_name || ' porque Estados Unidos el [NUMERO] de marzo: #[HASHTAG]_' || upper(p_name[1]) || replace(p_name[2:], ' ', '') || ' visto por [USUARIO], jajaja '
    || CASE WHEN p_partkey % 4 = 0 THEN 'gól' ELSE 'gol' END || ' [NUMERO] o [NUMERO] km así ab fin! '"""


@query(f"SELECT p_partkey, {CLEAN_SQL} AS text_clean, lower({CLEAN_SQL}) AS text_clean_lowercase FROM part")
def clean_written_text(spark, sf):
    return t.add_clean_columns(written(spark, sf), "text").select("p_partkey", "text_clean", "text_clean_lowercase")


def _terms():
    """Every chat term, acronym and short date as it is written, and as it is read after all terms."""
    out = []
    for key in (*lx.CHAT_TERMS, *lx.ACRONYMS):
        written = key.replace("[\\w\\+]?", "I").replace("\\", "")
        read = f"a {written} z"
        for pattern, value in (*lx.CHAT_TERMS.items(), *lx.ACRONYMS.items()):
            pattern = rf"\b{pattern[:-2]}[\x08+]" if pattern.endswith("\\+") else rf"\b{pattern}\b"
            read = re.sub(pattern, value.replace("\\", "\\\\"), read, flags=re.I)
        out.append((f"a {written} z", read))
    return out + [(f"a 0{1 + i % 9}{between}{month[:3]} z", f"a 0{1 + i % 9} de {month} z") for i, month in enumerate(lx.MONTHS) for between in ("", " de ", "de ")]


_TERMS = _terms()
_QUOTED = ", ".join("'" + read.replace("'", "''") + "'" for _, read in _TERMS)


@query(f"SELECT p_partkey, p_name || ' ' || [{_QUOTED}][p_partkey % {len(_TERMS)} + 1] AS text FROM part")
def every_term(spark, sf):
    """The terms of both lists and the short dates, one behind each part's name."""
    written = F.get(F.array(*[F.lit(w) for w, _ in _TERMS]), (F.col("p_partkey") % len(_TERMS)).cast("int"))
    said = F.concat("p_name", F.lit(" "), written)
    return table(spark, sf, "part").select("p_partkey", t.expand_acronyms(t.expand_chat_terms(said)).alias("text"))


@query()
def clean_text(spark, sf):
    return t.add_clean_columns(texts(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "text_clean", "text_clean_lowercase")


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda w: w <> '')) AS words FROM documents")
def word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.word_count(F.col("text")).cast("long").alias("words"))


@query(r"""WITH kept AS (SELECT * FROM documents WHERE NOT regexp_matches(text, '((a través de|v[íi]a)) @+[\[A-Za-zÑñ\d_]+\n?\z|\||#endirecto')),
                big AS (SELECT source FROM kept GROUP BY 1 HAVING count(*) >= 5)
           SELECT source, lang, count(*) AS count FROM kept WHERE source IN (SELECT source FROM big) GROUP BY 1, 2""")
def writers_by_language(spark, sf):
    documents = curate.drop_syndicated(texts(spark, sf, "documents"), "text")
    cleaned = t.clean(documents, "text", into="text_clean").select("source", "lang", (F.col("text_clean") != "").alias("says"))
    # Read twice, for counting and for keeping: stored, so that no text is cleaned twice.
    kept = curate.min_documents(stored(cleaned).where("says"), "source", 5)
    return stats.docs_per_author_language(kept, "source", "lang")


# --- Date, array and score helpers ---------------------------------------------------
@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed, CAST(NULL AS VARCHAR) AS unreadable FROM events""")
def parse_times(spark, sf):
    written = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("w"))
    shown = [F.date_format(parse_time(c), "yyyy-MM-dd HH:mm:ss") for c in (F.col("w"), F.concat(F.lit("x"), F.col("w")))]
    return written.select("event_id", shown[0].alias("parsed"), shown[1].alias("unreadable"))


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS number, strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def month_parts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", month_number(F.col("o_orderdate")).alias("number"), month_period(F.col("o_orderdate")).alias("period"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity + l_discount * 100 + l_tax * 100) / 3, 6) AS mean,
                 greatest(l_quantity, l_discount * 100, l_tax * 100) AS largest,
                 CAST(CASE WHEN l_quantity >= l_discount * 100 AND l_quantity >= l_tax * 100 THEN 0 WHEN l_discount * 100 >= l_tax * 100 THEN 1 ELSE 2 END AS INTEGER) AS place
          FROM lineitem""")
def row_statistics(spark, sf):
    values = F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(row_mean(values), 6).alias("mean"), row_max(values).alias("largest"), argmax(values).alias("place"))


@query("""SELECT o_orderkey, CASE WHEN b = c AND b <> a THEN b WHEN a = b OR a = c THEN a ELSE least(a, b, c) END AS winner FROM
          (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS a, CAST(1 + o_custkey % 5 AS VARCHAR) AS b, CAST(month(o_orderdate) // 3 AS VARCHAR) AS c FROM orders)""")
def row_modes(spark, sf):
    votes = F.array(F.substring("o_orderpriority", 1, 1), (1 + F.col("o_custkey") % 5).cast("string"), F.floor(F.month("o_orderdate") / 3).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", row_mode(votes).alias("winner"))


@query("""SELECT p_partkey, trim(unnest(string_split(p_name || ' ; ' || p_type, ';'))) AS label FROM part""")
def split_label_lists(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(split_labels(F.concat_ws(" ; ", "p_name", "p_type"))).alias("label"))


@query("""SELECT c_custkey, string_split(string_split(c_mktsegment || '_x-' || c_name, '-')[1], '_')[1] AS category FROM customer""")
def name_categories(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", name_category(F.concat_ws("-", F.concat(F.col("c_mktsegment"), F.lit("_x")), "c_name")).alias("category"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_discount * l_tax > 0 THEN 2 * l_discount * l_tax / (l_discount + l_tax) ELSE 0 END, 6) AS f1,
                 round(ln(l_quantity), 6) AS logarithm, round(sqrt(l_quantity), 6) AS root FROM lineitem""")
def score_math(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(f1(F.col("l_discount"), F.col("l_tax")), 6).alias("f1"),
        F.round(F.ln("l_quantity"), 6).alias("logarithm"), F.round(F.sqrt("l_quantity"), 6).alias("root"))
