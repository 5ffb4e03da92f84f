"""Line-first quality rules, in DataFrame functions alone.

Each line is judged by itself: a line with no sentence end, with too many symbols, one that menu entries'
separators cut into a few words each, or a short one with a phrase of the known boilerplate of four languages goes. A text that loses more than half of its
characters so, or fails the base counts, is rejected. All work stays within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selfsim.llm.common import SPACE, texts_of

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
#: Fixed values of the line rules (a regular expression that Java, RE2 and Python read alike, separators, phrases in lower case).
SENTENCE_END = r"[.!?]([\"')\]]|$|[ \t\r])"
SEPARATORS = "|»›•·"
BOILERPLATE = (
    "lorem ipsum", "javascript", "cookie", "all rights reserved", "terms of use", "terms of service", "privacy policy", "subscribe to", "sign up for", "click here", "read more", "follow us on", "share this", "newsletter",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici", "abonnez-vous", "lire la suite", "partager cet article",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "klicken sie hier", "weiterlesen", "jetzt anmelden", "folgen sie uns",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "haga clic aquí", "suscríbase", "leer más", "síguenos en",
)
#: Words of a line, and more for each separator, in which a menu's entries are; words of a line that a phrase of boilerplate condemns at most.
MENU, SHORT = 3, 40
SYMBOL_SHARE = 10


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: no rule moves it through the generator into the lambdas that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def good_line(line: Column, phrases: Column) -> Column:
    """False for lines that fail a rule; phrases are those of the boilerplate that the whole text has in lower case."""
    symbols = F.length(line) - F.length(without(line, SYMBOLS))
    bars = F.length(line) - F.length(without(line, SEPARATORS))
    words = F.length(line) - F.length(without(line, " ")) + 1
    known = (F.size(phrases) > 0) & (words <= SHORT) & F.exists(phrases, lambda p: F.contains(F.lower(line), p))
    return line.rlike(SENTENCE_END) & (SYMBOL_SHARE * symbols <= F.length(line)) & (MENU * bars < words) & ~known


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, kept_chars, cleaned, kept), a row for each row of docs.

    cleaned is the text of the lines that stay. A null text counts as an empty one:
    no words, base_failed, not kept. Three-word windows are ordered by a 64-bit hash, and neighbours of equal hash are compared by their words. Repeated
    rows and null ids stay; other columns are not read.
    """
    df = texts_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    df = held(df, "words", F.filter(F.split("t", SPACE), lambda w: w != ""))
    df = held(df, "lines", F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(BLANK)) != ""))
    df = held(df, "wins", F.sort_array(F.expr("IF(size(words) > 2, transform(sequence(0, greatest(size(words), 3) - 3), i -> named_struct('h', xxhash64(words[i], words[i + 1], words[i + 2]), 'i', i)), CAST(array() AS ARRAY<STRUCT<h: BIGINT, i: INT>>))")))
    df = held(df, "at", F.expr("sort_array(array_distinct(flatten(filter(zip_with(wins, slice(wins, 2, size(wins)), (a, b) -> IF(a.h = b.h AND words[a.i] = words[b.i] AND words[a.i + 1] = words[b.i + 1] AND words[a.i + 2] = words[b.i + 2], array(a.i, b.i), NULL)), x -> x IS NOT NULL))))"))
    df = held(held(df, "low", F.lower("t")), "phrases", F.filter(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains("low", p))).drop("low")
    df = held(df, "good", F.filter("lines", lambda x: good_line(x, F.col("phrases"))))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(without(F.col("t"), BLANK)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(zip_with(at, slice(at, 2, size(at)), (a, b) -> coalesce(least(3, b - a), 3)), 0L, (s, x) -> s + x)").alias("n_repeat_words"),
        chars("lines").alias("line_chars"),
        chars("good").alias("kept_chars"),
        F.array_join("good", "\n").alias("cleaned"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (2 * F.col("kept_chars") >= F.col("line_chars")))


def _sql() -> str:
    phrases = " OR ".join("contains(lower(x), '{}')".format(p.replace("'", "''")) for p in BOILERPLATE)
    bars = f"length(x) - length(regexp_replace(x, '[{SEPARATORS}]', '', 'g'))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce("text", '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT k, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS s FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM g) WHERE n > 1),
p AS (SELECT k, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS x(o) GROUP BY k),
l AS (SELECT k, x, length(x) - length(replace(x, ' ', '')) + 1 AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
j AS (SELECT k, count(*) - count(DISTINCT x) AS dups, sum(length(x)) AS lc,
  sum(CASE WHEN regexp_matches(x, '[.!?]([\"'')\]]|$|[ \t\r])') AND 10 * (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) <= length(x)
   AND {MENU} * ({bars}) < n AND NOT (n <= {SHORT} AND ({phrases})) THEN length(x) ELSE 0 END) AS kc
 FROM l GROUP BY k),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lc, 0) AS BIGINT) AS line_chars, CAST(coalesce(kc, 0) AS BIGINT) AS kept_chars
 FROM d JOIN w USING (k) LEFT JOIN p USING (k) LEFT JOIN j USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 2 * kept_chars >= line_chars AS kept FROM f
"""


SQL = _sql()
