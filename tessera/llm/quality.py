"""Quality rules, line first (DataFrame operations only).

Each line is judged by itself: a prose line ends in closing punctuation, is not a row of navigation
cells, is not boilerplate, is not shouted and carries few symbols. Failing lines go, and a document
that loses more than ``MAX_LOST`` of its word characters goes with them. Everything is computed from
one row's arrays: no shuffle and no explode.

Defined results: a null or empty text has no words, fails the base rules and is rejected with null
``clean_text``; repeated rows and tied ids are judged alike, each by itself; an empty table gives an
empty result; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store import table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Of a document's word characters, the share that the line rules may remove.
MAX_LOST = 0.5
#: A line with this share of symbols, or of its letters in upper case, fails.
MAX_LINE_SYMBOLS = 0.05
MAX_LINE_UPPER = 0.5
TERMINAL = r"[.!?…。！？][\"'”’»)\]]*\s*$"
NAVIGATION = r"(\s[|»›·>]\s.*){2,}|^\s*(home|menu|next|previous|back|login|log in|sign in|sign up|search|skip to content)\b.{0,40}$"
BOILERPLATE = r"(?i)\b(all rights reserved|copyright\s+(©|\(c\)|\d{4})|privacy policy|terms of (use|service)|accept (all )?cookies|uses cookies|enable javascript|subscribe to our|click here|read more|lorem ipsum)\b"


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[ \\t-\\r]+", ""))


def _count(text: Column, of: str) -> Column:
    """Characters of ``text`` in the class ``of``; the rest goes in runs, which is quicker than matching each."""
    return F.length(F.regexp_replace(text, f"[^{of}]+", ""))


def line_passes(line: Column) -> Column:
    """Whether one line with a word stands as prose. A lambda's expressions are not shared, so the
    costly operands stand where few lines reach them."""
    symbols, upper = _count(line, SYMBOLS), _count(line, r"\p{Lu}")
    return (
        line.rlike(TERMINAL)
        & ((symbols == 0) | (symbols <= _word_chars(line) * MAX_LINE_SYMBOLS))
        & ((upper <= 4) | (upper <= _count(line, r"\p{L}") * MAX_LINE_UPPER))
        & ~line.rlike(NAVIGATION)
        & ~line.rlike(BOILERPLATE)
    )


def measured(docs: DataFrame) -> DataFrame:
    """Adds words, lines and the base counts to (doc_id, text).

    Repeated windows: each 3-word window's 64-bit hash is packed above its position, the longs are
    sorted, and a window repeats if a sorted neighbour has its whole hash. (Two hashes of one document
    that agree in all packed bits, 49 for 20,000 words, could hide a repeat between them.)"""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
        _word_chars(F.col("text")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
    )
    df = df.withColumn("n_words", F.size("w").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = df.withColumn("g", F.expr("CASE WHEN size(w) < 3 THEN cast(array() as array<bigint>) ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"))
    df = df.withColumn("b", F.expr("length(bin(size(g)))"))
    df = df.withColumn("p", F.expr("CASE WHEN size(array_distinct(g)) = size(g) THEN cast(array() as array<bigint>) ELSE sort_array(transform(g, (h, i) -> shiftleft(h, b) | cast(i as bigint))) END"))
    df = df.withColumn("m", F.expr("shiftleft(1L, b) - 1"))
    df = df.withColumn("q", F.expr("""transform(
        filter(p, (x, k) -> (k > 0 AND g[cast(p[k - 1] & m as int)] = g[cast(x & m as int)]) OR (k < size(p) - 1 AND g[cast(p[k + 1] & m as int)] = g[cast(x & m as int)])),
        x -> cast(x & m as int))"""))
    return df.withColumn("n_repeat_words", F.expr("cast(size(array_distinct(flatten(transform(q, x -> array(x, x + 1, x + 2))))) as bigint)"))


def clean_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_lost: float = MAX_LOST) -> DataFrame:
    """(doc_id, text) -> base counts, n_lines, n_bad_lines, clean_text, base_failed, kept.

    Write the result before filtering on it: the optimiser derives constraints from a filter through
    every step of this projection, which takes it minutes."""
    df = measured(docs).withColumn("good", F.filter("lines", line_passes))
    df = df.withColumn("clean", F.array_join("good", "\n"))
    left = _word_chars(F.col("clean"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (left >= (1 - max_lost) * F.col("word_chars"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("good")).cast("long").alias("n_bad_lines"),
        left.cast("long").alias("clean_chars"), F.when(kept, F.col("clean")).alias("clean_text"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("clean_text")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rw AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS t(o) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT rid, line, regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') AS bare FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lm AS (SELECT rid, line, bare, length(bare) AS n, regexp_replace(bare, '[^\p{L}]', '', 'g') AS letters FROM lw),
ok AS (SELECT rid, line, n,
    regexp_matches(line, '[.!?…。！？]["''”’»)\]]*[\t-\r ]*$')
    AND NOT regexp_matches(line, '([\t-\r ][|»›·>][\t-\r ].*){2,}|^[\t-\r ]*(home|menu|next|previous|back|login|log in|sign in|sign up|search|skip to content)\b.{0,40}$')
    AND NOT regexp_matches(line, '(?i)\b(all rights reserved|copyright[\t-\r ]+(©|\(c\)|\d{4})|privacy policy|terms of (use|service)|accept (all )?cookies|uses cookies|enable javascript|subscribe to our|click here|read more|lorem ipsum)\b')
    AND n - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) <= n * 0.05
    AND length(regexp_replace(letters, '[^\p{Lu}]', '', 'g')) <= greatest(length(letters) * 0.5, 4) AS good
  FROM lm),
la AS (SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_distinct, count(*) FILTER (WHERE NOT good) AS n_bad, coalesce(sum(n) FILTER (WHERE good), 0) AS clean_chars FROM ok GROUP BY rid),
f AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(la.n_lines - la.n_distinct, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(la.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(la.n_bad, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(la.clean_chars, 0) AS BIGINT) AS clean_chars
  FROM w LEFT JOIN la USING (rid) LEFT JOIN rw USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND clean_chars >= 0.5 * word_chars AS kept, n_lines, n_bad_lines, clean_chars FROM b
"""
