"""Quality rules: a threshold table compiled into one projection over the text, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table, text_of

#: Function words of the four languages; enough of them tell prose from lists and noise.
STOP_WORDS = (
    "the of and to in a is that for it on as with be by this are from at or an was "
    "le la les de des et un une en que qui dans pour est sur au par "
    "der die das und den von zu mit ist im ein eine nicht auf "
    "el los las y del por con para es se su"
).split()
#: (name, numerator, denominator, lowest and highest ratio in thousandths); a text without words fails by its length.
RULES = (
    ("n_words", "n_words", None, 50_000, None),
    ("mean_word_chars", "word_chars", "n_words", 2_000, 12_000),
    ("symbols_per_word", "n_symbols", "n_words", None, 100),
    ("stop_words_per_word", "n_stop_words", "n_words", 50, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    ("repeated_words", "n_repeat_words", "n_words", None, 500),
)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a bound variable, not an expression that Catalyst may repeat."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: As patterns: one pass of a character class is faster than a lookup of each character.
SPACES, SOLID, SYMBOL, MARKS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]+", r"[.,;:!?\"'()]+"


def split_words(text: Column) -> Column:
    """The runs of characters that are not space, tab, line feed, vertical tab, form feed or carriage return."""
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in windows of three consecutive words that the text has at least twice, the first one included.

    Windows are told apart by 64-bit hashes. If two are equal, the hashes are sorted with their places, so that equal ones
    are neighbours; the places of those that have an equal neighbour are sorted again, and each adds the words that the
    place before did not cover.
    """
    none = F.lit(0).cast("long")

    def hashes(w):
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.when(F.size(w) > 2, F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<long>"))

    def places(s):
        alike = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        return F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(alike(x, j - 1) | alike(x, j + 1), x["i"])), lambda i: i.isNotNull()))

    def covered(p):
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, none, lambda x, y: x + y)

    def counted(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(pairs, places), covered)).otherwise(none)

    return let(hashes(words), counted)


def measures(text: Column) -> Column:
    """A struct of counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words.

    ``n_lines`` are the lines that have a word; ``n_dup_lines`` those of them that equal an earlier line.
    """

    def counts(w):
        lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(SOLID)))
        low = F.regexp_replace(F.lower(F.array_join(w, " ")), MARKS, "")
        stop = F.filter(F.split(low, " ", -1), lambda x: x.isin(*STOP_WORDS))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            F.size(stop).cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def flat(m):
        names = {"n_lines": m["lines"]["all"], "n_dup_lines": m["lines"]["dup"]}
        order = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")
        return F.struct(*[(names[n] if n in names else m[n]).alias(n) for n in order])

    return let(let(split_words(text), counts), flat)


def verdicts(m: Column, rules=RULES) -> Column:
    """The names of the rules that the counts break. All are compared as integers."""
    broken = []
    for name, top, bottom, low, high in rules:
        value, unit = m[top] * 1000, m[bottom] if bottom else F.lit(1)
        bad = F.lit(False)
        if low is not None:
            bad = bad | (value < unit * low)
        if high is not None:
            bad = bad | (value > unit * high)
        broken.append(F.when(bad, F.lit(name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def base_failed(m: Column) -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def passes(text: Column, rules=RULES) -> Column:
    """Whether a text fails neither the base nor a rule: one expression, so that a filter on it counts once."""
    return let(measures(text), lambda m: ~base_failed(m) & (F.size(verdicts(m, rules)) == 0))


def apply_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``quality_counts``, ``base_failed`` and ``broken_rules`` (empty: the document is kept).

    One narrow projection: no shuffle, no state. Null text counts as empty and breaks the rule on length. Columns of
    these three names are replaced; all others stay.
    """
    m = F.col("quality_counts")
    return docs.withColumn("quality_counts", measures(text_of(text))).withColumns({"base_failed": base_failed(m), "broken_rules": verdicts(m, rules)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality_counts.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that break no rule."""
    return docs.filter(passes(text_of()))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), pos AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2),
grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
hit AS (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(w, lambda x: regexp_replace(lower(x), '[.,;:!?"''()]', '', 'g') IN (STOP_WORDS))) AS n_stop,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM words LEFT JOIN rep USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words
    AND 10 * n_symbols <= n_words AND 20 * n_stop >= n_words AND 2 * n_dup_lines <= n_lines AS kept
FROM m
""".replace("STOP_WORDS", ", ".join(f"'{w}'" for w in STOP_WORDS))
