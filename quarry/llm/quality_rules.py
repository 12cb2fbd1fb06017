"""Quality rules: a threshold table compiled into DataFrame expressions, no user functions.

The 3-word windows of a text are hashed in place and sorted within the row, so
finding repeated ones takes n log n steps and no row leaves its partition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are from at a an or "
    "de la le les des et en un une du que qui dans pour par sur au est "
    "der die das und den von mit ist im zu ein eine nicht auf für dem sich als "
    "el los las se del y una su para con no al"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails where ``value``, a SQL expression over the measures, leaves [least, most]."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None

    def compiled(self) -> Column:
        value = F.expr(self.value)
        tests = [value >= self.least] * (self.least is not None) + [value <= self.most] * (self.most is not None)
        return F.coalesce(tests[0] if len(tests) == 1 else tests[0] & tests[1], F.lit(False))

    def sql(self) -> str:
        """The same test for other engines; a measure without a value fails."""
        tests = [f"{self.value} >= {self.least}"] * (self.least is not None) + [f"{self.value} <= {self.most}"] * (self.most is not None)
        return f"coalesce({' AND '.join(tests)}, false)"


#: Measures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_stop_words, n_capitals.
RULES = (
    Rule("mean word length", "word_chars / greatest(n_words, 1)", 2, 14),
    Rule("symbols to words", "n_symbols / greatest(n_words, 1)", None, 0.25),
    Rule("stop words", "n_stop_words / greatest(n_words, 1)", 0.04, None),
    Rule("capitals to characters", "n_capitals / greatest(word_chars, 1)", None, 0.3),
    Rule("repeated lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each whole text; null text has no words."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", F.filter(F.split("t", SPACES, -1), lambda w: w != "").alias("words"), F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(common.ASCII_SPACE)) != "").alias("lines"))
    n = F.size("words")
    at = lambda i: F.get(F.col("words"), i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        windows.alias("windows"),
    )
    # only texts that repeat a window sort theirs
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    paired = F.when(some, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("paired", paired).drop("windows")
    h = lambda j: F.get(F.col("paired"), j)["h"]
    twice = F.filter("paired", lambda x, j: F.coalesce(h(j - 1) == x["h"], F.lit(False)) | F.coalesce(h(j + 1) == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    # each place covers three words, less what the place before has covered
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end")), lambda acc: acc["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("paired")


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    passed = F.lit(True)
    for rule in rules:
        passed = passed & rule.compiled()
    return measured.withColumns({"base_failed": failed, "kept": ~failed & passed})


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every row of ``documents``.

    Null and empty texts have no words and fail the base; repeated rows are
    judged alike; a null doc_id stays null; other columns are ignored."""
    return judge(measure(common.documents(spark, sf_dir))).select(*OUT)


OP4_SQL = (
    r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM d),
g AS (SELECT r, i, hash(words[i], words[i + 1], words[i + 2]) AS h FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
k AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
p AS (SELECT r, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
        len(list_filter(words, lambda x: lower(x) IN ("""
    + ", ".join(f"'{w}'" for w in STOP_WORDS)
    + r"""))) AS n_stop_words, len(regexp_extract_all(t, '\p{Lu}')) AS n_capitals, coalesce(p.n, 0) AS n_repeat_words
      FROM w LEFT JOIN p ON w.r = p.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND """
    + " AND ".join(r.sql() for r in RULES)
    + """ AS kept
FROM f
"""
)
