"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each rule is evaluated once for each document. The ledger keeps the measurements and one bit for each failed rule;
versioned policies are masks over those bits, so a new policy or an ablation never reads the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS_CHARS, WS_CLASS, narrowed

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Name and failing condition over the ledger's measurements; a rule's bit is its place here. Append only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("capitals", "100 * n_upper > 60 * word_chars"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    ("marks", "2 * n_marks > n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": BITS["few_words"] | BITS["repeat_words"],
    "v1": BITS["few_words"] | BITS["repeat_words"] | BITS["symbols"] | BITS["capitals"] | BITS["marks"],
    "v2": sum(BITS.values()),
}


def _count_of(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered(windows: Column) -> Column:
    """Words in three-word windows, given sorted starts of those windows."""
    n = F.size(windows)
    steps = F.zip_with(F.slice(windows, 1, F.greatest(n - 1, F.lit(0))), F.slice(windows, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), b - a))
    return F.when(n > 0, F.aggregate(steps, F.lit(3), lambda acc, x: acc + x)).otherwise(0)


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = narrowed(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = text.select(
        "doc_id",
        F.length(F.translate("text", WS_CHARS, "")).alias("word_chars"),
        _count_of("text", SYMBOLS).alias("n_symbols"),
        _count_of("text", UPPER).alias("n_upper"),
        _count_of("text", "!?").alias("n_marks"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.transform(F.filter(F.split("text", WS_CLASS + "+"), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("words"),
    )
    m = F.greatest(F.size("words") - 2, F.lit(0))
    part = lambda i: F.slice("words", i, m)
    grams = F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3), lambda ab, c: F.xxhash64(ab, c))
    shaped = split.select(
        *(c for c in split.columns if c not in ("words", "lines")),
        F.size("words").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("grams"),
    )
    k = F.greatest(F.size("grams") - 1, F.lit(0))
    equal = F.filter(
        F.zip_with(F.slice("grams", 1, k), F.slice("grams", 2, k), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: p["a"]["h"] == p["b"]["h"],
    )
    repeated = shaped.select(
        *(c for c in shaped.columns if c != "grams"),
        F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda p: F.array(p["a"]["i"], p["b"]["i"]))))).alias("windows"),
    )
    return repeated.select(
        "doc_id",
        *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        _covered(F.col("windows")).cast("long").alias("n_repeat_words"),
        *(F.col(c).cast("long").alias(c) for c in ("n_lines", "n_upper", "n_marks")),
    )


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of each row and ``failed``, the bits of the rules that it fails.

    Null counts as the empty text, which has no words and fails few_words. Repeated rows each get a row; only id and
    text are read; an empty table gives an empty ledger.
    """
    bits = [F.when(F.expr(test), F.lit(BITS[name])).otherwise(0).cast("long") for name, test in RULES]
    rows = measurements(docs, id_col, text_col)
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.withColumn("failed", total)


def passes(policy: str | int, bits: str = "failed") -> Column:
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) == 0


def ablation(ledger: DataFrame, policy: str | int) -> DataFrame:
    """For each rule of a policy: rows failing it, rows failing nothing else, and rows kept if it were dropped.

    The ledger shrinks to one row for each bit pattern; all else is bit arithmetic on those few rows.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BITS.items() if bit & mask)))
    spread = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return spread.groupBy("rule").agg(count(hit).alias("n_failed"), count(only).alias("n_only"), count(without).alias("n_kept_without"), F.bit_or("bits").alias("seen_bits"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    ledger = rule_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes("v2").alias("kept"), passes("v1").alias("kept_v1"), "n_lines", "n_upper", "n_marks", "failed",
    )


def rule_ablation(spark, sf_dir: str) -> DataFrame:
    return ablation(rule_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "v2")


_LEDGER_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + d) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(d) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
        CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_marks
      FROM t JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
        + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (100 * n_upper > 60 * word_chars)::INT
        + 32 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::INT + 64 * (2 * n_marks > n_words)::INT AS BIGINT) AS failed FROM m)
"""
SQL = _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
       failed = 0 AS kept, failed & 87 = 0 AS kept_v1, n_lines, n_upper, n_marks, failed FROM b
"""
ABLATION_SQL = _LEDGER_SQL + """
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_only,
       count(*) FILTER (failed & ~bit = 0) AS n_kept_without, bit_or(failed) AS seen_bits
FROM b, (VALUES ('few_words', 1::BIGINT), ('repeat_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('capitals', 16),
                ('word_length', 32), ('marks', 64)) v(rule, bit) GROUP BY rule
"""
