"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines within one edit of each other share a *variant*: the line with one character deleted and the place marked.
A line emits a variant for each character it may lose and for each gap where the other line may have one more; the
mark's place is part of the hashed key, so lines with an equal key are one edit apart, and the earliest line of a key is
found by a minimum: no group's pairs are ever made.

Emitting all variants of all lines would multiply the corpus by its line length. Two exact filters come first, both
from the fact that one edit leaves the rest of a line as it is: a line emits variants of one half only if another line
shares the other half, and of one chunk of that half only if another line shares all around the chunk. Variants
outside them could not meet an equal one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS_CHARS, keys_join, narrowed, rejoin, table

#: The edit bound is 1 for lines of at least this many characters, 0 (equal lines only) for shorter ones: among short
#: lines (numbers, names, list items) one edit is often another meaning.
NEAR_CHARS = 24
#: Characters in a chunk of a half line.
CHUNK = 64


def _lines(base: DataFrame) -> DataFrame:
    """Each line with a word, without the white space around it."""
    all_lines = base.select("rid", "doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return all_lines.select("rid", "doc_id", "no", F.btrim("line", F.lit(WS_CHARS)).alias("line")).where("line <> ''")


def _key(*parts) -> Column:
    """A hash of the parts. Each part is hashed with the part before as its seed, so a salt must come first."""
    return F.xxhash64(*parts)


def _halves(line: Column, n: Column) -> Column:
    """Keys of a line's halves: head and tail as the longer line of a pair (or of equal length), then head and tail as
    the shorter one of a pair with a line of n + 1."""
    m, k = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    return F.array(
        _key(n, F.lit("head"), F.substring(line, F.lit(1), m)),
        _key(n, F.lit("tail"), F.substring(line, m + 1, n)),
        _key(n + 1, F.lit("head"), F.substring(line, F.lit(1), k)),
        _key(n + 1, F.lit("tail"), F.substring(line, k, n)),
    )


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key more than one row has."""
    return rejoin(rows, rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), key, "left_semi")


def _order(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}doc_id").isNull().alias("unknown"), F.col(f"{prefix}doc_id").alias("doc_id"), F.col(f"{prefix}rid").alias("rid"), F.col(f"{prefix}no").alias("no"))


def _near(forms: DataFrame, base: DataFrame) -> DataFrame:
    """(h, h2) of the forms that are one edit from a form that comes earlier."""
    halves = forms.where("halves is not null").select("h", "h2", "first", F.posexplode("halves").alias("half", "key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    halves = table(keys_join(halves, table(shared, "line-half-keys"), "key", "left_semi"), "line-halves")
    homes = table(halves.select(F.col("first.rid").alias("rid"), F.col("first.no").alias("no")).distinct(), "line-homes")
    rids = table(homes.select("rid").distinct(), "line-home-rows")
    texts = keys_join(base.select("rid", "doc_id", "text"), rids, "rid", "left_semi")
    lines = table(_lines(texts).join(homes, ["rid", "no"]).select("rid", "no", "line"), "line-texts")
    place = lambda c: (F.col(f"{c}.rid") == F.col("rid")) & (F.col(f"{c}.no") == F.col("no"))
    known = halves.join(lines, place("first"))
    n = F.length("line")
    m, k = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    # The half that may hold the edit: the one that the shared key does not cover.
    half = [F.substring("line", m + 1, n), F.substring("line", F.lit(1), m), F.substring("line", k + 1, n), F.substring("line", F.lit(1), k - 1)]
    part = F.when(F.col("half") == 0, half[0]).when(F.col("half") == 1, half[1]).when(F.col("half") == 2, half[2]).otherwise(half[3])
    short = F.when(F.col("half") >= 2, 1).otherwise(0)
    parts = known.select("h", "h2", "first", "key", short.alias("short"), part.alias("part")).withColumn("size", F.length("part") + F.col("short"))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / CHUNK).cast("int"))).alias("j")
    cut = parts.where("size > 0").select("h", "h2", "first", "key", "short", "part", "size", chunk)
    start, end = F.col("j") * CHUNK, F.least((F.col("j") + 1) * CHUNK, "size") - F.col("short")
    around = _key("key", "j", F.substring("part", F.lit(1), start), F.substring("part", end + 1, F.col("size")))
    chunks = table(_repeated(cut.select("h", "h2", "first", "short", around.alias("around"), F.substring("part", start + 1, end - start).alias("chunk")), "around"), "line-chunks")
    # Deleting character i of the longer line's chunk, or opening a gap before character i of the shorter one's.
    at = F.explode(F.sequence(F.lit(0), F.length("chunk") - 1 + F.col("short"))).alias("i")
    spread = chunks.where("length(chunk) + short > 0").select("h", "h2", "first", "short", "around", "chunk", at)
    variant = _key("around", "i", F.substring("chunk", F.lit(1), F.col("i")), F.substring("chunk", F.col("i") + 2 - F.col("short"), F.length("chunk")))
    variants = spread.select("h", "h2", "first", variant.alias("variant"))
    earliest = variants.groupBy("variant").agg(F.min("first").alias("earliest"), F.count("*").alias("_n")).where("_n > 1").select("variant", "earliest")
    later = rejoin(variants, earliest, "variant", row_bytes=48).where("earliest < first").groupBy("h", "h2").agg(F.min("first").alias("first"), F.min("earliest").alias("earliest"))
    pair = later.join(lines.withColumnRenamed("line", "line_a"), place("first")).drop("rid", "no").join(lines.withColumnRenamed("line", "line_b"), place("earliest"))
    return pair.where(F.levenshtein("line_a", "line_b", 1) == 1).select("h", "h2", F.lit(True).alias("near"))


def line_dedup(docs: DataFrame, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, kept_text for each row, repeated rows too.

    Lines are the \\n-split parts of whole texts, compared without the white space around them; lines without a word
    always stay. A line goes if an equal line comes earlier (n_exact), or one that differs by one character edit
    (n_near; both of near_chars or more, 1 for all lines). Earlier: by id, null ids last, then by row and line number. What counts is the
    first place of the earlier line, whether that line stays or not. Null counts as the empty text; only the two columns
    are read; an empty table gives an empty result.
    """
    base = table(
        narrowed(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "line-rows"
    )
    lines = _lines(base).select("rid", "doc_id", "no", _key("line").alias("h"), _key(F.lit(1), "line").alias("h2"), "line")
    measured = lines.withColumn("n", F.length("line"))
    halves = F.when(F.col("n") >= near_chars, _halves(F.col("line"), F.col("n")))
    # Equal lines meet on the map side first; only hashes are shuffled, never the lines.
    forms = measured.select("rid", "doc_id", "no", "h", "h2", halves.alias("halves")).groupBy("h", "h2")
    forms = table(forms.agg(F.min(_order()).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("copies")), "line-forms")
    near = table(_near(forms, base), "line-near")
    hit = keys_join(forms.select("h", "h2", "first", "copies"), near, ["h", "h2"], "left").where("near or copies > 1")
    hit = table(hit.select("h", "h2", F.coalesce("near", F.lit(False)).alias("near"), F.col("first.rid").alias("first_rid"), F.col("first.no").alias("first_no")), "line-hits")
    gone = lines.select("rid", "no", "h", "h2").join(hit, ["h", "h2"])
    exact = (F.col("rid") != F.col("first_rid")) | (F.col("no") != F.col("first_no"))
    gone = gone.where(exact | F.col("near")).groupBy("rid").agg(F.collect_list("no").alias("gone"), F.count_if(exact).alias("n_exact"), F.count_if(~exact).alias("n_near"))
    gone = table(gone, "line-gone")
    split = base.join(gone.hint("merge"), "rid", "left").select("doc_id", "text", F.split("text", "\n").alias("lines"), "gone", "n_exact", "n_near")
    stay = split.select("doc_id", "text", "lines", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone").alias("stay"), "gone", "n_exact", "n_near")
    kept = F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    return stay.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i - 1 AS no, lines[i] AS raw, trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM t)),
f AS (SELECT line, min((doc_id, no)) AS first, length(line) AS n FROM l WHERE line <> '' GROUP BY line),
c AS (SELECT a.line AS line, b.line AS other FROM f a JOIN f b ON a.n = b.n AND left(a.line, a.n // 2) = left(b.line, a.n // 2) WHERE b.first < a.first AND a.n >= {NEAR_CHARS}
      UNION SELECT a.line, b.line FROM f a JOIN f b ON a.n = b.n AND substr(a.line, a.n // 2 + 1) = substr(b.line, a.n // 2 + 1) WHERE b.first < a.first AND a.n >= {NEAR_CHARS}
      UNION SELECT a.line, b.line FROM f a JOIN f b ON a.n = b.n + 1 AND left(a.line, a.n // 2) = left(b.line, a.n // 2) WHERE b.first < a.first AND b.n >= {NEAR_CHARS}
      UNION SELECT a.line, b.line FROM f a JOIN f b ON a.n = b.n + 1 AND substr(a.line, a.n // 2 + 1) = substr(b.line, a.n // 2) WHERE b.first < a.first AND b.n >= {NEAR_CHARS}
      UNION SELECT b.line, a.line FROM f a JOIN f b ON a.n = b.n + 1 AND left(a.line, a.n // 2) = left(b.line, a.n // 2) WHERE a.first < b.first AND b.n >= {NEAR_CHARS}
      UNION SELECT b.line, a.line FROM f a JOIN f b ON a.n = b.n + 1 AND substr(a.line, a.n // 2 + 1) = substr(b.line, a.n // 2) WHERE a.first < b.first AND b.n >= {NEAR_CHARS}),
p AS (SELECT line, CASE WHEN length(line) >= length(other) THEN line ELSE other END AS x, CASE WHEN length(line) >= length(other) THEN other ELSE line END AS y FROM c),
near AS (SELECT DISTINCT line FROM (SELECT line, x, y, unnest(range(0, length(x))) AS i FROM p)
         WHERE left(x, i) = left(y, i) AND substr(x, i + 2) = substr(y, i + 2 - (length(x) - length(y)))),
d AS (SELECT l.doc_id, l.no, l.raw, l.line <> '' AND (l.doc_id, l.no) <> f.first AS exact, near.line IS NOT NULL AS near
      FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON l.line = near.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT (coalesce(exact, false) OR near)), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
