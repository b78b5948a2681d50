"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidate spans in whole texts. The candidates' hashes are then counted over distinct repositories and
owners: a value that many owners or many repositories carry is a copied example, one that few carry looks live. Base spans always
stay; spans of the further patterns are added only for live-looking values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import narrowed, rejoin, table

#: kind, pattern, group of the value, least length of that group. The first three are the base kinds.
KINDS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("prefixed", "(?:gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9-]+", 0, 24),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 40),
)
BASE = 3
#: Every text with a span matches this, so other texts skip the patterns above.
ANY = "(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|gh[pousr]_|xox[abprs]-|sk_live_|eyJ"
#: Owners that may carry a value that still counts as live.
MAX_OWNERS = 2
#: Distinct repositories, over all owners, that may carry a value that still counts as live.
MAX_REPOSITORIES = 10

#: Matches whose positions are added up at once.
BLOCK = 256

_SPANS = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: Column, kind: int) -> Column:
    """Spans of one kind: texts between matches and the matches themselves, alternating, give the positions."""
    _, pattern, group, least = KINDS[kind]
    gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.zip_with(F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), whole, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("len"))), values, lambda p, v: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), v.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

    def step(acc, p):
        a = acc["at"] + p["gap"]
        b = a + p["len"]
        span = F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("stop"), p["value"].alias("value"))
        return F.struct(b.alias("at"), F.when(F.length(p["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    # Growing an array copies it, so matches are added up in blocks, which are then moved to their places.
    first = lambda p: F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(BLOCK))
    blocks = lambda p: F.transform(first(p), lambda i: F.aggregate(F.slice(p, i, BLOCK), start, step))
    places = lambda b: F.slice(F.aggregate(b, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"]))), F.lit(1), F.size(b))
    shift = lambda s, at: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["stop"] + at).alias("stop"), s["value"].alias("value"))
    moved = lambda b: F.flatten(F.zip_with(b, places(b), lambda x, at: F.transform(x["out"], lambda s: shift(s, at))))
    return _let(pieces, lambda p: _let(blocks(p), moved))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repository_col="doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_repositories for each row, repeated rows too.

    A value is live if at most max_owners owners and at most max_repositories repositories carry it.
    n_repositories is that of the row's most widely copied value, 0 without spans.
    Positions are code points. Null counts as the empty text; a null owner or repository is an owner or repository of
    its own. Only the named columns are read; an empty table gives an empty result.
    """
    scanned = table(
        narrowed(docs, doc_id=id_col, text=text_col, owner=owner_col, repository=repository_col)
        .select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("owner").cast("string"), F.lit("\0")).alias("owner"), F.coalesce(F.col("repository").cast("string"), F.lit("\0")).alias("repository"))
        .select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repository",
            F.when(F.col("text").rlike(ANY), F.concat(*(_spans(F.col("text"), k) for k in range(len(KINDS))))).otherwise(F.expr(f"cast(array() as {_SPANS})")).alias("found"),
        ),
        "secret-spans",
    )
    single = scanned.select("rid", "owner", "repository", F.explode("found").alias("s")).select("rid", "owner", "repository", "s", F.sha2(F.col("s.value"), 256).alias("hash"))
    owners = (
        single.select("hash", "repository", "owner").distinct()
        .groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))
    )
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    verdicts = rejoin(single, owners, "hash", row_bytes=96).withColumn("live", live)
    added = F.when(F.col("live") & (F.col("s.kind") >= BASE), F.col("s"))
    by_row = verdicts.groupBy("rid").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.collect_list(added).alias("added"), F.max("n_repositories").alias("n_repositories"))
    base = F.filter("found", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return scanned.join(by_row, "rid", "left").select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, F.coalesce("added", F.expr(f"cast(array() as {_SPANS})")))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("n_repositories", F.lit(0)).alias("n_repositories"),
    )


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("prefixed", "(?:gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9-]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
SQL = (
    "WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS owner, coalesce(CAST(doc_id AS VARCHAR), chr(0)) AS repository FROM documents),\n"
    + ",\n".join(
        f"""p{k} AS (SELECT rid, owner, repository, unnest(range(1, len(m) + 1)) AS i, g, m, v FROM (
  SELECT rid, owner, repository, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM t WHERE regexp_matches(text, '{p if least == 8 else p[:-1] + '{%d}' % max(1, least - 8) if k in (1, 2) else p}'))),
s{k} AS (SELECT rid, owner, repository, {k} AS kind, '{name}' AS name, v[i] AS value,
   sum(length(g[i]) + length(m[i])) OVER (PARTITION BY rid ORDER BY i) AS stop, length(m[i]) AS n FROM p{k}),
f{k} AS (SELECT rid, owner, repository, kind, name, value, stop - n AS start, stop FROM s{k} WHERE length(value) >= {least})"""
        for k, (name, p, group, least) in enumerate(_SQL_KINDS)
    )
    + ",\nf AS ("
    + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(len(_SQL_KINDS)))
    + f"""),
o AS (SELECT value, count(DISTINCT repository) AS repositories, count(DISTINCT owner) <= {MAX_OWNERS} AND count(DISTINCT repository) <= {MAX_REPOSITORIES} AS live FROM f GROUP BY value),
r AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base,
        coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3 OR live), '') AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(repositories) AS n_repositories
      FROM f JOIN o USING (value) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_repositories, 0) AS n_repositories
FROM t LEFT JOIN r USING (rid)"""
)
