"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. One pass writes each row's 64-bit fingerprint, SHA-256 and length beside its text.
2. Every scan task ("sender") sorts the distinct fingerprints of each owner's hash range, Golomb-Rice codes
   their gaps and sends one blob to each owner.
3. Owners decode the blobs and answer with one bit for each fingerprint: seen by another sender, too.
4. Rows whose fingerprint has its bit set, or repeats inside its own sender, are suspects. Only their texts are
   shuffled; grouping by the normalised text itself compares bytes. The grouping pre-aggregates on the map
   side, so a text that fills a third of the table reaches its reducer once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WS_BYTES, WS_CHARS, entered, keys_join, parts, rejoin, table, text_bytes

#: An owner decodes at most about this many rows' fingerprints at once.
ROWS_PER_OWNER = 2_000_000
#: Scan tasks are put together to senders until a blob holds about this many fingerprints: blobs then stay in
#: proportion to the rows. A sender's rows grow to ROWS_A_BLOB * owners, 16 bytes each.
ROWS_A_BLOB = 1_000


def golomb_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of sorted distinct uint64 values: count, parameter, then unary and binary parts of gaps."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / n))))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = np.empty(0, np.uint8)
    if k:
        low = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - k :].ravel()
    return np.array([n, k, len(unary)], "<u8").tobytes() + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    n, k, bits = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    split = 24 + (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8)[24:split], count=bits))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.zeros((n, 64), np.uint8)
        low[:, 64 - k :] = np.unpackbits(np.frombuffer(blob, np.uint8)[split:], count=n * k).reshape(n, k)
        gaps |= np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        digests = [hashlib.sha256(x.translate(None, WS_BYTES)) for x in text_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i) for i in range(3)),
                pa.array([int.from_bytes(x.digest()[:8], "little", signed=True) for x in digests], pa.int64()),
                pa.array([x.hexdigest() for x in digests], pa.string()),
            ],
            ["rid", "doc_id", "text", "fp", "sha"],
        )


def _senders(owners: int):
    """For each owner one row: the coded distinct fingerprints, and the rows behind them in the same order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        cols = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not cols:
            return
        rid = np.concatenate([x for x, _ in cols])
        fp = np.concatenate([x for _, x in cols]).astype(np.uint64)
        order = np.lexsort((rid, fp))
        rid, fp = rid[order], fp[order]
        owner = ((fp >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        cuts = np.searchsorted(owner, np.arange(owners + 1))
        rows = []
        for o in range(owners):
            a, b = int(cuts[o]), int(cuts[o + 1])
            if a < b:
                distinct, count = np.unique(fp[a:b], return_counts=True)
                base = np.uint64(-((-o << 32) // owners)) << np.uint64(32)
                rows.append((o, golomb_encode(distinct - base), rid[a:b].astype("<i8").tobytes(), count.astype("<u4").tobytes()))
        sender = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([sender] * len(rows), pa.int32()),
                *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)),
            ],
            ["owner", "sender", "blob", "rids", "counts"],
        )

    return run


def _answer(pdf):
    """An owner's work: which of each sender's fingerprints does another sender hold as well?"""
    import pandas as pd

    lists = [golomb_decode(b) for b in pdf["blob"]]
    values, count = np.unique(np.concatenate(lists), return_counts=True)
    repeated = values[count > 1]
    bitmaps = [np.packbits(np.isin(x, repeated, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"owner": pdf["owner"], "sender": pdf["sender"], "bitmap": bitmaps})


def _suspects(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for rids, counts, bitmap in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            count = np.frombuffer(counts, "<u4")
            hit = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(count)).astype(bool) | (count > 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rids, "<i8")[np.repeat(hit, count)])], ["rid"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of rows whose texts are equal without white space; of each, one row stays.

    Returns (decisions, rows). decisions has a row for every input row, repeated ones too: rid, doc_id, keep_id,
    group_size, kept, text_sha256. rows holds rid, doc_id and text. rid is rid_col if given (unique), else a new number.
    The longest original text stays (in code points), then the smallest id, then the first of repeated rows;
    null ids come last. Null counts as the empty text; all empty texts form one group. Other columns are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = table(
        entered(docs, id_col, text_col, rid_col).mapInArrow(_fingerprints, "rid long, doc_id long, text string, fp long, sha string"),
        "exact-rows",
    )
    rows = base.count()
    owners = max(parts(spark), rows // ROWS_PER_OWNER + 1)
    senders = max(parts(spark), rows // (ROWS_A_BLOB * owners))
    sent = table(
        base.select("rid", "fp").coalesce(senders).mapInArrow(_senders(owners), "owner int, sender int, blob binary, rids binary, counts binary"),
        "exact-sent",
    )
    answers = sent.select("owner", "sender", "blob").groupBy("owner").applyInPandas(_answer, "owner int, sender int, bitmap binary")
    suspects = table(
        sent.join(answers, ["owner", "sender"]).select("rids", "counts", "bitmap").mapInArrow(_suspects, "rid long"), "exact-suspects"
    )
    seen = keys_join(base, suspects, "rid", "inner").select(
        "rid",
        "doc_id",
        "sha",
        F.length(F.coalesce("text", F.lit(""))).alias("len"),
        F.translate(F.coalesce("text", F.lit("")), WS_CHARS, "").alias("norm"),
    )
    best = F.struct("len", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("id"), (-F.col("rid")).alias("rid"))
    groups = (
        seen.groupBy("sha", "norm")
        .agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
        .select("sha", F.xxhash64("norm").alias("again"), "best", "group_size")
    )
    members = (
        rejoin(seen.select("rid", "sha", F.xxhash64("norm").alias("again")), groups, ["sha", "again"], row_bytes=128)
        .select("rid", (-F.col("best.id")).alias("keep"), (-F.col("best.rid")).alias("keep_rid"), "group_size")
    )
    decisions = base.select("rid", "doc_id", "sha").join(members, "rid", "left")
    found = F.col("keep_rid").isNotNull()
    return (
        decisions.select(
            "rid",
            "doc_id",
            F.when(found, F.col("keep")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (~found | (F.col("keep_rid") == F.col("rid"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        ),
        base.select("rid", "doc_id", "text"),
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    decisions, _ = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return decisions.drop("rid")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (SELECT norm, count(*) AS group_size,
             first(doc_id ORDER BY len DESC, doc_id) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, n.sha AS text_sha256
FROM n JOIN g USING (norm)
"""
