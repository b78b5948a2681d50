"""Removal of repeated passages by distributed prefix doubling over sampled suffix positions.

A plain doubling ranks every byte position at lengths 1, 2, 4, ... and sorts them all in each round. Here only
*anchors* are ranked: positions whose GRAM-byte hash is the smallest in some window of ``length`` bytes. Every window
has exactly one anchor, chosen by its bytes alone, so equal windows have their anchors at the same place; about one
position in 180 is an anchor. A window of an anchor is named by its offset, the bytes it has before the anchor.

Each round ranks pairs (left context, right context) of the anchors at contexts that have grown towards ``length``. A
node is a range [lo, hi] of offsets; all its windows share a core, lo bytes before the anchor up to length - hi after it.
A core that is unique in the corpus ends all windows of the node ("until unique"). If the hull, hi bytes before up to
length - lo after, is shared with another anchor, all its windows repeat ("past the threshold"). Other nodes are
split and ranked again with longer cores, down to single windows. An anchor that is done stays as a witness while it
shares its core with an open one.

The same is done over words, in the same rounds: ``n_repeat_words`` counts the words of passages of WORDS or more words that repeat, which
may be shorter than ``length`` bytes. There a symbol is a word's 64-bit hash instead of a byte.

Ranks are 128-bit hashes of the context's symbols, two 64-bit ones from prefix sums over random values; only their
equality matters, so no order of ranks is computed. Spark's shuffles count equal ranks with partial sums; a
passage of a million copies is a key with a million small rows that are counted on the map side. Shared cores are only a
sieve, which is broadcast, for the anchors, and hulls decide; a shared hull's rows are joined back to its written count,
never paired, by a join that can split the key's rows. Up to SIFT_KEYS cores these joins have one plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import entered, hashed, keys_join, mix, rejoin, shuffled, sieve, sifted, table, text_bytes, word_hashes

LENGTH = 400
GRAM = 32
#: The same for words: repeated passages of at least so many, and the words whose hash picks the anchors.
WORDS = 50
WORD_GRAM = 6
#: Into how many parts a node is split in each round.
SPLIT = 4
#: Rows that a Python step holds in lists and arrays at once; Arrow's batches have up to 10,000.
SLICE = 500

_RNG = np.random.default_rng(41)
_TABLES = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = tuple(int(x) * 8 + 3 for x in _RNG.integers(1, 2**60, 2))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], have, step = 1, 1, base % 2**64
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have, step = have + take, step * step % 2**64
    return out


def symbols(text: bytes, unit: str) -> np.ndarray:
    """A text as its bytes, or as the hashes of its words."""
    return word_hashes(text) if unit == "words" else np.frombuffer(text, np.uint8)


class Hasher:
    """Hashes of any run of symbols from prefix sums modulo 2^64 over a random value of each."""

    def __init__(self) -> None:
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up = [_powers(b, self.n + 1) for b in _BASES]
            self.down = [_powers(pow(b, -1, 2**64), self.n + 1) for b in _BASES]

    def load(self, data: np.ndarray) -> None:
        self._grow(len(data))
        self.sums = []
        for which, (t, up) in enumerate(zip(_TABLES, self.up, strict=True)):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((t[data] if data.dtype == np.uint8 else mix(data, which + 1)) * up[: len(data)], out=sums[1:])
            self.sums.append(sums)

    def of(self, which: int, a, b) -> np.ndarray:
        x = (self.sums[which][b] - self.sums[which][a]) * self.down[which][a]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def anchors(hasher: Hasher, size: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions with the first and last window start of each; hasher has loaded the bytes."""
    windows, span = size - length + 1, length - gram + 1
    if windows <= 0:
        return (np.empty(0, np.int64),) * 3
    starts = np.arange(size - gram + 1)
    bits = max(1, int(size).bit_length())
    rank = (hasher.of(0, starts, starts + gram) >> np.uint64(bits) << np.uint64(bits)) | starts.astype(np.uint64)
    blocks = -(-len(rank) // span)
    padded = np.full(blocks * span, np.uint64(2**64 - 1))
    padded[: len(rank)] = rank
    shaped = padded.reshape(blocks, span)
    before = np.minimum.accumulate(shaped, axis=1).ravel()
    after = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:windows], before[span - 1 : span - 1 + windows])
    at = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    return at[first], first, np.append(first[1:] - 1, windows - 1)


def _slices(batches: Iterator) -> Iterator:
    return (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))


def _read(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in _slices(batches):
        raw = text_bytes(batch.column(2))
        digests = [hashlib.sha256(x).digest() for x in raw]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array([len(x) for x in raw], pa.int64()), pa.array([len(x.split()) for x in raw], pa.int64()), pa.array(digests, pa.binary())],
            ["rid", "doc_id", "text", "n_bytes", "n_words", "digest"],
        )


def _ranks(hasher: Hasher, length: int, at, lo, hi, x, y) -> list[np.ndarray]:
    """Of nodes with the offsets x..y: the core's rank, and the two halves of the rank of the hull of their own offsets."""
    left, right = np.minimum(hi, y), length - np.maximum(lo, x)
    bounds = (left * 65_536 + right).astype(np.uint64) * np.uint64(_BASES[0] % 2**64)
    ranks = (hasher.of(0, at - x, at + length - y), hasher.of(0, at - left, at + right) ^ bounds, hasher.of(1, at - left, at + right))
    return [r.view(np.int64) for r in ranks]


def _first_nodes(kinds: tuple):
    """For each anchor of each kind its two nodes: offsets x..y, whether its text is done, the core's rank, and the rank of the hull of its own offsets."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher()
        for batch in _slices(batches):
            found: list[list[np.ndarray]] = [[np.empty(0, bool if k == 7 else np.int64)] for k in range(11)]
            for rid, text, over in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for kind, (unit, length, gram) in enumerate(kinds):
                    if len(text) < length or len(data := symbols(text, unit)) < length:
                        continue
                    hasher.load(data)
                    place, low, high = anchors(hasher, len(data), length, gram)
                    half = (length - gram) // 2
                    for x, y in ((0, half), (half + 1, length - gram)):
                        lo, hi = place - high, place - low
                        mine = (lo <= y) & (hi >= x)
                        at, lo, hi = place[mine], lo[mine], hi[mine]
                        rids, ks, xs, ys = (np.full(len(at), v, np.int64) for v in (rid, kind, x, y))
                        for column, v in zip(found, (rids, ks, at, lo, hi, xs, ys, np.full(len(at), over), *_ranks(hasher, length, at, lo, hi, x, y)), strict=True):
                            column.append(v)
            names = ["rid", "kind", "at", "lo", "hi", "x", "y", "done", "core", "hull", "hull2"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names)

    return run


def _next_nodes(kinds: tuple):
    """Ranks of a document's open and witnessing nodes, from the symbols around their anchors."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["rid", "kind", "at", "lo", "hi", "x", "y", "done", "core", "hull", "hull2"]
        hasher = Hasher()
        for batch in _slices(batches):
            found: list[list[np.ndarray]] = [[] for _ in names]
            for rid, text, nodes in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2), strict=True):
                fields = [nodes.values.field(k).to_numpy(zero_copy_only=False) for k in range(7)]
                for kind, (unit, length, _) in enumerate(kinds):
                    mine = np.flatnonzero(fields[0] == kind)
                    if not len(mine):
                        continue
                    hasher.load(symbols(text, unit))
                    at, lo, hi, x, y, done = (f[mine] for f in fields[1:])
                    same = (np.full(len(at), v, np.int64) for v in (rid, kind))
                    for column, v in zip(found, (*same, at, lo, hi, x, y, done, *_ranks(hasher, length, at, lo, hi, x, y)), strict=True):
                        column.append(v)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names)

    return run


def _judged(nodes: DataFrame) -> DataFrame:
    """The nodes that share their core with another anchor, one of them open. ``shared``: the hull is shared, too, so
    all windows repeat; one anchor of each shared hull goes on as its ``witness``, and so do the nodes that don't.

    Cores are sifted, so a few nodes whose core is unique stay: their hull, which is counted exactly, is unique, too."""
    by = ["kind", "x", "core"]
    cores = nodes.groupBy(hashed(by).alias("key")).agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("open")).where("n > 1 and open > 0").select("key")
    alive = table(sifted(nodes, by, sieve(table(cores, "suffix-cores"), 2)).drop("core"), "suffix-alive")
    hulls = alive.groupBy("kind", "x", "hull", "hull2").agg(F.count("*").alias("n"), F.min(F.xxhash64("rid", "at")).alias("witness")).where("n > 1").drop("n")
    shared = F.col("witness").isNotNull()
    out = shuffled(alive, hulls, ["kind", "x", "hull", "hull2"], "left").select(
        "rid", "kind", "at", "lo", "hi", "x", "y", "done", shared.alias("shared"), (~shared | (F.col("witness") == F.xxhash64("rid", "at"))).alias("witness")
    )
    return table(out, "suffix-nodes")


def runs_of(spans: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs that spans cover; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator) -> Iterator:
    """What is left of each text without its repeated bytes."""
    import pyarrow as pa

    for batch in _slices(batches):
        out = []
        for rid, text, spans in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            kept, end, runs = hashlib.sha256(), 0, runs_of(spans)
            for a, b in runs:
                kept.update(text[end:a])
                end = b
            kept.update(text[end:])
            out.append((rid, sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["rid", "removed", "runs", "kept"])


def _covered(batches: Iterator) -> Iterator:
    """How many words the spans of each row cover."""
    import pyarrow as pa

    for batch in _slices(batches):
        n = [sum(b - a for a, b in runs_of(spans)) for spans in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["rid", "words"])


def entered_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, copies). rows: rid, doc_id, text, n_bytes, n_words, digest. copies: rid of the rows with an equal text, and
    whether it is the head (first) of these."""
    base = table(
        entered(docs, id_col, text_col, None).mapInArrow(_read, "rid long, doc_id long, text string, n_bytes long, n_words long, digest binary"),
        "suffix-rows",
    )
    classes = base.groupBy("digest").agg(F.count("*").alias("copies"), F.min("rid").alias("first")).where("copies > 1")
    copies = rejoin(base.select("rid", "digest"), classes, "digest", row_bytes=64).select("rid", (F.col("rid") == F.col("first")).alias("head"))
    return base, table(copies, "suffix-copies")


def _of_rows(texts: DataFrame, rids: DataFrame) -> DataFrame:
    """The texts of these rows and a few others."""
    return sifted(texts, "rid", sieve(table(rids.select(hashed("rid").alias("key")).distinct(), "suffix-rids")))


def _of(values, column: str = "kind"):
    """The value of a row's kind."""
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col(column).cast("int"))


def repeated_spans(rows: DataFrame, copies: DataFrame, kinds: tuple = (("bytes", LENGTH, GRAM), ("words", WORDS, WORD_GRAM))) -> DataFrame:
    """rid, kind, spans of a, b: ranges of ``length`` symbols that start anywhere else, too; they may overlap. Rows with
    an equal text elsewhere have none: they repeat as a whole.

    kinds: (unit, length, gram), all judged in the same rounds; ``kind`` is the place in this list."""
    # One of each group of equal texts stands for them: it witnesses other documents' repeats and has no open node.
    texts, equal = rows.select("rid", "text"), sieve(copies.select(hashed("rid").alias("key")))
    copied = sifted(texts, "rid", equal).join(copies.hint("merge"), "rid", "left").where("head is null or head").select("rid", "text", F.col("head").isNotNull().alias("done"))
    heads = sifted(texts, "rid", equal, "left_anti").withColumn("done", F.lit(False)).union(copied)
    named = "rid long, kind long, at long, lo long, hi long, x long, y long, done boolean, core long, hull long, hull2 long"
    first = table(heads.mapInArrow(_first_nodes(kinds), named), "suffix-first")
    nodes = _judged(first)
    spans, held = [nodes], None
    widths = [(length - gram) // 2 + 1 for _, length, gram in kinds]
    while max(widths) > 1:
        open_kinds = [k for k, w in enumerate(widths) if w > 1]
        widths = [-(-w // SPLIT) for w in widths]
        step = F.explode(F.sequence("x", "y", _of(widths))).alias("x")
        child = nodes.where("witness").where(F.col("kind").isin(open_kinds)).select("rid", "kind", "at", "lo", "hi", "y", (F.col("done") | F.col("shared")).alias("done"), step)
        child = child.withColumn("y", F.least(F.col("x") + _of(widths) - 1, "y")).where("x <= hi and y >= lo")
        pending = table(child.groupBy("rid").agg(F.collect_list(F.struct("kind", "at", "lo", "hi", "x", "y", "done")).alias("nodes")), "suffix-pending")
        if held is None:  # only the documents that may hold a repeat go on
            held = table(_of_rows(texts, pending), "suffix-texts")
        ranked = held.join(pending, "rid").select("rid", "text", "nodes").mapInArrow(_next_nodes(kinds), named)
        nodes = _judged(table(ranked, "suffix-ranks"))
        spans.append(nodes)
    out, lengths = None, _of([length for _, length, _ in kinds])
    for s in spans:
        s = s.where("shared and not done").select("rid", "kind", (F.col("at") - F.least("hi", "y")).alias("a"), (F.col("at") + lengths - F.greatest("lo", "x")).alias("b"))
        out = s if out is None else out.union(s)
    return table(out.groupBy("rid", "kind").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "suffix-spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS, word_gram: int = WORD_GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeat_words for each row, repeated rows too.

    A byte goes if a ``length``-byte string that covers it also starts elsewhere in any text, its own included; matches
    overlap and never cross texts. n_repeat_words counts, without removing any, the words that a run of ``words`` words
    covers which also starts elsewhere. Null counts as the empty text; shorter texts lose nothing. Only the two columns
    are read. An empty table gives an empty result.
    """
    rows, copies = entered_texts(docs, id_col, text_col)
    spans = repeated_spans(rows, copies, (("bytes", length, gram), ("words", words, word_gram)))
    by_row = spans.where("kind = 0").drop("kind")
    texts = _of_rows(rows.select("rid", "text"), by_row).join(by_row, "rid")
    cut = texts.select("rid", "text", "spans").mapInArrow(_cut, "rid long, removed long, runs long, kept string")
    passages = spans.where("kind = 1").select("rid", "spans").mapInArrow(_covered, "rid long, words long")
    gone = F.col("copied") & (F.col("n_bytes") >= length)
    rows = keys_join(rows.drop("text"), copies, "rid", "left").withColumn("copied", F.col("head").isNotNull())
    return rows.join(cut, "rid", "left").join(passages, "rid", "left").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(F.col("copied") & (F.col("n_words") >= words), F.col("n_words")).otherwise(F.coalesce("words", F.lit(0))).alias("n_repeat_words"),
    )


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT rid, doc_id, lower(hex(encode(text))) AS x, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM base),
byte_at AS (SELECT rid, a, md5(substr(x, 2 * a + 1, 800)) AS h FROM (SELECT rid, x, unnest(range(0, length(x) // 2 - 399)) AS a FROM b)),
byte_twice AS (SELECT rid, a FROM byte_at SEMI JOIN (SELECT h FROM byte_at GROUP BY h HAVING count(*) > 1) t USING (h)),
byte_marks AS (SELECT rid, a, coalesce(a - lag(a) OVER (PARTITION BY rid ORDER BY a) > 400, true)::INT AS fresh FROM byte_twice),
byte_runs AS (SELECT rid, min(a) AS a, max(a) + 400 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY a) AS g FROM byte_marks) GROUP BY rid, g),
word_at AS (SELECT rid, a, md5(array_to_string(w[a + 1 : a + 50], ' ')) AS h FROM (SELECT rid, w, unnest(range(0, len(w) - 49)) AS a FROM b)),
word_twice AS (SELECT rid, a FROM word_at SEMI JOIN (SELECT h FROM word_at GROUP BY h HAVING count(*) > 1) t USING (h)),
word_new AS (SELECT rid, least(50, coalesce(a - lag(a) OVER (PARTITION BY rid ORDER BY a), 50)) AS n FROM word_twice),
gone AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM byte_runs GROUP BY rid),
cuts AS (SELECT rid, a, b FROM byte_runs UNION ALL SELECT rid, length(x) // 2, length(x) // 2 FROM b),
gaps AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a, b), 0) AS a, a AS b FROM cuts),
kept AS (SELECT rid, string_agg(substr(x, 2 * gaps.a + 1, 2 * (gaps.b - gaps.a)), '' ORDER BY gaps.a, gaps.b) AS x FROM gaps JOIN b USING (rid) GROUP BY rid),
words AS (SELECT rid, sum(n)::BIGINT AS n FROM word_new GROUP BY rid)
SELECT b.doc_id, (length(b.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(kept.x)) AS kept_sha256, coalesce(words.n, 0)::BIGINT AS n_repeat_words
FROM b JOIN kept USING (rid) LEFT JOIN gone USING (rid) LEFT JOIN words USING (rid)
"""
