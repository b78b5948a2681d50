"""N-gram Jaccard join with several global token orders.

A document is the set of its distinct word shingles, as 64-bit hashes. Two sets of similarity t must share a token among
the first n - ceil(t n) + 1 of each, under *any* global order of tokens. Three orders are used: in each, tokens that are
frequent in the corpus come last (a fixed-size count sketch over all documents tells how frequent), the rest in the
order of one of three hashes. A pair is only verified if it shares a prefix token under all three.

Links only matter through the components they form, so a group of N near copies does not make N^2 pairs:
1. documents with equal sets are one class;
2. in each group of the first order's prefix index every member is paired with the group's first one (a star), and the
   verified pairs are joined to components. A star's center is then done in its group: all its pairs have been judged;
3. what is left is counted: pairs of different components inside a group. While they are more than a multiple of the
   index rows, each open group gets a round of 8, 32, 128, ... further stars, and components again;
4. at last members of different components pair with each other. None is left out, and none inside a component is made.

Sizes and bitmaps are part of the join that pairs a group, so it only puts out pairs that may be links. Members that are
in no component with their group, yet pass no bitmap, are compared and not put out; that alone is quadratic in a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import entered, keys_join, mix, rejoin, shuffled, table, text_bytes, word_hashes
from ._components import components

#: Counters of the frequency sketch (4 bytes each) as a power of two; its size does not depend on the input.
SKETCH_BITS = 22
_BLOCK_BITS = 18
#: 64-bit words of a set's parity bitmap.
BITMAP_WORDS = 16
#: Pairs across components that are compared at once, as a multiple of the rows of the prefix index: after the first
#: stars, when many of them may be links, and after a second round, when few are and nearly all fail by their bitmaps.
FEW_PAIRS, MANY_PAIRS = 8, 128

_WORDS = np.random.default_rng(29).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles; A-Z are lower-cased, fewer words make one shingle."""
    hashes = word_hashes(text.lower())
    if not len(hashes):
        return hashes
    k = min(words, len(hashes))
    total = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        total += hashes[i : len(hashes) - k + 1 + i] * _WORDS[i]
    return np.unique(mix(total))


def prefix_length(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each bit: two sets differ in at least as many tokens as bits."""
    place = mix(tokens, 7)
    word = (place % np.uint64(BITMAP_WORDS)).astype(np.int64)
    out = np.zeros(BITMAP_WORDS, np.uint64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (place >> np.uint64(58)))
    return out.view(np.int64)


def _read(words: int):
    """Each document's row, then the task's sketch in blocks (rows without rid)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["rid", "doc_id", "n", "f1", "f2", "block", "sketch"]
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            n, f1, f2 = [], [], []
            waiting, held = [], 0
            for text in text_bytes(batch.column(2)):
                tokens = shingles(text, words)
                n.append(len(tokens))
                f1.append(mix(tokens, 1).sum(dtype=np.uint64))
                f2.append(mix(tokens, 2).sum(dtype=np.uint64))
                waiting.append(tokens >> np.uint64(64 - SKETCH_BITS))
                held += len(tokens)
                if held > 1 << 20:
                    _count(counts, waiting)
                    waiting, held = [], 0
            _count(counts, waiting)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names
            )
        blocks = counts.reshape(-1, 1 << _BLOCK_BITS)
        used = [i for i in range(len(blocks)) if blocks[i].any()]
        empty = [pa.nulls(len(used), t) for t in [pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used, pa.int32()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in used], pa.binary())], names)

    return run


def _count(counts: np.ndarray, waiting: list[np.ndarray]) -> None:
    if waiting:
        at, n = np.unique(np.concatenate(waiting), return_counts=True)
        counts[at] += n.astype(np.uint32)


def _sum_block(pdf):
    import pandas as pd

    total = np.zeros(1 << _BLOCK_BITS, np.int64)
    for blob in pdf["sketch"]:
        total += np.frombuffer(zlib.decompress(blob), np.uint32)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "sketch": [zlib.compress(total.tobytes(), 1)]})


def _levels(base: DataFrame) -> np.ndarray:
    """How frequent the tokens of each counter are: 0 for all that do not stand out, then by powers of two."""
    sums = base.where("block is not null").select("block", "sketch").groupBy("block").applyInPandas(_sum_block, "block int, sketch binary")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in sums.toLocalIterator():
        counts[row["block"] << _BLOCK_BITS : (row["block"] + 1) << _BLOCK_BITS] = np.frombuffer(zlib.decompress(row["sketch"]), np.int64)
    noise = counts.mean() ** 0.5 + 1
    return np.log2(np.maximum(1.0, 2 * (counts - counts.mean()) / noise)).astype(np.uint8)


def ordered_prefixes(tokens: np.ndarray, levels: np.ndarray, length: int) -> list[np.ndarray]:
    """The first tokens under each order."""
    level = levels[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)
    out = []
    for salt in (3, 4, 5):
        rank = (mix(tokens, salt) >> np.uint64(6)) | level
        out.append(tokens[np.argpartition(rank, length - 1)[:length]] if length < len(tokens) else tokens)
    return out


def _prefixes(words: int, percent: int, levels):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        level = levels.value
        for batch in batches:
            rids, rows = [], []
            for rid, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                tokens = shingles(text, words)
                if len(tokens) and len(tokens) * (100 - percent) >= percent:  # smaller sets can only link to equal ones
                    first, *others = ordered_prefixes(tokens, level, prefix_length(len(tokens), percent))
                    rids.append(rid)
                    rows.append((len(tokens), *bitmap(tokens).tolist(), first.view(np.int64), *(x.astype(np.uint32).view(np.int32) for x in others)))
            columns = list(zip(*rows, strict=True)) or [()] * (BITMAP_WORDS + 4)
            kinds = [pa.int64()] * (BITMAP_WORDS + 1) + [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), *arrays], ["rid", "n", *BITS, "p1", "p2", "p3"])

    return run


BITS = [f"m{i}" for i in range(BITMAP_WORDS)]


def _linked(words: int, percent: int, held: int = 256):
    """The pairs whose sets are similar enough. Recent documents' sets are kept, as pairs come sorted by one side."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache: dict[int, np.ndarray] = {}

        def tokens(rid: int, text: bytes) -> np.ndarray:
            if rid not in cache:
                if len(cache) >= held:
                    cache.pop(next(iter(cache)))
                cache[rid] = shingles(text, words)
            return cache[rid]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            keep = []
            for x, s, y, t in zip(a, text_bytes(batch.column(1)), b, text_bytes(batch.column(3)), strict=True):
                one, two = tokens(x, s), tokens(y, t)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


class _Join:
    def __init__(self, texts: DataFrame, index: DataFrame, words: int, percent: int):
        self.texts, self.index, self.words, self.percent = texts, index, words, percent

    def near(self) -> str:
        """Over n_a, n_b and the bitmaps: sizes and parities that a link allows. |A xor B| <= (1 - t) / (1 + t) (|A| + |B|)."""
        p = self.percent
        differ = " + ".join(f"bit_count({m}_a ^ {m}_b)" for m in BITS)
        return f"100L * least(n_a, n_b) >= {p}L * greatest(n_a, n_b) and {100 + p}L * ({differ}) <= {100 - p}L * (n_a + n_b)"

    def side(self, c: str, key: str, *names: str) -> DataFrame:
        return self.index.select(F.col("rid").alias(key), *(F.col(x).alias(f"{x}_{c}") for x in names)).hint("merge")

    def verified(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """The links among candidate pairs (a, b), which must share a prefix token under the other orders, too; and how
        many pairs there were."""
        pairs = table(pairs.distinct(), "jaccard-pairs")
        n = pairs.count()
        ids = table(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "jaccard-ids", 2 * n)
        order = table(keys_join(self.index.select("rid", "p2", "p3"), ids, "rid", "left_semi"), "jaccard-orders")
        side = lambda c: order.select(F.col("rid").alias(c), F.col("p2").alias(f"p2{c}"), F.col("p3").alias(f"p3{c}")).hint("merge")
        left = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b")).select("a", "b")
        left = table(left, "jaccard-left", n)
        ids = table(left.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "jaccard-ids", 2 * n)
        texts = keys_join(self.texts.select("rid", "text"), ids, "rid", "left_semi")
        text = lambda c: texts.select(F.col("rid").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
        full = left.join(text("b"), "b").join(text("a"), "a").select("a", "text_a", "b", "text_b")
        return table(full.mapInArrow(_linked(self.words, self.percent), "a long, b long"), "jaccard-links"), n


def _distinct_groups(keys: DataFrame) -> DataFrame:
    """(key, head) of the groups of two or more; of groups with the same members one stands for all, as it has the same
    pairs. Members are compared by their number, the first one and a 64-bit sum of their hashes."""
    groups = keys.groupBy("key").agg(F.min("rid").alias("head"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("rid")).alias("members"))
    return groups.where("c > 1").groupBy("head", "c", "members").agg(F.min("key").alias("key")).select("key", "head")


def _pairs(join: _Join, members: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (a, b) of a member and another one of its group that lie in different components and may be a link."""
    left, right = (x.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rid", "root", "n", *BITS))) for s, x in (("a", others), ("b", members)))
    return left.join(right, "key").where(F.expr(f"rid_a <> rid_b and root_a <> root_b and {join.near()}")).select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))


def _merged(join: _Join, shared: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """(node, root) of all links. shared: (key, rid, head) of the groups; links: the verified ones of the heads' stars,
    out of n pairs."""
    tree, edges = table(components(links, rows=n), "jaccard-tree", 2 * n), 2 * n
    rows, most = shared.count(), FEW_PAIRS
    members, stars = shared.where("rid <> head").select("key", "rid"), 8
    while True:
        placed = keys_join(members, tree.withColumnRenamed("node", "rid"), "rid", "left", 32).withColumn("root", F.coalesce("root", "rid"))
        placed = table(placed, "jaccard-placed")
        by_root = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
        mixed = by_root.groupBy("key").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs")).where("pairs > 0")
        mixed = table(mixed, "jaccard-mixed", rows)
        left = mixed.agg(F.sum("pairs")).first()[0] or 0
        rest = keys_join(placed, mixed.select("key"), "key", "left_semi")
        rest = table(rest.join(join.index.select("rid", "n", *BITS), "rid"), "jaccard-rest")
        links = tree.select(F.col("node").alias("a"), F.col("root").alias("b"))
        if left <= most * rows:
            more, n = join.verified(_pairs(join, rest, rest).where("a < b"))
            return components(links.union(more), rows=edges + n)
        # The order of centers is the same in all groups, so that overlapping groups agree on them.
        spot = F.pmod(F.xxhash64("rid", F.lit(stars)), F.lit(stars))
        first = F.min(F.struct(F.xxhash64(F.lit(stars), "rid").alias("order"), "rid", "root", "n", *BITS)).alias("first")
        centers = table(rest.groupBy("key", spot.alias("spot")).agg(first).select("key", "first.*").drop("order"), "jaccard-centers")
        more, n = join.verified(_pairs(join, rest, centers).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        edges += n
        tree = table(components(links.union(more), rows=edges), "jaccard-tree", edges)
        members = rest.select("key", "rid").join(centers.select("key", "rid"), ["key", "rid"], "left_anti")
        stars, most = stars * 4, MANY_PAIRS


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of the links 100 * |A and B| >= percent * |A or B| between the documents' shingle sets.

    Returns (decisions, rows). decisions has a row for every input row, repeated ones too: rid, doc_id, n_shingles,
    component_id (smallest id of the component), kept (one row of each component: the one of the smallest id, null ids
    last). Null, empty and blank texts have an empty set and link with nothing, not even each other. Only the two
    columns are read. rid is rid_col if given (unique), else a new number; rows holds rid and text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = entered(docs, id_col, text_col, rid_col)
    texts = texts if rid_col else table(texts, "jaccard-texts")
    base = table(texts.mapInArrow(_read(words), "rid long, doc_id long, n long, f1 long, f2 long, block int, sketch binary"), "jaccard-rows")
    rows = base.where("rid is not null")
    classes = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("rid").alias("class"), F.count("*").alias("c")).where("c > 1").drop("c")
    member = rejoin(rows.select("rid", "doc_id", "n", "f1", "f2"), classes, ["n", "f1", "f2"], "left", row_bytes=32)
    member = table(member.select("rid", "doc_id", "n", F.coalesce("class", "rid").alias("class")), "jaccard-classes")
    copies = table(member.where("rid <> class").select("rid"), "jaccard-copies")
    levels = spark.sparkContext.broadcast(_levels(base))  # one byte for each counter: 4 MB, whatever the input
    firsts = keys_join(texts.select("rid", "text"), copies, "rid", "left_anti")
    index = table(firsts.mapInArrow(_prefixes(words, percent, levels), f"rid long, n long, {', '.join(f'{m} long' for m in BITS)}, p1 array<bigint>, p2 array<int>, p3 array<int>"), "jaccard-prefixes")
    keys = index.select("rid", F.explode("p1").alias("key"))
    shared = table(shuffled(keys, _distinct_groups(keys), "key"), "jaccard-shared")
    join = _Join(texts, index, words, percent)
    stars = shared.where("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct()
    stars = stars.join(join.side("a", "a", "n"), "a").join(join.side("b", "b", "n"), "b").where(f"100L * least(n_a, n_b) >= {percent}L * greatest(n_a, n_b)")
    stars = stars.join(join.side("a", "a", *BITS), "a").join(join.side("b", "b", *BITS), "b").where(join.near())
    roots = _merged(join, shared, *join.verified(stars.select("a", "b")))
    of = member.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    of = table(of.select("rid", "doc_id", "n", "root"), "jaccard-roots")
    heads = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    alone = F.col("first").isNull()
    decisions = rejoin(of, heads, "root", "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (alone | (F.col("first.rid") == F.col("rid"))).alias("kept"),
    )
    return decisions, texts.select("rid", "text")


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    decisions, _ = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)
    return decisions.select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE b AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[a : a + 2], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS a FROM b)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS m FROM s x JOIN n nx ON x.rid = nx.rid JOIN s y ON x.s = y.s AND x.rid < y.rid JOIN n ny ON y.rid = ny.rid
      WHERE 100 * least(nx.n, ny.n) >= 90 * greatest(nx.n, ny.n) GROUP BY x.rid, y.rid),
l AS (SELECT a, b FROM o JOIN n x ON a = x.rid JOIN n y ON b = y.rid WHERE 100 * m >= 90 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT rid, rid FROM b UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT b.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM b LEFT JOIN n USING (rid) JOIN (SELECT r.a AS rid, min(doc_id) AS component_id FROM r JOIN b ON r.b = b.rid GROUP BY r.a) c USING (rid)
"""
