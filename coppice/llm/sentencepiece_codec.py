"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are marked (spaces become U+2581) and split into marked words that no piece can cross. The distinct words of a
slice of texts are sorted, which walks their trie depth-first; the forward table of a word is a stack, so a word only
computes the characters after the prefix that it shares with the word before.

The forward step depends on the model. For unigram models it is the usual best sum of scores. For BPE models a prefix's
last piece is the one that forms, with the last piece of the prefix before it, a pair that merging would leave apart;
exactly one piece does, which gives the very ids of greedy merging (a best sum of merge ranks would not).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from ._common import narrowed, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
#: Words kept from slice to slice in one Python worker, and characters in a slice.
CACHED_WORDS = 500_000
SLICE_CHARS = 8_000_000
CACHED_PAIRS = 500_000
#: Words of more characters than this are put together at their end.
LONG = 256


class Codec:
    """A model's pieces as plain tables, made from the bytes of its file; sent to executors with the task."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte_ids = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {names[i]: i for i in range(n) if not special[i] and not sp.is_byte(i)}
        self.codes = {p: i.to_bytes(4, "little") for p, i in [*self.ids.items(), *self.byte_ids.items(), (None, self.unknown)]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        ranked = [self.scores[p] for p in sorted(self.ids, key=self.ids.get) if self.scores[p] > -1e6]
        self.merges = all(s == int(s) and s <= 0 for s in ranked)
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.bytes = [b"" if special[i] else bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.normalizer = None if sp.normalize("\ufb01 A\u030a  x ") == f"{MARK}\ufb01{MARK}A\u030a{MARK}{MARK}x{MARK}" else model
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def marked(self, text: str) -> str:
        if self.normalizer:
            import sentencepiece

            if isinstance(self.normalizer, bytes):
                self.normalizer = sentencepiece.SentencePieceProcessor(model_proto=self.normalizer)
            return self.normalizer.normalize(text)
        return MARK + text.replace(" ", MARK) if text else ""

    def words(self, marked: str) -> list[str]:
        return [marked] if self.whole and marked else _WORD.findall(marked)

    def _merged(self, text: str) -> list[str]:
        """Pieces by greedy merging: the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging leaves these two pieces as they are."""
        self.n_pairs += 1
        return self._merged(left + right) == ([left, right] if left else [right])

    def _code(self, piece: str) -> bytes:
        if piece in self.codes:
            return self.codes[piece]
        return b"".join(self.codes[b] for b in piece.encode()) if self.byte_ids else self.codes[None]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each word as little-endian int32, for distinct words in any order. Of equal unigram scores the longest
        last piece wins; the library's choice there hangs on its 32-bit sums over the whole text."""
        out, previous = {}, ""
        if self.n_pairs > CACHED_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        pairs = self.pairs
        # By prefix length: the last piece, what may follow it (BPE), and the score (unigram).
        last, after, total = [""], [pairs.setdefault("", {})], [0.0]
        coded = [b""]  # the ids of a prefix, for prefixes of up to LONG characters
        codes = self.codes
        floor = min(self.scores.values(), default=0.0) - 10.0
        ids, scores, longest = self.ids, self.scores, self.longest
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, previous, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], after[shared + 1 :], total[shared + 1 :], coded[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if self.merges:
                    for begin in range(end - 1, max(0, end - longest) - 1, -1):  # only one fits: short ones are likely
                        piece = word[begin:end]
                        if piece in ids or end - begin == 1:
                            known = after[begin].get(piece)
                            if known is None:
                                known = after[begin][piece] = self._apart(last[begin], piece)
                            if known:
                                last.append(piece)
                                after.append(pairs.setdefault(piece, {}))
                                if end <= LONG:
                                    coded.append(coded[begin] + (codes.get(piece) or self._code(piece)))
                                break
                    else:  # no piece before stays as it is: merge the whole prefix
                        pieces = self._merged(word[:end])
                        last.append(pieces[-1])
                        after.append(pairs.setdefault(pieces[-1], {}))
                        if end <= LONG:
                            coded.append(b"".join(map(self._code, pieces)))
                else:
                    best = None
                    for begin in range(max(0, end - longest), end):
                        piece = word[begin:end]
                        score = scores.get(piece, floor if end - begin == 1 else None)
                        if score is not None and (best is None or total[begin] + score > best[0]):
                            best = (total[begin] + score, piece)
                    total.append(best[0])
                    last.append(best[1])
                    if end <= LONG:
                        coded.append(coded[end - len(best[1])] + self._code(best[1]))
            if len(word) <= LONG:
                out[word] = coded[len(word)]
            else:
                pieces, end = [], len(word)
                while end:
                    pieces.append(self._code(last[end]))
                    end -= len(last[end])
                out[word] = b"".join(reversed(pieces))
            previous = word
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' text, without the mark that encoding put first."""
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()])[1:]


_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def encode_texts(codec: Codec, texts: list[str], cache: dict[str, bytes]) -> Iterator[np.ndarray]:
    """Ids of each text. Slices bound what is held: distinct words of a slice, never the words of all texts."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        new: set[str] = set()
        for text in texts[at:end]:
            new.update(codec.words(codec.marked(text)))
        new.difference_update(cache)
        cache.update(codec.encode_words(new))
        for text in texts[at:end]:
            ids = np.frombuffer(b"".join(map(cache.__getitem__, codec.words(codec.marked(text)))), "<i4")
            if len(ids) and not codec.byte_ids:  # a run of unknown characters is one unknown piece
                unknown = ids == codec.unknown
                ids = ids[~(unknown & np.concatenate(([False], unknown[:-1])))]
            yield ids
        if len(cache) > CACHED_WORDS:
            cache.clear()
        at = end


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (array<int>) in place of the columns in ``drop`` and of any of these names.

    Null and empty texts have no ids. The model's file is read on the driver only. An empty table gives an empty result.
    """
    proto = load(model)
    kept = [f for f in docs.schema.fields if f.name not in {*drop, "n_tokens", "ids"}]
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec, cache = Codec(proto), {}
        for batch in batches:
            texts = [x.decode() for x in text_bytes(batch.column(at))]
            ids = list(encode_texts(codec, texts, cache))
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = pa.array(np.concatenate([np.empty(0, "<i4"), *ids]).astype(np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), lists], [*(f.name for f in kept), "n_tokens", "ids"])

    return docs.mapInArrow(run, StructType([*kept]).add("n_tokens", LongType()).add("ids", ArrayType(IntegerType())))


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian int32), decoded_sha256, round_trip for each row.

    round_trip: decoding the ids gives the text again; a literal U+2581 decodes as a space, as in the library.
    """
    proto = load(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec, cache = Codec(proto), {}
        for batch in batches:
            raw = text_bytes(batch.column(1))
            rows = []
            for ids, text in zip(encode_texts(codec, [x.decode() for x in raw], cache), raw, strict=True):
                back = codec.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text))
            n, ids_sha, back_sha, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    rows = narrowed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
