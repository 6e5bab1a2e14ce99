"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A sequence is filled greedily, the longest fitting piece first; then, as long as that helps, its smallest piece is
replaced by the two unpacked pieces that together fit the widened gap most tightly. Which pieces these are depends on
lengths only, so the plan is made on the count of each length (as many numbers as a sequence has tokens, whatever the
input), one pattern at a time with as many repeats as the counts allow, and rows find their place by their rank among
the pieces of their length.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytes import lean, runs
from tidemark.llm.common import position_in_group, table

SEQUENCE = 2048
#: Words whose ids a task keeps; it starts anew beyond that.
KEPT_WORDS = 1_000_000
#: Characters of text that are encoded at once, or one longer text.
AT_ONCE = 4 << 20
_CUT = "\x1f"
#: Where white space meets white space, or a sign that cuts occurs, words are not independent: such texts are encoded whole.
_WHOLE = r"[\s\p{Z}\x{0b}\x{85}]{2}|[\x{1c}-\x{1f}\x{85}]"
#: A word without white space at its end, nor at its start other than one space: a line feed on either side stays apart.
_APART = r"(?s)^ ?[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}](.*[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}])?$"
#: Words that are encoded as lines of one text.
LINES = 512


class Encoder:
    """Token ids of texts by a byte-level BPE file of `tokenizers`, one word at a time.

    Such a tokenizer never joins across the start of " word" or across a line feed that stands alone, so each distinct
    word is encoded once, with others as lines of one text, whose ids are cut at the line feeds. Texts where that does
    not hold are encoded whole. Words are kept as Arrow strings.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.low = self.size = np.zeros(0, np.int64)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each word has)."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _as_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that match _APART. If the tokenizer joins one with a line feed, they are encoded one by one."""
        if len(self.feed) != 1:
            return self._one_by_one(words)
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        feeds = np.flatnonzero(ids == self.feed[0])
        if len(feeds) != len(words) - 1:
            return self._one_by_one(words)
        return np.delete(ids, feeds), np.diff(np.r_[-1, feeds, len(ids)]) - 1

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Adds new words, and returns the slot of each."""
        known = len(self.words)
        apart = pc.match_substring_regex(words, _APART)
        found = []
        for some, encode, most in ((words.filter(apart), self._as_lines, LINES), (words.filter(pc.invert(apart)), self._one_by_one, 4096)):
            self.words = pa.concat_arrays([self.words, some])
            found += [encode(some.slice(k, most).to_pylist()) for k in range(0, len(some), most)]
        if found:
            size = np.concatenate([n for _, n in found])
            self.low = np.concatenate([self.low, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        lines = apart.to_numpy(zero_copy_only=False)
        return known + np.where(lines, np.cumsum(lines), lines.sum() + np.cumsum(~lines)) - 1

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (large strings, none null)."""
        whole = pc.match_substring_regex(texts, _WHOLE)
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        rest = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        if not len(rest):
            return out
        if len(self.words) > KEPT_WORDS:
            self.forget()
        cut = pc.replace_substring(pc.replace_substring(texts.take(pa.array(rest)), " ", _CUT + " "), "\n", f"{_CUT}\n{_CUT}")
        cut = pc.split_pattern(cut, _CUT)
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary
        slot = pc.index_in(distinct, value_set=self.words)
        fresh = slot.is_null()
        learned = self._learn(distinct.filter(fresh))
        slot = slot.fill_null(0).to_numpy().astype(np.int64)
        fresh = fresh.to_numpy(zero_copy_only=False)
        slot[fresh] = learned
        slots = slot[words.indices.to_numpy()]
        size = self.size[slots]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.low[slots] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.r_[0, ends][np.cumsum(np.r_[0, pc.list_value_length(cut).to_numpy()])]
        for k, i in enumerate(rest.tolist()):
            out[i] = ids[at[k] : at[k + 1]]
        return out


def pieces(docs: DataFrame, key: str, text: str, path: str, most: int = SEQUENCE, end: int = 0) -> DataFrame:
    """(key, piece, start, length, ids): each document's ids, then `end`, in pieces of `most`; the first may be shorter.

    ids is binary, unsigned 32-bit little-endian. A null text counts as empty: its one piece is `end` alone.
    """
    kind = docs.schema[key].dataType

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.large_string()).fill_null("")
            for low, high in runs(pc.utf8_length(texts).to_numpy(), AT_ONCE):
                row, piece, start, length, blobs = [], [], [], [], []
                for i, ids in enumerate(encode(texts.slice(low, high - low)), low):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    cuts = [0, *range(len(ids) % most or most, len(ids) + 1, most)] if len(ids) > most else [0, len(ids)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i), piece.append(k), start.append(a), length.append(b - a), blobs.append(ids[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blobs, pa.binary())], [key, "piece", "start", "length", "ids"])

    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

    to = StructType([StructField(key, kind), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())])
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(task, to)


def patterns(counts: dict[int, int], most: int = SEQUENCE) -> list[tuple[int, dict[int, int]]]:
    """[(repeats, {length: how many of it in one sequence})]; together they use every piece."""
    left = np.zeros(most + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    sizes = np.arange(most + 1)
    out = []
    while left.any():
        one, gap = {}, most

        def take(n: int, k: int = 1) -> None:
            nonlocal gap
            one[n] = one.get(n, 0) + k
            left[n] -= k
            gap -= n * k

        fits = np.flatnonzero(left[: gap + 1])
        while len(fits):
            take(int(fits[-1]), int(min(left[fits[-1]], gap // fits[-1])))
            fits = np.flatnonzero(left[: gap + 1])
        while gap:
            small = min(one)
            room = gap + small
            longest = np.maximum.accumulate(np.where(left > 0, sizes, 0))[: room + 1]  # at most that long, and there
            first = np.flatnonzero(left[: room + 1])
            first = first[first <= room // 2]
            second = longest[room - first] if len(first) else first
            alone = (second == first) & (left[first] < 2)  # one piece can't be both
            below = longest[np.maximum(first - 1, 0)]
            second = np.where(alone, below, second)
            good = (second > 0) & (first + second > small)
            if not good.any():
                break
            best = int(np.argmax(np.where(good, first + second, 0)))
            a, b = int(first[best]), int(second[best])
            one[small] -= 1
            left[small] += 1
            gap += small
            if not one[small]:
                del one[small]
            take(a)
            take(b)
        repeats = 1 + int(min(left[n] // k for n, k in one.items()))
        for n, k in one.items():
            left[n] -= k * (repeats - 1)
        out.append((repeats, one))
    return out


def places(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, each, sequence, offset): of the pieces of that length, ranks in [low, high) go, `each` a
    sequence, to the sequences from `sequence` on, from `offset` on."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for repeats, one in found:
        offset = 0
        for n, k in sorted(one.items(), reverse=True):
            low = rank.get(n, 0)
            rank[n] = low + repeats * k
            out.append((n, low, rank[n], k, sequence, offset))
            offset += n * k
        sequence += repeats
    return out


def pack(docs: DataFrame, key: str, text: str, path: str, most: int = SEQUENCE, end: int = 0, payload: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, piece, start, length, sequence_id, offset, payload): every piece and its place.

    payload says what of a piece's ids goes along (default: the ids themselves, binary as in pieces()). A document has
    a piece for each `most` ids and one for what is over, first. Null texts are one piece of one id, repeated rows
    are packed each, null keys are keys, other columns are dropped, and an empty table gives an empty table.
    """
    spark = docs.sparkSession
    held = payload(F.col("ids")) if payload else F.col("ids")
    cut = table(pieces(docs, key, text, path, most, end).select(key, "piece", "start", "length", held, F.monotonically_increasing_id().alias("_row")), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # `most` rows at most
    ranked = position_in_group(cut.select("length", "_row"), ["length"], [], "_row", "_rank", salts=16)
    # Each pattern uses up a length, or all but a part of it: at most most * log2(most) patterns, of 48 bytes a length.
    plan = spark.createDataFrame(places(patterns(counts, most)), "_length long, _low long, _high long, _each long, _sequence long, _offset long")
    put = ranked.join(F.broadcast(plan), (ranked["length"] == plan["_length"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    nth = F.col("_rank") - F.col("_low")
    put = put.select("_row", (F.col("_sequence") + F.floor(nth / F.col("_each")).cast("long")).alias("sequence_id"), (F.col("_offset") + (nth % F.col("_each")) * F.col("length")).alias("offset"))
    return cut.join(put, "_row").drop("_row")
