"""Problem 7: passages of evaluation items in a training corpus, by spaced-seed hashing.

Texts are brought to words that do not depend on case, punctuation, markup, line layout or look-alike characters. Fixed
masks select four of up to five running words; the hash covers the selected words only, so that a changed, added or
dropped word between them on either side leaves it as it was.

The documents are read once. A Bloom filter of the items' seeds, of bounded size, goes to that pass; only the surroundings
of seeds that it lets through are written. Their seeds are joined with those of the items on the hash, hot hashes being
split, and around each hit the passage is verified word by word, passing over single changed, added and dropped words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.llm.canon import canonical
from lexshift.tables import BROADCAST_BYTES, HOT_ROWS, spread_join
from lexshift.workdir import cut

#: Offsets of the words that a seed selects.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
#: Running words of an item that make a case, how many of them unchanged; wording of so many words in so many items does not count.
MIN_RUN, MIN_EQUAL, SHARED_WORDS, SHARED_ITEMS = 12, 9, 6, 3
#: Words on either side of a seed that go on to be verified. A passage that goes on beyond them without a seed is a case by the words within.
REACH = 48
#: The filter's bits for each seed of the items, and the power of two that it never exceeds (32 MB); hash functions.
SEED_BITS, MOST_BITS, LOOKS = 64, 28, 4
#: Characters of documents that are looked at together, words that are hashed together, words that a task remembers.
BATCH_CHARS, BATCH_WORDS, MEMORY = 2_000_000, 500_000, 1_000_000
#: Letters and how they are written without the accent.
FOLDED = {"ä": "ae", "æ": "ae", "ö": "oe", "œ": "oe", "ø": "oe", "ü": "ue", "å": "aa", "ß": "ss", "ſ": "s"}

_FOLD = str.maketrans(FOLDED)
_NOISE = re.compile(r"</?[A-Za-z!?][^<>]*>|\[\s*\d+\s*\]")
_BROKEN = re.compile(r"(?<=\w)[-¬] ?\n+(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The words of a text, levelled; words broken at a line's end are joined."""
    text = text or ""
    if "&" in text:
        text = html.unescape(text)
    text = canonical(text) or ""
    if "<" in text or "[" in text:
        text = _NOISE.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
        if not text.isascii():
            text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return _WORD.findall(text)


class Numbers(dict):
    """Words as whole numbers of 63 bits, by hash; remembers those met before."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word) >> 1
        return n

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def seeds(ids: np.ndarray, known: Filter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their places in an array of word numbers, those that ``known`` lets through; negative numbers are in no seed."""
    keys, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for start in range(0, len(ids), BATCH_WORDS):
        for mask in MASKS:
            n = min(len(ids) - mask[-1] - start, BATCH_WORDS)
            if n <= 0:
                continue
            good = np.ones(n, bool)
            h = np.zeros(n, np.uint64)
            for o in mask:
                part = ids[start + o : start + o + n]
                good &= part >= 0
                h = (h ^ part.view(np.uint64)) * _MIX
                h ^= h >> np.uint64(29)
            at = np.flatnonzero(good)
            if known is not None:
                at = at[known.holds(h[at])]
            keys.append(h[at])
            places.append(at + start)
    return np.concatenate(keys), np.concatenate(places)


class Filter:
    """A Bloom filter of hashes; its bits are in an array of 64-bit words."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots, self.power = slots, int(len(slots)).bit_length() + 5

    @staticmethod
    def power_for(count: int) -> int:
        return max(10, min(MOST_BITS, int(count * SEED_BITS - 1).bit_length()))

    @staticmethod
    def bits(keys: np.ndarray, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each hash function the slots and the bits in them."""
        h = keys
        for _ in range(LOOKS):
            at = h >> np.uint64(64 - power)
            yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            h = (h ^ (h >> np.uint64(31))) * _MIX

    def holds(self, keys: np.ndarray) -> np.ndarray:
        left, h = np.arange(len(keys)), keys
        for k in range(LOOKS):
            at = h >> np.uint64(64 - self.power)
            there = (self.slots[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
            left, h = left[there], h[there]
            if k + 1 < LOOKS:
                h = (h ^ (h >> np.uint64(31))) * _MIX
        return left


def grown(doc: list[int], item: list[int], k: int, j: int) -> tuple[int, int, int, int, int]:
    """The passage around the equal words ``doc[k]`` and ``item[j]``: its bounds in both, ends excluded, and its equal words.

    Of the ways past single edits, each followed by an equal word, the one with the most equal words counts.
    """

    def same(x: int, y: int) -> bool:
        return 0 <= x < len(doc) and 0 <= y < len(item) and doc[x] == item[y] >= 0

    def way(step: int) -> tuple[int, int, int]:
        # places to go on from, nearest first, each with the most equal words on a way to it; every edit stands between equal words
        most, ahead, best = {(k, j): 0}, [(0, k, j)], (0, 0, k, j)
        while ahead:
            _, a, b = heappop(ahead)
            equal = most[a, b]
            while same(a, b):
                equal, a, b = equal + 1, a + step, b + step
            best = max(best, (equal, abs(b - j), a - step, b - step))
            for x, y in ((step, step), (step, 0), (0, step)):  # one word changed, added, dropped
                to = a + x, b + y
                if same(*to) and most.get(to, -1) < equal:
                    if to not in most:
                        heappush(ahead, (abs(to[0] - k) + abs(to[1] - j), *to))
                    most[to] = equal
        return best[2], best[3], best[0]

    lo_k, lo_j, left = way(-1)
    hi_k, hi_j, right = way(1)
    return lo_k, hi_k + 1, lo_j, hi_j + 1, left + right - 1


def longest(doc: list[int], item: list[int], hits: list[tuple[int, int]]) -> int:
    """The most running words of the item around the hits (place in the text, in the item) that make a case, else 0."""
    best, done = 0, set()
    for k, j in sorted(set(hits)):
        if (k, j) in done or not doc[k] == item[j] >= 0:
            continue
        lo_k, hi_k, lo_j, hi_j, equal = grown(doc, item, k, j)
        if hi_k - lo_k == hi_j - lo_j:
            done.update(zip(range(lo_k, hi_k), range(lo_j, hi_j), strict=True))
        if hi_j - lo_j >= MIN_RUN and equal >= MIN_EQUAL:
            best = max(best, hi_j - lo_j)
    return best


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, kind))


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, words, shared`` of each item; shared: places of wording that SHARED_ITEMS or more items have."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(words)

    ws = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL").dropDuplicates(["item_id"]).select("item_id", split("text").alias("words"))
    n = SHARED_WORDS
    grams = ws.select("item_id", F.posexplode(F.expr(f"transform(sequence(1, greatest(1, size(words) - {n - 1})), i -> xxhash64(array_join(slice(words, i, {n}), ' ')))")).alias("at", "gram"), F.size("words").alias("size")).where(f"size >= {n}")
    common = grams.groupBy("gram").agg(F.count_distinct("item_id").alias("items")).where(F.col("items") >= SHARED_ITEMS)
    places = grams.join(common, "gram").groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + n - 1))))).alias("shared"))
    return ws.join(places, "item_id", "left").select("item_id", "words", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))


def numbered(known: DataFrame) -> DataFrame:
    """``item_id, words`` with words as numbers, -2 where wording is shared."""
    shape = known.select("item_id").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ", 1) + ", words array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Numbers()
        for b in batches:
            made = []
            for ws, shared in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                numbers = memory.of(ws)
                numbers[np.array(shared, np.int64)] = -2
                made.append(numbers)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(made, pa.int64())], names=["item_id", "words"])

    return known.select("item_id", "words", "shared").mapInArrow(run, shape)


def item_seeds(items: DataFrame) -> DataFrame:
    """``item_id, key, at``: the seeds of numbered items and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, places = seeds(np.array(b.column(1)[i].values, np.int64))
                owner = b.column(0).take(pa.array(np.full(len(keys), i)))
                yield pa.RecordBatch.from_arrays([owner, pa.array(keys.view(np.int64)), pa.array(places, pa.int32())], names=["item_id", "key", "at"])

    return items.select("item_id", "words").mapInArrow(run, "item_id " + items.schema["item_id"].dataType.simpleString() + ", key bigint, at int")


def filter_of(seeds: DataFrame) -> Filter:
    """The filter of all seeds, at most 2 ** MOST_BITS bits; what comes to the driver are its slots."""
    power = Filter.power_for(seeds.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slots, bits in Filter.bits(b.column(0).to_numpy().view(np.uint64), power):
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    got = seeds.select("key").mapInArrow(run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots = np.zeros(1 << (power - 6), np.uint64)
    slots[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Filter(slots)


def surroundings(texts: list[str | None], known: Filter, memory: Numbers) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Around the seeds of the texts that the filter lets through: the text's number, the words, and the seeds with their places in these.

    Places closer than twice REACH share one stretch, so each seed has REACH words on either side, or those the text has.
    """
    gap = np.full(REACH, -1)
    docs = [memory.of(words(t)) for t in texts]
    if not docs:
        return
    flat = np.concatenate([x for d in docs for x in (d, gap)])
    starts = np.cumsum([0, *(len(d) + REACH for d in docs)])
    keys, places = seeds(flat, known)
    order = np.argsort(places, kind="stable")
    keys, places = keys[order], places[order]
    of = np.searchsorted(starts, places, "right") - 1
    cuts = np.flatnonzero((np.diff(places) > 2 * REACH) | (np.diff(of) > 0)) + 1
    for ks, ps, n in zip(np.split(keys, cuts), np.split(places, cuts), np.split(of, cuts), strict=True):
        if len(ks):
            a, b = starts[n[0]], starts[n[0] + 1] - REACH
            low = max(a, ps[0] - REACH)
            yield int(n[0]), flat[low : min(b, ps[-1] + REACH + MASKS[0][-1] + 2)], ks.view(np.int64), ps - low


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices whose texts (second column) have about BATCH_CHARS characters, or a single row with more."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + BATCH_CHARS, "right")))
            yield b.slice(at, to - at)
            at = to


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, item_id, run``: the documents that hold at least MIN_RUN running words of an item, and the longest run.

    Every document is its own case, copies too; repeated rows of one document id count once, as do those of an item.
    NULL, empty and blank texts match nothing, very long ones are searched whole, an empty table gives no rows; only the
    named columns are read, so others cannot clash. A run is followed at most REACH words beyond its outermost seed.
    However many items there are, the documents are read once and the driver holds the slots of the filter only.
    """
    known = cut(numbered(item_words(items, item_id, item_text)))
    own = cut(item_seeds(known))
    sieve = documents.sparkSession.sparkContext.broadcast(filter_of(own).slots)
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{doc_text}`").alias("text")).where("text IS NOT NULL")
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), known.schema["item_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, memory, made = Filter(sieve.value), Numbers(), TaskContext.get().partitionId() << 40  # numbers of stretches
        for b in _batches(batches):
            got = list(surroundings(b.column(1).to_pylist(), passed, memory))
            if got:
                n, ws, ks, ps = zip(*got, strict=True)
                columns = [pa.array(np.arange(made, made + len(n))), b.column(0).take(pa.array(n)), _lists(list(ws), pa.int64()), _lists(list(ks), pa.int64()), _lists(list(ps), pa.int32())]
                made += len(n)
                yield pa.RecordBatch.from_arrays(columns, names=["stretch", "doc_id", "doc_words", "keys", "places"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            doc, item, places, ats = (b.column(i).to_pylist() for i in range(2, 6))
            runs = np.array([longest(d, i, list(zip(p, a, strict=True))) for d, i, p, a in zip(doc, item, places, ats, strict=True)], np.int32)
            good = np.flatnonzero(runs)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), b.column(1).take(pa.array(good)), pa.array(runs[good])], names=["doc_id", "item_id", "run"])

    found = cut(docs.mapInArrow(look, f"stretch bigint, doc_id {doc_type}, doc_words array<bigint>, keys array<bigint>, places array<int>"))
    hits = found.select("stretch", F.explode(F.arrays_zip("keys", "places")).alias("hit")).select("stretch", "hit.keys", "hit.places").toDF("stretch", "key", "place")
    both = spread_join(hits, own, "key", broadcast_bytes, hot_rows).groupBy("stretch", "item_id").agg(F.collect_list(F.struct("place", "at")).alias("hits"))
    texts = both.join(found.select("stretch", "doc_id", "doc_words"), "stretch")
    full = spread_join(texts, known, "item_id", broadcast_bytes, hot_rows).select("doc_id", "item_id", "doc_words", "words", "hits.place", "hits.at")
    return full.mapInArrow(verify, f"doc_id {doc_type}, item_id {item_type}, run int").groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
