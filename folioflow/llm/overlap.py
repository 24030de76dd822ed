"""Problem 1: records of evaluation splits that stand, the same or almost, in the training split.

Evaluation records are held in compressed full-text indexes (the Burrows-Wheeler transform of their words), built once
a shard. Training records stream through backward search with a few of their segments as seeds: more disjoint segments
than edits are allowed, so that every partner holds one of them unchanged. The places of the seeds give candidates, whose
maximal matches are merged into spans and counted; a word alignment decides about what is left.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut, require, tasks

#: One word in so many may be changed, added or dropped.
ONE_IN = 6
#: Words of a seed, at least and at most; records of one word have that word.
SEED = (2, 6)
#: Matches of at least so many words count as matched text.
SPAN = 3
#: Words per shard of the evaluation index, and training records per task and shard.
SHARD_WORDS, BLOCK_ROWS = 100_000, 20_000
#: Counters of the sketch of evaluation windows, at most (two bytes each). It only ranks seeds: any choice finds all partners.
MOST_COUNTERS = 1 << 24

_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]+;|&#\d+;")
_INVISIBLE = re.compile("[­​-‏⁠﻿̀-ͯ]")
_PLACES_AT_ONCE, _PAIRS_AT_ONCE = 2_000_000, 4_096


def words_of(text: str | None) -> list[str]:
    """Words of a text without case, spacing, punctuation, markup and character form."""
    t = unicodedata.normalize("NFKD", _MARKUP.sub(" ", text or "")).casefold()
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", t.replace("’", "'")).replace("ё", "е"))
    return re.findall(r"[^\W_]+", t)


def most_edits(n: int) -> int:
    """Edits that a record of n words allows towards any partner: a partner has up to most_edits words more."""
    return n // (ONE_IN - 1)


def window_hashes(flat: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per window length: a hash for every place of the records laid end to end, and whether a window starts there.

    Windows of one word count in records of one word only.
    """
    n = len(flat)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    words, out = flat.view(np.uint64), {}
    with np.errstate(over="ignore"):
        h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
        for k in range(1, SEED[1] + 1):
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.concatenate([words[k - 1 :], np.zeros(min(k - 1, n), np.uint64)])
            if k == 1 or k >= SEED[0]:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                ok = (left >= k) if k > 1 else np.repeat(sizes == 1, sizes)
                out[k] = ((mixed ^ (mixed >> np.uint64(32))).view(np.int64), ok)
    return out


def choose_seeds(flat: np.ndarray, sizes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Record number, start, length and hash of most_edits + 1 disjoint windows of every record that are rarest together.

    The sketch never counts too few, so that seeds it counts 0 times stand nowhere; they are left out.
    """
    hashes = window_hashes(flat, sizes)
    mask = np.int64(len(sketch) - 1)
    begins = np.cumsum(sizes) - sizes
    parts: list[tuple[np.ndarray, ...]] = []
    by_size = np.argsort(sizes, kind="stable")
    by_size = by_size[sizes[by_size] > 0]
    for at in range(0, len(by_size), 512):
        rows = by_size[at : at + 512]
        n = sizes[rows]
        want = n // (ONE_IN - 1) + 1
        longest, most, b = int(n.max()), int(want.max()), len(rows)
        place = np.minimum(begins[rows][:, None] + np.arange(longest), len(flat) - 1)
        inside = np.arange(longest) < n[:, None]
        costs = {k: np.where(inside & ok[place], sketch[h[place] & mask].astype(np.float32), np.inf) for k, (h, ok) in hashes.items()}
        best = np.full((longest + 1, b, most + 1), np.inf, np.float32)
        best[:, :, 0] = 0
        chosen = np.zeros((longest + 1, b, most + 1), np.int8)
        for i in range(1, longest + 1):
            best[i] = np.minimum(best[i], best[i - 1])
            for k, c in costs.items():
                if k <= i:
                    new = best[i - k][:, :-1] + c[:, i - k, None]
                    better = new < best[i][:, 1:]
                    best[i][:, 1:][better] = new[better]
                    chosen[i][:, 1:][better] = k
        end, open_, who = n.copy(), want.copy(), np.arange(b)
        while (open_ > 0).any():
            k = np.where(open_ > 0, chosen[end, who, open_], 0)
            take = k > 0
            start = end - k
            parts.append((rows[take], start[take], k[take].astype(np.int64)))
            end = np.where(take, start, np.maximum(end - 1, 0))
            open_ = open_ - take
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    row, start, k = (np.concatenate(x) for x in zip(*parts, strict=True))
    where = begins[row] + start
    h = np.zeros(len(row), np.int64)
    for length, (values, _) in hashes.items():
        h[k == length] = values[where[k == length]]
    met = sketch[h & mask] > 0
    return row[met], start[met], k[met], h[met]


class TextIndex:
    """Full-text index of a shard: the transform of its words and the words' numbers; all else follows from the transform.

    Words are numbered from 1, every record ends in a stop numbered 0, and stops sort by their place.
    """

    def __init__(self, transform: np.ndarray, vocabulary: np.ndarray, records: int) -> None:
        self.vocabulary, n = vocabulary, len(transform)
        order = np.argsort(transform, kind="stable")
        self.n, self.keys = n, transform[order].astype(np.int64) * (n + 1) + order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(transform, minlength=len(vocabulary) + 1))])
        before = np.empty(n, np.int64)
        before[order] = np.arange(n)
        # all records are read from their stops backwards at once
        self.record, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
        rows, who, read, step = np.arange(records), np.arange(records), [], 0
        self.record[:records] = who
        self.sizes = np.zeros(records, np.int64)
        while len(rows):
            w = transform[rows]
            rows, who, w = before[rows][w > 0], who[w > 0], w[w > 0]
            step += 1
            self.record[rows], back[rows] = who, step
            self.sizes[who] = step
            read.append((who, w))
        self.place = self.sizes[self.record] - back
        self.texts = np.full((records, int(self.sizes.max(initial=0))), -2, np.int32)
        for step, (who, w) in enumerate(read, 1):
            self.texts[who, self.sizes[who] - step] = w

    @staticmethod
    def build(records: list[np.ndarray]) -> TextIndex:
        return TextIndex(*TextIndex.transform(records), len(records))

    @staticmethod
    def transform(records: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The transform and the sorted vocabulary of records of hashed words."""
        sizes = np.array([len(r) for r in records], np.int64)
        flat = np.concatenate([*records, np.zeros(0, np.int64)]).astype(np.int64)
        vocabulary, number = np.unique(flat, return_inverse=True)
        n = len(flat) + len(records)
        stops = np.cumsum(sizes + 1) - 1
        s = np.zeros(n, np.int64)
        s[np.setdiff1d(np.arange(n), stops, assume_unique=True)] = number + 1
        # suffix order by doubling; stops differ, so that no match crosses a record's end
        rank = np.unique(np.where(s == 0, np.arange(n) - n, s), return_inverse=True)[1].astype(np.int64)
        k = 1
        while n and rank.max() < n - 1:
            after = np.full(n, -1, np.int64)
            after[: n - k] = rank[k:]
            rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
            k *= 2
        return (s[np.argsort(rank) - 1] if n else s).astype(np.uint32), vocabulary

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of hashed words; words the shard lacks are -1."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def _rank(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each word before each row of the transform."""
        return np.searchsorted(self.keys, word * (self.n + 1) + at) - self.first[word]

    def backward(self, words: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search for many windows of a text of numbered words at once: the row interval of each, empty where it is absent."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        live = np.arange(len(ends))
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= step) & (hi[live] > lo[live])]
            w = words[ends[live] - step]
            hi[live[w < 0]] = lo[live[w < 0]]
            live, w = live[w > 0], w[w > 0]
            a = self.first[w] + self._rank(w, lo[live])
            b = self.first[w] + self._rank(w, hi[live])
            lo[live], hi[live] = a, b
        return lo, hi

    def candidates(self, words: np.ndarray, sizes: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a record whose sizes are close and that share enough seeds at close places.

        words are the queries' numbered words laid end to end; owner, start and length are their seeds. Of most_edits + 1
        seeds of a query, a partner breaks at most as many as the pair allows edits.
        """
        begins = np.cumsum(sizes) - sizes
        lo, hi = self.backward(words, begins[owner] + start + length, length)
        count = hi - lo
        some = np.flatnonzero(count)
        found: list[np.ndarray] = []
        upto = np.cumsum(count[some])
        for a, b in _chunks(upto, _PLACES_AT_ONCE):
            pick = some[a:b]
            seed = np.repeat(pick, count[pick])
            row = np.arange(len(seed)) - np.repeat(np.cumsum(count[pick]) - count[pick], count[pick]) + lo[seed]
            record, query = self.record[row], owner[seed]
            allowed = np.maximum(sizes[query], self.sizes[record]) // ONE_IN
            near = (np.abs(self.place[row] - start[seed]) <= allowed) & (np.abs(sizes[query] - self.sizes[record]) <= allowed)
            found.append(np.unique(np.stack([query[near], record[near], seed[near]], 1), axis=0))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, shared = np.unique(np.unique(np.concatenate(found), axis=0)[:, :2], axis=0, return_counts=True)
        n = sizes[pairs[:, 0]]
        allowed = np.maximum(n, self.sizes[pairs[:, 1]]) // ONE_IN
        enough = shared >= n // (ONE_IN - 1) + 1 - allowed
        return pairs[enough, 0], pairs[enough, 1]

    def search(self, words: np.ndarray, sizes: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> pd.DataFrame:
        """query, record, edits and matched share of all pairs within the allowed edits."""
        numbered = self.numbers(words).astype(np.int32)
        query, record = self.candidates(numbered, sizes, owner, start, length)
        begins = np.cumsum(sizes) - sizes
        out = []
        by_size = np.argsort(sizes[query], kind="stable")
        for at in range(0, len(by_size), _PAIRS_AT_ONCE):
            q, r = query[by_size[at : at + _PAIRS_AT_ONCE]], record[by_size[at : at + _PAIRS_AT_ONCE]]
            n, m = sizes[q], self.sizes[r]
            wide = np.arange(int(n.max()))
            a = np.where(wide < n[:, None], numbered[np.minimum(begins[q][:, None] + wide, len(numbered) - 1)], -1)
            b = self.texts[r][:, : int(m.max())]
            allowed = np.maximum(n, m) // ONE_IN
            covered, spanned = merged_matches(a, b, n, allowed)
            keep = covered >= n - allowed
            if keep.any():
                edits = aligned(a[keep], b[keep], n[keep], m[keep], allowed[keep])
                out.append(pd.DataFrame({"query": q[keep], "record": r[keep], "edits": edits, "matched": spanned[keep] / n[keep]})[edits <= allowed[keep]])
        return pd.concat(out) if out else pd.DataFrame({"query": [], "record": [], "edits": [], "matched": []})


def _chunks(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes, given by their running sum, add up to about `most`."""
    a = 0
    while a < len(upto):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + most, "right")))
        yield a, b
        a = b


def merged_matches(a: np.ndarray, b: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a in any maximal match with b shifted by at most the allowed edits, and those in matches of SPAN words or more
    (in texts shorter than that, in any).

    Matches of all shifts are merged before they are counted. A pair within its edits has all but so many words in them.
    """
    wide = a.shape[1]
    k = int(allowed.max(initial=0))
    framed = np.full((len(b), wide + 2 * k), -3, np.int32)
    framed[:, k : k + min(b.shape[1], wide + k)] = b[:, : wide + k]
    some, spans = np.zeros(a.shape, bool), np.zeros(a.shape, bool)
    for shift in range(-k, k + 1):
        equal = (a == framed[:, k + shift : k + shift + wide]) & (a > 0) & (abs(shift) <= allowed)[:, None]
        some |= equal
        if wide >= SPAN:
            run = equal[:, : wide - SPAN + 1].copy()
            for i in range(1, SPAN):
                run &= equal[:, i : wide - SPAN + 1 + i]
            for i in range(SPAN):
                spans[:, i : wide - SPAN + 1 + i] |= run
    return some.sum(1), np.where(n < SPAN, some.sum(1), spans.sum(1))


def aligned(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Word edits of all pairs at once, in a band around the diagonal; more than allowed where a pair leaves the band."""
    k = int(allowed.max(initial=0))
    shifts = np.arange(-k, k + 1, dtype=np.int32)
    big = np.int32(1 << 20)
    framed = np.full((len(b), a.shape[1] + 2 * k + 1), -3, np.int32)
    framed[:, k : k + min(b.shape[1], a.shape[1] + k + 1)] = b[:, : a.shape[1] + k + 1]
    row = np.broadcast_to(np.where(shifts >= 0, shifts, big), (len(a), 2 * k + 1)).astype(np.int32)
    result = np.full(len(a), big, np.int32)
    for i in range(a.shape[1] + 1):
        if i:
            same = a[:, i - 1, None] != framed[:, i - 1 : i + 2 * k]
            new = row + same
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            new[:, shifts + i < 0] = big
            if 0 <= k - i:
                new[:, k - i] = i
            row = np.minimum.accumulate(new - shifts, axis=1) + shifts
        done = np.flatnonzero(n == i)
        if len(done):
            at = np.clip(m[done] - i + k, 0, 2 * k)
            result[done] = np.where(np.abs(m[done] - i) <= k, row[done, at], big)
    return result


def edits_within(a: list, b: list, most: int) -> int | None:
    """Word edits between two records if at most `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] if row[-1] <= most else None


def representatives(lines: DataFrame) -> DataFrame:
    """line_id, split, source and the folded words of user and assistant contents, with the key of equal ones.

    System turns say nothing and are left out; a line without words has the key of the empty text and no partner.
    """
    require(lines, "line_id", "split", "source", "messages")
    said = F.filter("messages", lambda m: m["role"].isNull() | (m["role"] != "system"))
    text = F.array_join(F.transform(said, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")

    def fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([" ".join(words_of(t)) for t in b.to_pylist()], pa.string())

    folded = lines.select("line_id", "split", "source", F.arrow_udf(fold, "string")(F.coalesce(text, F.lit(""))).alias("folded"))
    return folded.withColumn("key", F.xxhash64("folded"))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _record_windows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Record number and hash of all windows that can be seeds."""
    flat, sizes = _flat(lists)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    got = [(owner[ok], h[ok]) for h, ok in window_hashes(flat, sizes).values()]
    who, h = (np.concatenate(x) for x in zip(*got, strict=True))
    return who, h


def _counters(places: DataFrame, counters: int) -> np.ndarray:
    """Sums of n by place, for places below `counters` (a power of two, MOST_COUNTERS at most), each at most 65,535."""
    slice_ = 1 << 16

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(slice_, np.uint16)
        out[rows["at"].to_numpy() % slice_] = np.minimum(rows["n"].to_numpy(), 65_535)
        return pd.DataFrame({"slice": [int(rows["at"].iloc[0]) // slice_], "counts": [zlib.compress(out.tobytes(), 1)]})

    counted = places.groupBy("at").agg(F.sum("n").alias("n"))
    packed = counted.groupBy((F.col("at") / slice_).cast("int").alias("slice")).applyInPandas(pack, "slice int, counts binary")
    sums = np.zeros(counters, np.uint16)
    for r in packed.collect():  # at most MOST_COUNTERS / 65,536 rows
        sums[r["slice"] * slice_ : (r["slice"] + 1) * slice_] = np.frombuffer(zlib.decompress(r["counts"]), np.uint16)[: counters - r["slice"] * slice_]
    return sums


_SEEDED = "key bigint, words array<bigint>, starts array<int>, lengths array<int>, hashes array<bigint>"
_INDEX = "shard int, records int, transform binary, vocabulary binary, keys binary"


def overlaps(lines: DataFrame, left: str = "train") -> DataFrame:
    """Pairs of a text of the split `left` and a text of another split that are equal but for one word in ONE_IN.

    Columns: left_key and right_key (keys of equal texts; members are in representatives()), edits, and matched, the share
    of the left text's words in merged matches of SPAN words or more. Equal texts are one text each, so groups of copies of
    any size cost one row. A training text visits only the shards that hold one of its seeds, which are chosen as the
    rarest by a sketch of bounded size, so that common phrases neither route nor make candidates where a text has anything
    rarer; shards visited by many are worked on in blocks, each with the index built before. Texts without words and
    lines without a split have no partner. Words are compared by 64-bit hashes.
    """
    reps = lines if "folded" in lines.columns else representatives(lines)
    spark = reps.sparkSession
    texts = reps.filter("folded <> '' AND split IS NOT NULL").groupBy("key", (F.col("split") == left).alias("is_left")).agg(F.min("folded").alias("folded"))
    texts = cut(texts.select("key", "is_left", F.transform(F.split("folded", " "), lambda w: F.xxhash64(w)).alias("words")))
    right = texts.filter("NOT is_left").drop("is_left")
    size = right.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_WORDS))
    right = right.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))

    def build(held: pd.DataFrame) -> pd.DataFrame:
        transform, vocabulary = TextIndex.transform([np.asarray(w) for w in held["words"]])
        pack = lambda x: zlib.compress(x.tobytes(), 6)
        return pd.DataFrame({"shard": [held["shard"].iloc[0]], "records": [len(held)], "transform": [pack(transform)], "vocabulary": [pack(vocabulary)], "keys": [held["key"].to_numpy().tobytes()]})

    index = cut(right.repartition(tasks(spark, min(shards, 1000)), "shard").groupBy("shard").applyInPandas(build, _INDEX))
    counters = min(MOST_COUNTERS, 1 << max(16, int(size * (SEED[1] - SEED[0] + 1)).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = np.unique(_record_windows(b.column("words"))[1] & np.int64(counters - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    sketch = spark.sparkContext.broadcast(_counters(right.select("words").mapInArrow(count, "at bigint, n bigint"), counters))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = _flat(b.column("words"))
            row, start, length, h = choose_seeds(flat, sizes, sketch.value)
            by = np.argsort(row, kind="stable")
            n = np.bincount(row, minlength=len(sizes))
            cols = [b.column("key"), b.column("words"), _lists(start[by].astype(np.int32), n), _lists(length[by].astype(np.int32), n), _lists(h[by], n)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "words", "starts", "lengths", "hashes"]).filter(pa.array(n > 0))

    mine = cut(texts.filter("is_left").drop("is_left").mapInArrow(seed, _SEEDED))
    asked = mine.select("key", F.explode("hashes").alias("h"))
    places = asked.select(F.col("h").bitwiseAND(F.lit(counters - 1)).alias("at"), F.lit(1).alias("n"))
    wanted = spark.sparkContext.broadcast(np.packbits(_counters(places, counters) > 0))

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # windows that no seed asks for are left out before they are shuffled
        for b in batches:
            who, h = _record_windows(b.column("words"))
            at = h & np.int64(counters - 1)
            met = (wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([b.column("shard").take(pa.array(who[met])), pa.array(h[met])], ["shard", "h"])

    windows = right.select("shard", "words").mapInArrow(stand, "shard int, h bigint").distinct()
    routes = asked.join(windows, "h").select("key", "shard").distinct()
    routes = cut(routes)
    blocks = routes.groupBy("shard").agg(F.count("*").alias("rows")).select("shard", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    visits = routes.join(mine.drop("hashes"), "key").join(blocks, "shard")
    visits = visits.select("shard", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "words", "starts", "lengths")
    held = index.join(blocks, "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).drop("blocks")
    held = held.select(*[F.col(c).alias(c) for c in held.columns])  # columns of their own for the cogroup

    def search(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: [] for c in ("left_key", "right_key", "edits", "matched")})
        if not len(queries) or not len(held):
            return none
        h = held.iloc[0]
        unpack = lambda x, kind: np.frombuffer(zlib.decompress(x), kind)
        index = TextIndex(unpack(h["transform"], np.uint32), unpack(h["vocabulary"], np.int64), int(h["records"]))
        sizes = queries["words"].map(len).to_numpy()
        n = queries["starts"].map(len).to_numpy()
        join = lambda c: np.concatenate(list(queries[c])).astype(np.int64)
        got = index.search(join("words"), sizes, np.repeat(np.arange(len(n)), n), join("starts"), join("lengths"))
        if not len(got):
            return none
        keys = np.frombuffer(h["keys"], np.int64)
        return pd.DataFrame({"left_key": queries["key"].to_numpy()[got["query"].astype(int)], "right_key": keys[got["record"].astype(int)], "edits": got["edits"], "matched": got["matched"]})

    n = tasks(spark)
    grouped = visits.repartition(n, "shard", "block").groupBy("shard", "block").cogroup(held.repartition(n, "shard", "block").groupBy("shard", "block"))
    return grouped.applyInPandas(search, "left_key bigint, right_key bigint, edits int, matched double")


def pairs(lines: DataFrame, left: str = "train") -> DataFrame:
    """All overlapping pairs of line ids, the smaller first, with both splits and sources."""
    reps = cut(representatives(lines))
    found = overlaps(reps, left)
    of_left = reps.filter(F.col("split") == left).select(F.col("key").alias("left_key"), F.col("line_id").alias("x"))
    of_right = reps.filter(F.col("split") != left).select(F.col("key").alias("right_key"), F.col("line_id").alias("y"), "split", "source")
    both = found.join(of_left, "left_key").join(of_right, "right_key")
    return both.select(F.least("x", "y").alias("line_a"), F.greatest("x", "y").alias("line_b"), "split", "source", "edits", "matched")


def report(lines: DataFrame, left: str = "train") -> DataFrame:
    """Per split and source: lines, lines with a partner in `left`, those with an equal one, and the mean matched share of partners."""
    reps = cut(representatives(lines))
    found = overlaps(reps, left).groupBy(F.col("right_key").alias("key")).agg(F.min("edits").alias("edits"), F.max("matched").alias("matched"))
    rows = reps.filter(F.col("split") != left).join(found, "key", "left")
    return rows.groupBy("split", "source").agg(
        F.count("*").alias("lines"),
        F.count("edits").alias("overlapping"),
        F.count_if(F.col("edits") == 0).alias("equal"),
        F.avg("matched").alias("mean_matched"),
    )
