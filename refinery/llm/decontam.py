"""Benchmark decontamination with SimHash over item-sized windows.

Every text is a sequence of word hashes. Items fall into length classes, and
for each class all windows of that many words, one at every word, get a 64-bit
SimHash from running sums of their words' bits. An item is represented by the
first words of its class's size. A multi-index finds all windows within
``radius`` bits: of four 16-bit blocks at least one differs in ``radius // 4``
bits or fewer, and the index has every such variant of every item. Words put in or
left out move a window beyond the radius; so each text and item are also
candidates if the text has one of the item's rarest shingles, as many as
weigh more than a fifth of the item: no window without one reaches 0.8.
Candidates are then verified exactly: five-word shingles, counted with repeats
and weighted by rarity among the items, must have a weighted Jaccard similarity
of 0.8 or more with some window, of whatever length. The best window begins and
ends with a shingle of the item, since others at its ends only lower it.

Documents are never shuffled. The items' index goes to every task; it is made for at
most ``MOST_ITEMS`` items and ``MOST_BYTES`` bytes at a time, counted
beforehand. A larger benchmark is scanned in several parts by item hash, each
within the bounds.

Defined results: letters and digits make words, all else parts them, case is ignored; texts and
items that are null or have no words match nothing; items shorter than five
words are one shingle, so they match only whole; repeated rows each
give their own rows, repeated items (equal id and text) count once; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import roll, tune
from .simhash import ball
from .words import word_hashes

SHINGLE = 5
MOST_ITEMS, MOST_BYTES = 20_000, 16_000_000
#: Window starts that are fingerprinted at a time.
CHUNK = 1 << 14


def window_prints(h: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first start, SimHash of every window from there on for each size), some ``CHUNK`` starts at a time.

    Windows run across text ends, which callers check. The bits of a word are 64 bytes, seen as eight
    integers: a window's sums are differences of running sums, exact in each byte below 256 words.
    """
    longest = max(sizes)
    for at in range(0, max(1, len(h) - min(sizes) + 1), CHUNK):
        part = np.ascontiguousarray(h[at : at + CHUNK + longest - 1])
        bits = np.unpackbits(part.view(np.uint8)).reshape(-1, 64)
        narrow = np.zeros((len(part) + 1, 8), np.uint64)
        np.cumsum(bits.view(np.uint64), axis=0, out=narrow[1:])
        wide = None
        out = []
        for size in sizes:
            n = min(CHUNK, len(part) - size + 1)
            if n <= 0:
                out.append(np.zeros(0, np.uint64))
            elif size < 256:
                most = (narrow[size : size + n] - narrow[:n]).view(np.uint8) > size // 2
                out.append(np.packbits(most.ravel()).view(np.uint64))
            else:
                if wide is None:
                    wide = np.zeros((len(part) + 1, 64), np.int32)
                    np.cumsum(bits, axis=0, dtype=np.int32, out=wide[1:])
                out.append(np.packbits(((wide[size : size + n] - wide[:n]) > size // 2).ravel()).view(np.uint64))
        yield at, out


def class_sizes(longest: int, ratio: float = 1.25) -> list[int]:
    out = [1]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


class Index:
    """The items: their words, weighted shingles and, for each class, the multi-index of fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int, least: float = 0.8):
        self.radius = radius
        h, row = word_hashes(pa.array([t for _, t in items], pa.string()))
        cuts = np.searchsorted(row, np.arange(len(items) + 1))
        self.words = [h[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.ids = [i for i, _ in items]
        bags = [Counter(shingles(w).tolist()) for w in self.words]
        seen = Counter(s for b in bags for s in b)
        some = sum(bool(b) for b in bags)
        self.rare = 1.0 + math.log(max(1, some))
        self.weight = {s: 1.0 + math.log(some / n) for s, n in seen.items()}
        self.bags = bags
        self.full = np.array([sum(n * self.weight[s] for s, n in b.items()) for b in bags])
        self.length = np.array([len(w) for w in self.words])
        self.known = np.sort(np.fromiter(self.weight, np.uint64, len(self.weight)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.intp)] = True
        self.known_weight = np.array([self.weight[int(s)] for s in self.known])
        self.kinds = [np.sort(np.fromiter(b, np.uint64, len(b))) for b in bags]
        rarest, owners = [], []
        for i, b in enumerate(bags):
            over = (1 - least) * self.full[i] + 1e-9
            for s in sorted(b, key=lambda s: (-self.weight[s], s)) if len(self.words[i]) >= SHINGLE else ():
                rarest.append(s)
                owners.append(i)
                over -= b[s] * self.weight[s]
                if over < 0:
                    break
        spot = np.searchsorted(self.known, np.array(rarest, np.uint64))
        order = np.argsort(spot, kind="stable")
        self.rarest = np.searchsorted(spot[order], np.arange(len(self.known) + 1))
        self.rarest_owner = np.array(owners, np.int64)[order]
        sizes = class_sizes(max(map(len, self.words), default=1))
        members = defaultdict(list)
        for i, w in enumerate(self.words):
            if len(w):
                members[max(s for s in sizes if s <= len(w))].append(i)
        masks = ball(radius // 4, 16).astype(np.int64)
        self.classes = []
        for size, which in sorted(members.items()):
            prints = np.array([next(window_prints(self.words[i][:size], [size]))[1][0][0] for i in which], np.uint64)
            blocks = []
            for b in range(4):
                keys = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                variants = (keys[:, None] ^ masks[None, :]).ravel()
                owners = np.repeat(np.arange(len(which)), len(masks))
                order = np.argsort(variants, kind="stable")
                starts = np.searchsorted(variants[order], np.arange(65537))
                blocks.append((np.diff(starts) > 0, starts, owners[order]))
            self.classes.append((size, np.array(which), prints, blocks))


def shingles(w: np.ndarray) -> np.ndarray:
    """Hashes of five-word shingles; all words as one shingle if they are fewer."""
    if not len(w):
        return np.zeros(0, np.uint64)
    return roll(w, min(SHINGLE, len(w))) ^ np.uint64(len(w) if len(w) < SHINGLE else 0)


def similarity(index: Index, item: int, window: np.ndarray) -> float:
    """Weighted Jaccard similarity of the two bags of shingles."""
    bag, other = index.bags[item], Counter(shingles(window).tolist())
    weight = lambda s: index.weight.get(s, index.rare)
    common = sum(min(n, other[s]) * weight(s) for s, n in bag.items() if s in other)
    return float(common / (index.full[item] + sum(n * weight(s) for s, n in other.items()) - common))


def best_window(index: Index, item: int, grams: np.ndarray, at: np.ndarray, total: np.ndarray, least: float) -> tuple[int, int] | None:
    """First and last shingle of the most similar window, the first of equals; none under ``least``.

    ``at``: where the text has shingles that items have; ``total``: running sums of all shingles' weights.
    """
    kinds, bag, full = index.kinds[item], index.bags[item], index.full[item]
    spot = np.minimum(np.searchsorted(kinds, grams[at]), len(kinds) - 1)
    at = at[kinds[spot] == grams[at]]
    if not len(at):
        return None
    names = grams[at].tolist()
    weights = [index.weight[s] for s in names]
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    # common <= full and common >= least x (full + window - common): a window weighs full / least at most
    stop = np.searchsorted(total[at + 1], total[at] + full / least + 1e-6, "right")
    low = least * full - 1e-6
    best, where = least - 1e-9, None
    ends = total[at + 1].tolist()
    for i in np.flatnonzero(sums[stop] - sums[np.arange(len(at))] >= low).tolist():
        have: dict[int, int] = {}
        common, begin = 0.0, float(total[at[i]])
        for j in range(i, int(stop[i])):
            s = names[j]
            have[s] = n = have.get(s, 0) + 1
            if n > bag[s]:
                continue
            common += weights[j]
            if common >= low and (like := common / (full + ends[j] - begin - common)) > best + 1e-9 * (where is not None):
                best, where = like, (int(at[i]), int(at[j]))
        if best >= 1.0 - 1e-9:
            break
    return where


def find(index: Index, h: np.ndarray, row: np.ndarray, least: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(text, item, similarity, bits that differ, first word, words) of the best window of each text and item."""
    if not len(h) or not index.classes:
        return
    first = np.searchsorted(row, np.arange(row[-1] + 2))
    # shingles that items have: where they are, and their weights summed up to each word
    grams = roll(h, SHINGLE)
    spots = known = np.zeros(0, np.int64)
    weight = np.zeros(len(h) + 1)
    if len(grams) and len(index.known):
        hit = np.flatnonzero(index.maybe.take((grams >> np.uint64(44)).astype(np.intp)))
        at = np.minimum(np.searchsorted(index.known, grams[hit]), len(index.known) - 1)
        same = (index.known[at] == grams[hit]) & (row[hit] == row[hit + SHINGLE - 1])
        spots, known = hit[same], at[same]
        weight[1 + spots] = index.known_weight[known]
        np.cumsum(weight, out=weight)
        weight[len(grams) + 1 :] = weight[len(grams)]
    n = index.rarest[known + 1] - index.rarest[known]
    owner = index.rarest_owner[np.arange(n.sum()) + np.repeat(index.rarest[known] - np.cumsum(n) + n, n)]
    tried = [(row[np.repeat(spots, n)].astype(np.int64) << 32) | owner]
    best: dict[tuple[int, int], tuple] = {}
    for at, made in window_prints(h, [c[0] for c in index.classes]):
        for (size, which, prints, blocks), w in zip(index.classes, made, strict=True):
            if not len(w):
                continue
            found = []
            for b, (there, starts, owners) in enumerate(blocks):
                key = w.view(np.uint16)[b::4].astype(np.intp)
                pos = np.flatnonzero(there.take(key))
                key = key[pos]
                low = starts[key]
                n = starts[key + 1] - low
                spot = np.repeat(pos, n)
                owner = owners[np.arange(len(spot)) + np.repeat(low - np.cumsum(n) + n, n)]
                near = np.flatnonzero(np.bitwise_count(w[spot] ^ prints[owner]) <= index.radius)
                found.append((spot[near] << 32) | owner[near])
            pairs = np.unique(np.concatenate(found))
            spot, owner = (pairs >> 32) + at, pairs & 0xFFFFFFFF
            item = which[owner]
            may = row[spot] == row[spot + size - 1]
            if size >= SHINGLE:
                text = row[spot]
                may &= weight[first[text + 1]] - weight[first[text]] >= least * index.full[item] - 1e-9
                tried.append((text[may].astype(np.int64) << 32) | item[may])
                continue
            # an item of fewer words than a shingle matches whole
            apart = np.bitwise_count(w[spot - at] ^ prints[owner])
            for s, i, bits in zip(spot[may].tolist(), item[may].tolist(), apart[may].tolist(), strict=True):
                t, k = int(row[s]), len(index.words[i])
                if s + k <= first[t + 1] and (t, i) not in best and similarity(index, i, h[s : s + k]) >= 1.0 - 1e-9:
                    best[t, i] = (1.0, s, bits, k)
    pairs = np.unique(np.concatenate(tried))
    text, item = pairs >> 32, pairs & 0xFFFFFFFF
    may = weight[first[text + 1]] - weight[first[text]] >= least * index.full[item] - 1e-9
    pairs = pairs[may]
    if len(pairs):
        each = np.full(len(grams), index.rare)
        each[spots] = index.known_weight[known]
        total = np.concatenate([[0.0], np.cumsum(each)])
        size_of = {int(i): (c[0], p) for c in index.classes for i, p in zip(c[1], c[2], strict=True)}
    for t, i in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
        a, b = np.searchsorted(spots, (first[t], first[t + 1]))
        where = best_window(index, i, grams, spots[a:b], total, least)
        if where is None:
            continue
        s, m = where[0], where[1] - where[0] + SHINGLE
        like = similarity(index, i, h[s : s + m])
        if like >= least - 1e-9:  # sums of weights are rounded
            size, mine = size_of[i]
            part = h[s : min(s + size, first[t + 1])]  # a text that ends before the class's words are through has fewer
            bits = (int(next(window_prints(part, [len(part)]))[1][0][0]) ^ int(mine)).bit_count()
            best[t, i] = (like, s, bits, m)
    for (t, i), (like, s, bits, m) in sorted(best.items()):
        yield t, i, like, bits, s - int(first[t]), m


def _parts(benchmark: DataFrame) -> Iterator[list]:
    """The items in parts within the bounds; parts are counted before one is read."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    n = 1
    while True:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("part")
        sizes = items.groupBy(part).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
        most = sizes.agg(F.max("rows"), F.max("bytes"), F.count(F.lit(1))).first()
        if most[2] == 0:
            return
        # one item above the bytes is a part by itself, whatever its size
        if (most[0] <= MOST_ITEMS and most[1] <= MOST_BYTES) or most[0] == 1:
            break
        n *= 2
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 11) -> DataFrame:
    """doc_id, item_id, similarity, hamming, start_word, n_words: each item that each row of ``docs`` holds."""
    spark = docs.sparkSession
    tune(spark, 250)
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, hamming int, start_word long, n_words int"
    out = [spark.createDataFrame([], schema)]
    for items in _parts(benchmark):
        if not items:
            continue
        index = Index(items, radius, least)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, row = word_hashes(b.column(1))
                hits = list(find(index, h, row, least))
                if hits:
                    t, i, *rest = zip(*hits, strict=True)
                    columns = [b.column(0).take(pa.array(t)), pa.array([index.ids[x] for x in i])]
                    columns += [pa.array(x, k) for x, k in zip(rest, (pa.float64(), pa.int32(), pa.int64(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "hamming", "start_word", "n_words"])

        out.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, out[1:] or out)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 11) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay, nothing is shuffled."""
    tune(docs.sparkSession, 250)
    at = docs.columns.index("text")
    for items in _parts(benchmark):
        if not items:
            continue
        index = Index(items, radius, least)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, row = word_hashes(b.column(at))
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in find(index, h, row, least)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
