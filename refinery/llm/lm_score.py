"""Cross-entropy difference between two matched n-gram models.

Both models are bigram models over one vocabulary: every word of the corpus.
The background model is counted over all rows, the target model over those
whose doc_id is in a target set. Words with a share of ``LEAST_SHARE`` of all
tokens or more are common and have bigrams of their own. All rarer words share
the bigrams of one rare word, and each has its own probability within it:

    P(w | v) = (count(v, w) + PRIOR x P(w)) / (count(v) + PRIOR)
    P(w | v) = P(rare | v) x P(w | rare)        for a rare w

with P(w) and P(w | rare) from counts, mixed with ``EVEN`` of an even
distribution, and the end of a text as one more event. A document's score is
its mean loss per token under the target minus that under the background: the
lower, the more it is like the target.

How it is spread: words are counted first; common words number at most
1 / LEAST_SHARE at any input, so their counts go to the tasks. Bigrams of the
``TOP`` most frequent words, of the rare word and of the beginning are counted
in a square table of fixed size and looked up where a text lies, which is only
a faster way for the hottest keys. All other bigrams, and all rare words, are
dealt to shards by key, a few bytes for each occurrence; a shard has all
occurrences of its keys, so it counts them and knows their losses at once, and
passes on one sum for each document. A dealt bigram has a word that is not
among the TOP most frequent, so none is more than 1 / TOP of all tokens. Sums
are integers (2 ** -20 nats), so neither order nor retries change a score.

Defined results: words are runs of letters and digits, case ignored; a null
text or one without words has 0 tokens and null losses and score; if nothing
is in the target set, its losses are those of even probabilities; a row may be
in the target once only, however often its id is listed; repeated rows count
each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Marks, checkpoint, mix64, tune
from .words import word_hashes

#: Least share of all tokens of a common word.
LEAST_SHARE = 2.0**-22
#: Most frequent words whose bigrams with each other are counted in one table.
TOP = 1022
#: Tokens that the distribution without history weighs in that of each history.
PRIOR = 32.0
#: Share of an even distribution in the smoothed ones.
EVEN = 0.01
#: Tokens of the corpus for each shard, and the least number of shards.
TOKENS_A_SHARD, LEAST_SHARDS = 8_000_000, 8
#: Distinct words that a task holds before it passes them on.
MOST_HELD = 1 << 20
UNIT = 2.0**20
#: Stands among the word hashes for the beginning of a text.
BEGIN = 0


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, row = word_hashes(texts)
    h[h == BEGIN] = 1
    return h, row


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[cuts], *(np.add.reduceat(c[order], cuts) if len(cuts) else c[order] for c in counts)


def _chosen(b: pa.RecordBatch) -> np.ndarray:
    return b.column(2).to_numpy(zero_copy_only=False) == 1


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n, t of batches of doc_id, text and mark; combined before they are passed on."""
    held: list[tuple[np.ndarray, ...]] = []

    def out():
        words, n, t = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n), pa.array(t)], ["word", "n", "t"])

    for b in batches:
        h, row = words_of(b.column(1))
        chosen = _chosen(b).astype(np.int64)
        first = np.unique(row)
        h = np.concatenate([h, np.full(len(first), BEGIN, np.uint64)])
        held.append(summed(h, np.ones(len(h), np.int64), chosen[np.concatenate([row, first])]))
        if sum(len(x[0]) for x in held) > MOST_HELD:
            held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if len(held[0][0]) > MOST_HELD // 2:
                yield out()
                held = []
    if held:
        yield out()


class Vocabulary:
    """Common words by rank of frequency, then the rare word and the beginning; their counts, background first."""

    BITS = 20

    def __init__(self, words: np.ndarray, counts: np.ndarray, rare: np.ndarray, kinds: int, texts: np.ndarray):
        """counts: 2 x common words; rare: tokens of all rarer words; kinds: number of those; texts: texts with words."""
        order = np.argsort(words)
        self.words, self.rank = words[order], order.astype(np.int32)
        self.size, self.top = len(words), min(TOP, len(words))
        self.rare, self.kinds = rare.astype(np.float64), kinds
        events = np.concatenate([counts, rare[:, None], texts[:, None]], axis=1).astype(np.float64)
        # as an event the last one is the end of a text, as a history its beginning: there are as many
        total = events.sum(axis=1, keepdims=True)
        even = 1 / events.shape[1]
        self.alone = np.where(total > 0, (1 - EVEN) * events / np.maximum(1, total) + EVEN * even, even)
        self.before = events
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(words >> np.uint64(64 - self.BITS)).astype(np.intp)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.size, np.int32)
        if self.size:
            hit = np.flatnonzero(self.maybe.take((h >> np.uint64(64 - self.BITS)).astype(np.intp)))
            at = np.minimum(np.searchsorted(self.words, h[hit]), self.size - 1)
            same = self.words[at] == h[hit]
            out[hit[same]] = self.rank[at[same]]
        return out

    def histories(self, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
        before = np.concatenate([[self.size + 1], ids[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        before[np.flatnonzero(np.diff(row, prepend=-1))] = self.size + 1
        return before

    def dense(self, before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are in the square table, and their cells."""
        top, n = self.top, self.size
        place = lambda x: np.where(x < top, x, x - n + top)
        some = np.flatnonzero(((before < top) | (before >= n)) & ((now < top) | (now == n)))
        return some, place(before[some]) * (top + 1) + place(now[some])

    @property
    def cells(self) -> int:
        return (self.top + 2) * (self.top + 1)

    def cell_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.arange(self.top), [self.size, self.size + 1]])
        return np.repeat(ids, self.top + 1), np.tile(ids[:-1], self.top + 2)

    def loss(self, which: int, before: np.ndarray, now: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Losses of events after histories that were counted n times, in units."""
        p = (n + PRIOR * self.alone[which, now]) / (self.before[which, before] + PRIOR)
        return np.rint(-np.log(p) * UNIT).astype(np.int64)

    def rare_loss(self, which: int, n: np.ndarray) -> np.ndarray:
        """Losses of rare words, given that the word is rare, that were counted n times."""
        even, all_of = 1 / (self.kinds + 1), self.rare[which]
        p = (1 - EVEN) * n / all_of + EVEN * even if all_of else np.full(len(n), even)
        return np.rint(-np.log(p) * UNIT).astype(np.int64)


def vocabulary(marked: DataFrame, sent: tuple | None) -> tuple[Vocabulary, int]:
    """The words' counts, and the number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from count_words(Marks.fill(sent, batches))

    counted = marked.mapInArrow(run, "word long, n long, t long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counted = checkpoint(counted)
    real = counted.filter(F.col("word") != BEGIN)
    tokens = real.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.col("n") >= tokens * LEAST_SHARE
    kinds, *rare = real.filter(~common).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    texts = counted.filter(F.col("word") == BEGIN).select("n", "t").first() or (0, 0)
    found = real.filter(common).toArrow()  # 1 / LEAST_SHARE rows at most
    words, n, t = (found.column(k).to_numpy() for k in range(3))
    order = np.lexsort((words, -n))
    counts = np.stack([n[order], t[order]])
    return Vocabulary(words[order].view(np.uint64), counts, np.array(rare), kinds, np.array([texts[0], texts[1]])), tokens


def square(marked: DataFrame, sent: tuple | None, v: Vocabulary) -> np.ndarray:
    """Counts of the pairs of the square table, 2 x cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((2, v.cells), np.int64)
        for b in Marks.fill(sent, batches):
            h, row = words_of(b.column(1))
            now = v.of(h)
            some, cell = v.dense(v.histories(now, row), now)
            chosen = _chosen(b)[row[some]]
            have[0] += np.bincount(cell, minlength=v.cells)
            have[1] += np.bincount(cell[chosen], minlength=v.cells)
        at = np.flatnonzero(have[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(have[0, at]), pa.array(have[1, at])], ["cell", "n", "t"])

    found = marked.mapInArrow(run, "cell long, n long, t long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    out = np.zeros((2, v.cells), np.int64)  # a row a cell at most
    if len(found):
        out[:, found.column(0).to_numpy()] = found.column(1).to_numpy(), found.column(2).to_numpy()
    return out


def _own_sums(own: np.ndarray, n: int, losses: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(own, weights=x, minlength=n).astype(np.int64) for x in losses]


def dealt(batch: pa.RecordBatch, v: Vocabulary, table: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, its part of a batch): occurrences to be counted there, or the sums that are known here."""
    ids, keys = batch.column(0), batch.column(3).to_numpy(zero_copy_only=False)
    h, row = words_of(batch.column(1))
    chosen = _chosen(batch)
    n = batch.num_rows
    now = v.of(h).astype(np.int64)
    before = v.histories(now, row)
    some, cell = v.dense(before, now)
    known = _own_sums(row[some], n, [t[cell] for t in table])
    home = int(mix64(np.array([keys[0]], np.int64).view(np.uint64))[0] % np.uint64(shards))
    yield home, pickle.dumps(("sums", ids, keys, np.bincount(row, minlength=n), *known), 5)
    rest = np.ones(len(h), bool)
    rest[some] = False
    rest = np.flatnonzero(rest)
    rare = np.flatnonzero(now == v.size)
    for kind, at, key in (("pairs", rest, (before[rest] * (v.size + 1) + now[rest]).astype(np.uint64)), ("rare", rare, h[rare])):
        to = (mix64(key + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((key, to))
        key, own, to = key[order], row[at[order]], to[order]
        cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            docs, place = np.unique(own[a:z], return_inverse=True)
            part = key[a:z]
            if kind == "pairs":  # high and low halves, since sorted high ones shrink when Spark compresses them
                part = (part >> np.uint64(32)).astype(np.uint32), part.astype(np.uint32)
            yield int(to[a]), pickle.dumps((kind, ids.take(pa.array(docs)), keys[docs], chosen[docs], part, place.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32)), 5)


def met(parts: Iterator[bytes], v: Vocabulary) -> Iterator[tuple]:
    """(ids, keys, tokens, background, target): sums by document of what one shard was dealt."""
    ids: list[pa.Array] = []
    keys: list[np.ndarray] = []
    sums: list[list[np.ndarray]] = []
    held: dict[str, list[tuple]] = {"pairs": [], "rare": []}
    for part in parts:
        kind, own, key, *rest = pickle.loads(part)
        ids.append(own)
        keys.append(key)
        n = len(key)
        if kind == "sums":
            sums.append([np.ones(n, np.int64), *rest])
        else:
            held[kind].append((len(sums), rest[1], rest[2], rest[0]))
            sums.append([np.zeros(n, np.int64)] * 2 + [None, None])
    for kind, some in held.items():
        if not some:
            continue
        size = [len(p[2]) for p in some]
        if kind == "pairs":
            key = np.concatenate([p[1][0] for p in some]).astype(np.uint64) << np.uint64(32) | np.concatenate([p[1][1] for p in some])
        else:
            key = np.concatenate([p[1] for p in some])
        chosen = np.concatenate([p[3][p[2]] for p in some])
        order = np.argsort(key)
        key = key[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[cuts]
        n = np.diff(cuts, append=len(order))
        t = np.add.reduceat(chosen[order].astype(np.int64), cuts)
        if kind == "pairs":
            before, now = (key // np.uint64(v.size + 1)).astype(np.int64), (key % np.uint64(v.size + 1)).astype(np.int64)
            each = [v.loss(0, before, now, n), v.loss(1, before, now, t)]
        else:
            each = [v.rare_loss(0, n), v.rare_loss(1, t)]
        place = np.empty(len(order), np.int32)
        place[order] = np.repeat(np.arange(len(cuts), dtype=np.int32), n)
        at = 0
        for (number, _, own, flags), k in zip(some, size, strict=True):
            sums[number][2:] = _own_sums(own, len(flags), [x[place[at : at + k]] for x in each])
            at += k
    if not keys:
        return
    # one row a document
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    own = pa.chunked_array(ids).combine_chunks().take(pa.array(order[cuts]))
    yield own, key[order[cuts]], *(np.add.reduceat(np.concatenate([s[i] for s in sums])[order], cuts) for i in range(4))


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every row of ``docs`` (doc_id, text).

    The background model is that of all rows of ``docs``, the target model that of the rows whose doc_id
    is in ``target``; more columns of either are ignored.
    """
    tune(docs.sparkSession)
    marked = Marks(docs, target.select("doc_id", F.lit(1).alias("mark")).distinct())
    sent = marked.sent
    v, tokens = vocabulary(marked.rows, sent)
    counts = square(marked.rows, sent, v)
    table = [v.loss(k, *v.cell_pairs(), counts[k]).astype(np.int32) for k in (0, 1)]
    shards = max(LEAST_SHARDS, -(-tokens // TOKENS_A_SHARD))
    kind = dict(docs.dtypes)["doc_id"]
    # rows that are equal in id and text have one key, whatever task reads them
    rows = marked.rows.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in Marks.fill(sent, batches):
            parts = list(dealt(b, v, table, shards)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["shard", "part"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, key, *sums in met((x.as_py() for b in batches for x in b.column(0)), v):
            yield pa.RecordBatch.from_arrays([own, pa.array(key), *map(pa.array, sums)], ["doc_id", "key", "copies", "n", "b", "t"])

    parts = rows.mapInArrow(deal, "shard int, part binary").repartitionById(shards, F.col("shard")).select("part")
    sums = parts.mapInArrow(meet, f"doc_id {kind}, key long, copies long, n long, b long, t long")
    total = sums.groupBy("doc_id", "key").agg(*(F.sum(c).alias(c) for c in ("copies", "n", "b", "t")))
    each = total.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.lit(UNIT) / F.col("n"))
    return each.select(
        "doc_id",
        (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"),
        mean("t").alias("loss_target"),
        mean("b").alias("loss_background"),
        (mean("t") - mean("b")).alias("score"),
    )
