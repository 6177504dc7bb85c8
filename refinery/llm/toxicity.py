"""Toxicity by weak supervision.

Many voters look at every document that may be learnt from. Some need no
labels: lexicons of insults, and patterns of shouting, masking and address.
The others look for words and word beginnings that set the two classes of all
learnable labelled rows apart: a lexicon voter for some of the words, a
pattern voter for some of the beginnings of one length, density voters for
several finds. A generative label model then explains the votes of all these
documents by a hidden class, without labels: expectation maximisation
estimates the class's share, how often each voter fires in each class, and on
which other voter it depends within a class (the tree of dependencies that
explains most, by Chow and Liu), so that voters that repeat one another count
about once. A logistic regression on the mined words and beginnings is trained
on the label model's posteriors, not on the labels, and scores every text.

Counts, mined features and the label model cover all learnable rows; votes
are summed by pattern, and each round of estimation is a sum over patterns, in
integers, so results do not depend on how rows are spread. The classifier is
fitted on at most ``most_toxic`` and ``most_clean`` labelled rows, those whose
ids have the smallest hashes, and has ``MOST_FEATURES`` weights at most, for
the features that tell most. Texts that repeat teach once.

Defined results: a null or empty text has no finds and the score that follows
from that; without a learnable row of either class, or a feature that tells
them apart, every score is 0; labels that are null teach nothing; an id that
is labelled twice counts by its larger label; repeated rows come out once
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Marks, batch_bytes, byte_table, checkpoint, hash_spans, held_out, portions, spans, tune

LETTERS = byte_table(lambda b: b >= 128 or chr(b).isalpha())
#: Lengths in bytes of the word beginnings.
STEMS = (3, 4, 5, 6, 8)
#: Weights of the classifier.
MOST_FEATURES = 16_384
#: Least likelihood ratio statistic, and least log odds, of a mined feature.
LEAST_G2, LEAST_ODDS = 11.0, 2.0
#: Least log odds of what voters look for; the classifier weighs weaker features as well.
VOTER_ODDS = 3.5
GROUPS = 6
#: Insults by language, each list a voter.
LEXICONS = [
    set("idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic worthless disgusting clown jerk creep imbecile cretin vermin filthy freak ugly hate".split()),
    set("idiot idiote imbécile crétin crétine connard connasse salaud salope ordure minable débile abruti abrutie dégoûtant pourriture".split()),
    set("idiot trottel dummkopf arschloch abschaum blödmann schwachkopf versager widerlich dreckig hurensohn vollidiot depp penner".split()),
    set("idiota imbécil estúpido estúpida cabrón gilipollas basura asqueroso asquerosa inútil payaso escoria tonto patético".split()),
]
#: Patterns of shouting, masked words and address, each a voter.
PATTERNS = [r"[!?]{3}", r"\b[A-Z]{4,}[ ,]+[A-Z]{4,}[ ,]+[A-Z]{4,}\b", r"[A-Za-z][*#@$%]{2,}[A-Za-z]", r"(?i)\byou(?:'re| are)? (?:an? |all |such |so )"]
#: Least likelihood ratio statistic of a dependency between two voters.
LEAST_TIE = 20.0


def finds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, kind (0 a word, k the k-th beginning) and hash of each distinct feature of each text."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    raw, offs = batch_bytes(pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
    starts, ends, row = spans(raw, offs, LETTERS)
    whole = hash_spans(raw, starts, ends)
    order = np.lexsort((whole, row))
    first = np.ones(len(order), bool)
    first[1:] = (whole[order[1:]] != whole[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    keep = order[first]  # each word once a text
    starts, ends, row, whole = starts[keep], ends[keep], row[keep], whole[keep]
    rows, kinds, hashes = [row], [np.zeros(len(row), np.int8)], [whole]
    for k, n in enumerate(STEMS, 1):
        some = np.flatnonzero(ends - starts > n)
        rows.append(row[some])
        kinds.append(np.full(len(some), k, np.int8))
        hashes.append(hash_spans(raw, starts[some], starts[some] + n) + np.uint64(k))
    return np.concatenate(rows), np.concatenate(kinds), np.concatenate(hashes)


class Features:
    """The mined features, and which texts have them."""

    def __init__(self, hashes: np.ndarray, kinds: np.ndarray, odds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.kinds, self.odds = hashes[order], kinds[order], odds[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.intp)] = True
        toxic = self.odds[self.odds > 0]
        # where no feature is that strong, voters look for the strongest there are
        self.votes = self.odds >= min(VOTER_ODDS, float(np.quantile(toxic, 0.75)) if len(toxic) else np.inf)

    def among(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and feature number of each find, distinct."""
        if not len(self.hashes) or not len(h):
            z = np.zeros(0, np.int64)
            return z, z
        hit = np.flatnonzero(self.maybe.take((h >> np.uint64(44)).astype(np.intp)))
        at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
        same = self.hashes[at] == h[hit]
        n = len(self.hashes)
        both = np.unique(row[hit[same]].astype(np.int64) * n + at[same])
        return both // n, both % n


def _lexicons() -> list[np.ndarray]:
    out = []
    for words in LEXICONS:
        _, kind, h = finds(pa.array(sorted(words)))
        out.append(np.sort(h[kind == 0]))
    return out


#: Mined lexicon voters by group of words, mined pattern voters by length, density voters, then those that need no labels.
MINED = GROUPS + len(STEMS) + 3
VOTERS = MINED + len(LEXICONS) + len(PATTERNS)


def votes(features: Features, lexicons: list[np.ndarray], texts: pa.Array, found: tuple, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Texts x voters: which fire. ``found`` is of ``finds``, row and feature are of ``Features.among``."""
    n = len(texts)
    out = np.zeros((n, VOTERS), bool)
    group = np.where(features.kinds == 0, (features.hashes % np.uint64(GROUPS)).astype(np.int64), GROUPS - 1 + features.kinds)
    use = features.votes[feature]
    out[row[use], group[feature[use]]] = True
    words = np.bincount(row[use & (features.kinds[feature] == 0)], minlength=n)
    total = np.bincount(row[use], minlength=n)
    out[:, MINED - 3], out[:, MINED - 2], out[:, MINED - 1] = words >= 2, total >= 3, total >= 8
    own, kind, h = found
    own, h = own[kind == 0], h[kind == 0]
    for k, words in enumerate(lexicons):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        out[own[words[at] == h], MINED + k] = True
    for k, pattern in enumerate(PATTERNS):
        fires = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
        out[:, MINED + len(LEXICONS) + k] = fires.to_numpy(zero_copy_only=False)
    return out


def packed(v: np.ndarray) -> np.ndarray:
    """Rows of votes as whole numbers; there are fewer than 63 voters."""
    return (v.astype(np.int64) << np.arange(v.shape[1])).sum(axis=1)


def unpacked(pattern: np.ndarray, voters: int) -> np.ndarray:
    return (pattern[:, None] >> np.arange(voters)) & 1 == 1


class LabelModel:
    """Classes behind votes: how often each voter fires in each, given the one voter that it depends on."""

    def __init__(self, total: np.ndarray, one: np.ndarray):
        """Sums of the votes' products (voters x voters, the documents' number in the corner), of all and of class 1."""
        m = len(total) - 1
        both = np.stack([total - one, one])  # by class
        n, fired, pair = both[:, m, m], both[:, m, :m], both[:, :m, :m]
        self.prior = float(np.clip(n[1] / max(1.0, n.sum()), 0.001, 0.999))
        self.fire = (fired + 0.5) / (n[:, None] + 1.0)
        # a table of two votes, first and second, for each class and pair of voters
        table = np.empty((2, 2, 2, m, m))
        table[:, 1, 1] = pair
        table[:, 1, 0] = fired[:, :, None] - pair
        table[:, 0, 1] = fired[:, None, :] - pair
        table[:, 0, 0] = n[:, None, None] - fired[:, :, None] - fired[:, None, :] + pair
        table = np.maximum(table, 0) + 0.25
        all_of = table.sum(axis=(1, 2), keepdims=True)
        alone = table.sum(axis=2, keepdims=True) * table.sum(axis=1, keepdims=True) / all_of
        tie = 2 * (table * np.log(table / alone)).sum(axis=(0, 1, 2))
        np.fill_diagonal(tie, 0)
        self.parent = _tree(tie)
        # log P(own vote | the parent's vote): class, parent's vote, own vote, voter
        self.log = np.empty((2, 2, 2, m))
        for j, q in enumerate(self.parent):
            if q < 0:
                self.log[:, :, 1, j] = np.log(self.fire[:, j])[:, None]
                self.log[:, :, 0, j] = np.log1p(-self.fire[:, j])[:, None]
            else:
                t = table[:, :, :, q, j]
                self.log[..., j] = np.log(t / t.sum(axis=2, keepdims=True))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of votes."""
        v = v.astype(np.int64)
        parents = np.array([max(q, 0) for q in self.parent])
        voter = np.arange(v.shape[1])[None, :]
        likely = [self.log[c][v[:, parents], v, voter].sum(axis=1) for c in (0, 1)]
        z = np.log(self.prior / (1 - self.prior)) + likely[1] - likely[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(tie: np.ndarray) -> list[int]:
    """Parent of each voter in the spanning tree of the strongest ties; -1 where the tie is too weak."""
    m = len(tie)
    parent = [-1] * m
    best, by = np.full(m, -1.0), np.full(m, -1)
    todo = set(range(m))
    while todo:
        j = max(todo, key=lambda i: (best[i], -i))
        todo.discard(j)
        if best[j] >= LEAST_TIE:
            parent[j] = int(by[j])
        for i in todo:
            if tie[j, i] > best[i]:
                best[i], by[i] = tie[j, i], j
    return parent


SCALE = 1 << 20


def _products(patterns: DataFrame, voters: int, weight) -> np.ndarray:
    """Sums of n x weight x the products of votes; ``weight`` takes rows of votes. Integers: in any order the same."""
    m = voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((m + 1, m + 1))
        for b in batches:
            v = unpacked(b.column(0).to_numpy(zero_copy_only=False), m)
            x = np.concatenate([v, np.ones((len(v), 1), bool)], axis=1).astype(np.float64)
            have += x.T @ (x * (b.column(1).to_numpy(zero_copy_only=False) * np.rint(weight(v) * SCALE))[:, None])
        at = np.flatnonzero(have.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(have.ravel()[at].astype(np.int64))], ["cell", "v"])

    found = patterns.mapInArrow(run, "cell int, v long").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((m + 1) ** 2)
    if len(found):
        out[found.column(0).to_numpy()] = found.column(1).to_numpy() / SCALE
    return out.reshape(m + 1, m + 1)


def fit_label_model(patterns: DataFrame, voters: int, rounds: int = 25) -> LabelModel:
    """From patterns of votes (pattern, n): a class is likelier, at first, the more voters fire."""
    total = _products(patterns, voters, lambda v: np.ones(len(v)))
    model = LabelModel(total, _products(patterns, voters, lambda v: np.minimum(0.95, 0.02 + 0.35 * v.sum(axis=1))))
    for _ in range(rounds):
        before = model
        model = LabelModel(total, _products(patterns, voters, before.posterior))
        if model.parent == before.parent and np.abs(model.fire - before.fire).max() < 1e-3:
            break
    return model


def logistic(row: np.ndarray, feature: np.ndarray, y: np.ndarray, m: int, rounds: int = 1000, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and offset that fit probabilities y, by accelerated gradient descent; features are 0 or 1."""
    n = len(y)
    w, b = np.zeros(m), 0.0
    balance = np.where(y >= 0.5, 0.5 / max(1e-9, (y >= 0.5).mean()), 0.5 / max(1e-9, (y < 0.5).mean()))
    most = np.bincount(row, minlength=n).max(initial=0) + 1  # bounds the curvature
    step = 1.0 / (0.25 * most * balance.max() + ridge / n)
    v, c = w.copy(), b
    for t in range(rounds):
        z = np.bincount(row, weights=v[feature], minlength=n) + c
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / n
        grad = np.bincount(feature, weights=e[row], minlength=m) + ridge * v / n
        nw, nb = v - step * grad * n / n, c - step * e.sum()
        k = t / (t + 3)
        v, c = nw + k * (nw - w), nb + k * (nb - b)
        w, b = nw, nb
    return w, b


class Model:
    def __init__(self, features: Features, weights: np.ndarray, offset: float, label_model: LabelModel | None = None):
        self.features, self.weights, self.offset, self.label_model = features, weights, offset, label_model

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.label_model is None:
            return np.zeros(len(texts))
        own, _, h = finds(texts)
        row, feature = self.features.among(own, h)
        z = np.bincount(row, weights=self.weights[feature], minlength=len(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Marks of rows: the label, and whether the classifier is fitted on the row.
TOXIC, FITTED = 1, 2


def _marks(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """doc_id and mark of the learnable labelled rows; of a text's copies with one label the smallest id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("own"))
    taught = texts.join(known, "doc_id").groupBy("own", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct()
    taught = checkpoint(taught)
    fitted = [taught.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id") for c, most in ((1, most_toxic), (0, most_clean))]
    fitted = fitted[0].unionByName(fitted[1]).withColumn("fitted", F.lit(FITTED))
    return checkpoint(taught.join(fitted, "doc_id", "left").select("doc_id", (F.col("toxic") + F.coalesce("fitted", F.lit(0))).alias("mark")))


def _mined(rows: DataFrame, sent: tuple | None, n1: int, n0: int) -> Features | None:
    """The features that tell the marked rows' classes apart."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in Marks.fill(sent, batches) for part in portions(whole.filter(pc.greater_equal(whole.column(2), 0)), 1)):
            row, kind, h = finds(b.column(1))
            order = np.lexsort((row, h))
            row, kind, h = row[order], kind[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row, kind, h = row[new], kind[new], h[new]
            toxic = (b.column(2).to_numpy() & TOXIC)[row] == TOXIC
            cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            t = np.add.reduceat(toxic.astype(np.int64), cuts) if len(cuts) else cuts
            n = np.diff(cuts, append=len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h[cuts].view(np.int64)), pa.array(kind[cuts].astype(np.int32)), pa.array(t), pa.array(n - t)], ["h", "kind", "t", "c"])

    counted = rows.mapInArrow(mine, "h long, kind int, t long, c long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    share = n1 / (n0 + n1)
    part = lambda got, want: F.when(got > 0, got * F.log(got / want)).otherwise(0.0)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    g2 = 2 * (part(t, (t + c) * share) + part(c, (t + c) * (1 - share)))
    odds = F.log((t + 0.5) / (n1 + 1.0)) - F.log((c + 0.5) / (n0 + 1.0))
    picked = counted.withColumn("g2", g2).withColumn("odds", odds).filter((F.col("g2") >= LEAST_G2) & (F.abs("odds") >= LEAST_ODDS))
    best = picked.orderBy(F.desc("g2"), "h").limit(MOST_FEATURES).collect()
    if not best:
        return None
    return Features(np.array([r.h for r in best], np.int64).view(np.uint64), np.array([r.kind for r in best], np.int8), np.array([r.odds for r in best]))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_clean: int = 8000) -> Model:
    """Learns from ``docs`` and ``labels`` (doc_id, toxic), rows that are not held out only."""
    tune(docs.sparkSession)
    marks = _marks(docs, labels, most_toxic, most_clean)
    size = {r.toxic: r.n for r in marks.groupBy((F.col("mark") % 2).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Model(Features(np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0)), np.zeros(0), 0.0)
    if len(size) < 2:
        return nothing
    marked = Marks(docs, marks)
    rows, sent = marked.rows.filter(~held_out()), marked.sent
    features = _mined(rows, sent, size[1], size[0])
    if features is None:
        return nothing

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = _lexicons()
        for b in (part for whole in Marks.fill(sent, batches) for part in portions(whole, 1)):
            found = finds(b.column(1))
            row, feature = features.among(found[0], found[2])
            v = votes(features, lexicons, b.column(1), found, row, feature)
            fitted = b.column(2).to_numpy() >= FITTED
            keep = fitted[row]
            cuts = np.searchsorted(row[keep], np.arange(b.num_rows + 1)).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature[keep].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(packed(v)), pa.array(fitted), kept], ["own", "pattern", "fitted", "features"])

    seen = rows.filter(F.col("text").isNotNull()).withColumn("own", F.xxhash64("text"))
    seen = checkpoint(seen.mapInArrow(look, "own long, pattern long, fitted boolean, features array<int>"))
    patterns = seen.select("own", "pattern").dropDuplicates(["own"]).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    label_model = fit_label_model(checkpoint(patterns), VOTERS)
    fitted = seen.filter("fitted").orderBy("own", F.size("features")).collect()  # most_toxic + most_clean rows
    found = [np.array(r.features, np.int64) for r in fitted]
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    feature = np.concatenate(found) if found else np.zeros(0, np.int64)
    likely = label_model.posterior(unpacked(np.array([r.pattern for r in fitted], np.int64), VOTERS))
    weights, offset = logistic(row, feature, likely, len(features.hashes))
    return Model(features, weights, offset, label_model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in portions(whole, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(model.score(b.column(1)))], ["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
