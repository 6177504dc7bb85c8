"""Near-duplicate detection with SimHash and meet-in-the-middle ball hashing.

Fingerprints link at ``radius`` or fewer differing bits. Every distinct
fingerprint emits all variants within half the radius; two fingerprints that
link have a variant in common, and two that share a variant differ in at most
``radius`` bits. So all owners of a variant are linked, and a chain from one
to the next (checked bit by bit) says the same as all their pairs.

With 64 bits and radius 4 there are 2081 variants. They are shuffled by a
part of the variant, not one by one: the parities of ``blocks`` groups of
bits. A fingerprint goes once to each parity word that its variants have (79
of them for 12 blocks), and the task that owns the word makes the variants
there, sorts them and reads off the collisions. Near copies differ in a few
bits and so in parities, which spreads a large group of them over all words,
where a bit prefix would not. Each task joins what it found by union-find and
emits at most one link per fingerprint and word; global components follow.

Defined results: a text without words, an empty or null one included, has
fingerprint zero and links like any other; a null doc_id never names a
component unless no other id is there; repeated rows come out once each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix64, prefix_for, roll, tune
from .components import Union, components
from .words import word_hashes

SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are added at a time.
CHUNK = 1 << 16
#: Variants that a task sorts at a time.
VARIANTS = 1 << 21
#: Minima in a band, and the chance that a pair of just the least similarity shares no band.
ROWS, MISS = 4, 1e-7
#: Texts of each side that a task compares with one another.
SLICE = 256


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits; each is set where over half of the word shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.fromiter((digest(flat[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)), np.uint64, min(CHUNK, n - at))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of ``keep``, and fp (the fingerprint as a signed long) of every row."""
    tune(docs.sparkSession)
    names = ["doc_id", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(len(names)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fps)], [*names, "fp"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    return docs.select(*names, "text").mapInArrow(run, f"{schema}, fp long")


def ball(radius: int, bits: int = 64) -> np.ndarray:
    """All masks of at most ``radius`` bits."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    layers, last = [np.zeros(1, np.uint64)], {0: -1}
    for _ in range(radius):
        last = {m | int(one[i]): i for m, top in last.items() for i in range(top + 1, bits)}
        layers.append(np.fromiter(last, np.uint64, len(last)))
    return np.concatenate(layers)


def parity(x: np.ndarray, blocks: int) -> np.ndarray:
    """Word of the parities of ``blocks`` interleaved groups of bits."""
    out = np.zeros(len(x), np.int32)
    for b in range(blocks):
        mask = np.uint64(sum(1 << i for i in range(b, 64, blocks)))
        out |= (np.bitwise_count(x & mask) & 1).astype(np.int32) << b
    return out


def _masks_by_word(radius: int, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    masks = ball(radius // 2)
    words = parity(masks, blocks)
    names = np.unique(words)
    return names, [masks[words == w] for w in names]


def links_in_word(fps: np.ndarray, word: int, radius: int, blocks: int, by_word: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links whose shared variant has this parity word."""
    shift = parity(fps, blocks) ^ np.int32(word)  # the masks that lead here
    order = np.argsort(shift, kind="stable")
    fps, shift = fps[order], shift[order]
    cuts = np.flatnonzero(np.diff(shift, prepend=-1))
    total = sum(len(by_word[int(shift[c])]) * int(e - c) for c, e in zip(cuts, [*cuts[1:], len(fps)], strict=True))
    parts = 1 << max(0, (-(-total // VARIANTS) - 1).bit_length())  # slices of the variants, so that memory stays bounded
    found = Union(len(fps))
    out = []
    for part in range(parts):
        made, owner = [], []
        for c, e in zip(cuts, [*cuts[1:], len(fps)], strict=True):
            masks = by_word[int(shift[c])]
            for at in range(c, e, max(1, VARIANTS // len(masks))):
                to = min(e, at + max(1, VARIANTS // len(masks)))
                v = (fps[at:to, None] ^ masks[None, :]).ravel()
                own = np.repeat(np.arange(at, to, dtype=np.int32), len(masks))
                if parts > 1:
                    ok = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(parts - 1) == np.uint64(part)
                    v, own = v[ok], own[ok]
                made.append(v)
                owner.append(own)
        v, own = np.concatenate(made), np.concatenate(owner)
        order = np.argsort(v)
        v, own = v[order], own[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        if not len(same):
            continue
        pairs = np.unique((own[same].astype(np.int64) << 32) | own[same + 1])
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius  # the check of colliding pairs
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            if found.join(i, j):
                out.append((int(fps[i]), int(fps[j])))
    return out


def blocks_for(n: int) -> int:
    """Parity words for n fingerprints: some thousands of rows, 100 000 variants, in each."""
    return min(30, max(8, (n // 64).bit_length()))


def fingerprint_links(fps: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all within the radius."""
    distinct = checkpoint(fps.select("fp").distinct())
    k = blocks or blocks_for(distinct.count())
    names, masks = _masks_by_word(radius, k)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                some = fp[at : at + 4096]
                words = (parity(some, k)[:, None] ^ names[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(np.repeat(some, len(names)).view(np.int64))], ["word", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = dict(zip(names.tolist(), masks, strict=True))
        held: list[np.ndarray] = []
        now = None

        def done():
            found = links_in_word(np.concatenate(held), now, radius, k, by_word) if sum(map(len, held)) > 1 else []
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for b in batches:  # rows come sorted by word
            words = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(words)) + 1).tolist(), len(words)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if now is not None and words[s] != now:
                    yield done()
                    held = []
                now = int(words[s])
                held.append(fp[s:e])
        if held:
            yield done()

    dealt = distinct.mapInArrow(deal, "word int, fp long")
    met = dealt.repartition("word").sortWithinPartitions("word").mapInArrow(meet, "a long, b long")
    return met


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of ``keep``, fp, component_id (smallest doc_id that can be reached over links) of every row."""
    rows = checkpoint(fingerprints(docs, shingle, keep))
    labels = components(fingerprint_links(rows, radius))
    # a component's name: first the smallest id of a fingerprint, then of all its fingerprints
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = checkpoint(least.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"), "least"))
    best = checkpoint(named.groupBy("label").agg(F.min("least").alias("component_id")))  # so that a large component's rows can be split
    owners = named.join(best, "label").select("fp", "component_id")
    return rows.join(owners, "fp").select("doc_id", *(keep or []), "fp", "component_id")



# keeping one row of each group of texts whose five-word shingles are alike


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of all texts, and the n + 1 offsets into them.

    A text of fewer words is one shingle, alike only to the same words; texts without words are alike.
    """
    h, row = word_hashes(texts)
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    grams = roll(h, shingle)
    own = row[: len(grams)]
    whole = own == row[shingle - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero(np.diff(cuts) < shingle)
    one = [int(roll(h[cuts[i] : cuts[i + 1]], int(cuts[i + 1] - cuts[i]))[0] ^ np.uint64(cuts[i + 1] - cuts[i])) if cuts[i] < cuts[i + 1] else 0 for i in short]
    at = np.concatenate([own[whole], short])
    order = np.argsort(at, kind="stable")
    return np.concatenate([grams[whole], np.array(one, np.uint64)])[order], np.searchsorted(at[order], np.arange(len(texts) + 1))


def bands_for(least: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima each, so that a pair of just ``least`` shares none with a chance of ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log1p(-(least**rows))) if least < 1 else 1


def band_keys(texts: pa.Array, shingle: int, bands: int, rows: int = ROWS) -> np.ndarray:
    """Texts x bands: hash of ``rows`` minima of the text's shingles, each minimum in an order of its own."""
    g, first = shingle_hashes(texts, shingle)
    out = np.zeros((len(texts), bands), np.uint64)
    orders = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(bands if len(texts) else 0):
        key = np.full(len(texts), k + 1, np.uint64)
        for a in orders[k * rows : (k + 1) * rows]:
            key = mix64(key * np.uint64(0x100000001B3) + np.minimum.reduceat(g * a, first[:-1]))
        out[:, k] = key
    return out


def shingle_prints(texts: pa.Array, shingle: int) -> np.ndarray:
    """SimHash of each text: a bit is set where over half of its shingles' hashes have it."""
    g, first = shingle_hashes(texts, shingle)
    n = np.diff(first).astype(np.uint64)
    out = np.zeros(len(texts), np.uint64)
    for k in range(32 if len(texts) else 0):  # two bits at a time, counted in the halves of a word
        k = np.uint64(k)
        ones = np.add.reduceat((g >> k) & np.uint64(0x100000001), first[:-1])
        low, high = ones & np.uint64(0xFFFFFFFF), ones >> np.uint64(32)
        out |= ((low + low > n).astype(np.uint64) << k) | ((high + high > n).astype(np.uint64) << (k + np.uint64(32)))
    return out


def alike(a: str | None, b: str | None, shingle: int) -> float:
    """Jaccard similarity of two texts' sets of word shingles; texts without words are alike."""
    h, row = word_hashes(pa.array([a, b], pa.string()))
    x, y = (h[row == i] for i in (0, 1))
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if min(len(x), len(y)) < shingle:
        return float(len(x) == len(y) and bool((x == y).all()))
    x, y = np.unique(roll(x, shingle)), np.unique(roll(y, shingle))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def alike_across(label: np.ndarray, build: np.ndarray, texts: pa.Array, shingle: int, least: float) -> list[tuple[int, int]]:
    """Labels that alike texts connect, one in ``build`` and one that is not, as a spanning forest; all such pairs are tried."""
    g, first = shingle_hashes(texts, shingle)
    sets = [np.unique(g[a:b]) for a, b in zip(first, first[1:], strict=False)]
    left, right = np.flatnonzero(build), np.flatnonzero(~build)
    if not len(left) or not len(right):
        return []
    flat = np.concatenate([sets[i] for i in right])
    owner = np.repeat(np.arange(len(right)), [len(sets[i]) for i in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    size = np.array([len(sets[i]) for i in right])
    names, spot = np.unique(label, return_inverse=True)
    found, out = Union(len(names)), []
    for i in left:
        low = np.searchsorted(flat, sets[i])
        n = np.searchsorted(flat, sets[i], "right") - low
        both = np.bincount(owner[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)], minlength=len(right))
        for j in right[both / (len(sets[i]) + size - both) >= least].tolist():
            if found.join(int(spot[i]), int(spot[j])):
                out.append((int(label[i]), int(label[j])))
    return out


def _verified(edges: DataFrame, held: DataFrame, shingle: int, least: float) -> DataFrame:
    """The rows of ``edges`` (a, b) whose texts are alike."""
    pairs = edges.join(held.select(F.col("own").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("own").alias("b"), F.col("text").alias("text_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(x, y, shingle) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _settled(members: DataFrame, labels: DataFrame, held: DataFrame, shingle: int, least: float) -> DataFrame:
    """a, b: the links between ``labels`` (node, label) that the hubs of ``members`` (key, own, hub) left out.

    All pairs of a key are tried, but for those with its hub, which have been, and those of its largest group,
    which are connected. Texts outside that group meet all others of the key, ``SLICE`` by ``SLICE`` in a task.
    """
    rest = checkpoint(members.filter("own != hub").join(labels, F.col("own") == F.col("node"), "left").select("key", "own", F.coalesce("label", "own").alias("label")))
    open_keys = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    # written first, so that the join deals both sides itself and a hot key's rows can be split
    rest = checkpoint(rest.join(checkpoint(open_keys), "key", "left_semi"))
    groups = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
    cut = lambda n: F.ceil(F.col(n) / SLICE).cast("int")
    main = checkpoint(main.select("key", F.col("main.label").alias("main"), cut("n").alias("rights"), F.ceil((F.col("n") - F.col("main.n")) / SLICE).cast("int").alias("lefts")))
    part = lambda n: F.pmod(F.xxhash64("own", F.lit(7)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rest.join(main, "key")
    left = rest.filter("label != main").select("key", part("lefts").alias("l"), each("rights").alias("r"), "own", "label", F.lit(True).alias("build"))
    right = rest.select("key", each("lefts").alias("l"), part("rights").alias("r"), "own", "label", F.lit(False).alias("build"))
    rows = left.unionByName(right).join(held, "own").select(F.xxhash64("key", "l", "r").alias("task"), "label", "build", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(have).combine_chunks()
            label, build = (t.column(k).to_numpy() for k in (1, 2))
            pairs = np.array(alike_across(label, build, t.column(3).combine_chunks(), shingle, least), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        now = None
        for b in batches:  # rows come sorted by task
            task = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if now is not None and task[s] != now:
                    yield done()
                    have = []
                now = task[s]
                have.append(b.slice(s, e - s))
        if have:
            yield done()

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _fingerprint_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """a, b: texts (own) that their fingerprints (fp) link; the first text of a fingerprint stands for it, the others link to it."""
    hubs = checkpoint(prints.groupBy("fp").agg(F.min("own").alias("hub")))
    same = prints.join(hubs, "fp").filter("own != hub").select(F.col("own").alias("a"), F.col("hub").alias("b"))
    end = lambda fp, name: hubs.select(F.col("fp").alias(fp), F.col("hub").alias(name))
    links = fingerprint_links(hubs, radius).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    near = links.join(end("fa", "a"), "fa").join(end("fb", "b"), "fb").select("a", "b")
    return checkpoint(same.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def similar_texts(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """node, label: text hashes (column own) have one label if links of alike shingles connect them; texts without a link are left out.

    Near copies are found by SimHash: fingerprints of the shingles that differ in ``radius`` bits or fewer, met in
    balls, their texts verified. A pair of just ``least`` differs in more bits than balls can bridge, so what these
    links leave apart has further candidates: texts that share a band of minima of their shingles. That chance
    depends on the pair's similarity alone, not on where the texts differ. Every text of a band key is tried with
    a hub first; what the exactly verified links leave apart is then tried pair by pair, so nothing is thinned
    that has not been verified.
    """
    tune(docs.sparkSession, 250)
    bands = bands_for(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array(band_keys(b.column(1), shingle, bands).view(np.int64).ravel())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bands), keys)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shingle_prints(b.column(1), shingle).view(np.int64)), keys], ["own", "fp", "keys"])

    prints = checkpoint(docs.select("own", "text").mapInArrow(run, "own long, fp long, keys array<long>").dropDuplicates(["own"]))
    copies = _fingerprint_pairs(prints.select("own", "fp"), radius)
    keyed = prints.select(F.explode("keys").alias("key"), "own")
    mask = F.xxhash64("key")  # another hub in each band
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("own")).alias("who"), F.min(F.col("own").bitwiseXOR(mask)).alias("hub")).filter("n > 1")
    shared = shared.groupBy("n", "who").agg(F.min(F.struct("key", "hub")).alias("one"))  # the same texts in several bands count once
    shared = checkpoint(shared.select("n", F.col("one.key").alias("key"), F.col("one.hub").alias("hub")))
    members = checkpoint(keyed.join(shared, "key").select("key", "own", F.col("hub").bitwiseXOR(mask).alias("hub"), "n"))
    # only texts that share a key or are linked are shuffled by their hash
    nodes = members.select(F.col("own").alias("node")).unionByName(copies.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    held = checkpoint(docs.select("own", "text").join(nodes.hint("shuffle_hash"), F.col("own") == F.col("node"), "left_semi").dropDuplicates(["own"]))
    links = checkpoint(_verified(copies, held, shingle, least))
    group = components(links)
    edges = members.filter("own != hub").select(F.least("own", "hub").alias("a"), F.greatest("own", "hub").alias("b")).distinct()
    for end in ("a", "b"):
        edges = edges.join(group.select(F.col("node").alias(end), F.col("label").alias(f"group_{end}")), end, "left")
    edges = edges.filter("not (group_a <=> group_b) or group_a is null").select("a", "b")
    labels = components(links.unionByName(_verified(edges, held, shingle, least)))
    more = components(_settled(members.filter("n > 2"), labels, held, shingle, least)).select(F.col("node").alias("group"), F.col("label").alias("whole"))
    joined = labels.join(more, F.col("label") == F.col("group"), "left").select("node", F.coalesce("whole", "label").alias("label"))
    alone = more.join(labels, F.col("group") == F.col("node"), "left_anti").select(F.col("group").alias("node"), F.col("whole").alias("label"))
    return checkpoint(joined.unionByName(alone))


def keep_first(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the first by doc_id, then by text; all columns stay.

    Groups are those of ``similar_texts``: SimHash, then bands, verified exactly. Rows that are equal in id and text count as one document.
    """
    p = prefix_for(docs.columns)
    own, last_id, last_own = f"{p}own", f"{p}id", f"{p}last"
    marked = docs.withColumn(own, F.xxhash64("text"))
    labels = similar_texts(marked.select(F.col(own).alias("own"), "text"), shingle, least)
    ids = checkpoint(marked.select("doc_id", F.col(own).alias("own")))
    # the first row of each text, then of each group of texts: hot texts combine before the shuffle
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("own").alias("own"))
    texts = ids.groupBy("own").agg(F.min(row).alias("row"))
    grouped = texts.join(labels, F.col("own") == F.col("node"), "left").groupBy(F.coalesce("label", "own").alias("label")).agg(F.min("row").alias("row"))
    kept = checkpoint(grouped.select(F.col("row.doc_id").alias(last_id), F.col("row.own").alias(last_own)))
    same = F.col("doc_id").eqNullSafe(F.col(last_id)) & (F.col(own) == F.col(last_own))
    rows = marked.join(kept.hint("shuffle_hash"), same, "left_semi")  # texts are shuffled, not sorted
    if ids.groupBy("doc_id", "own").count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", own])
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
