"""Language identification of mixed-language text.

A word's script (by code-point range) leaves only the languages that are
written in it; hashed byte trigrams score the word in each of them. A Viterbi
path over the words of a text, with a penalty for each switch of language,
labels every word; runs of one label are spans. A text's language is the one
with most letters on the path, its score that share of the letters.

Counts cover all texts that may be learnt from. The model is a table of
``2 ** BITS`` trigram cells by language, a quarter of a megabyte each, which
goes to the tasks with their code; more than ``MOST_LANGUAGES`` languages are
an error, since the path takes the square of their number. The
path is found for all texts of a batch at once: texts are cut into segments of
``SEGMENT`` words, solved together for every state a segment can start in, and
chained per text.

Defined results: a null text, or one without a letter, is ``und`` with score
0, as is any text if nothing could be learnt; rows with a null language teach
nothing; on a tie the smaller language name wins; repeated rows come out once
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, bounded_rows, byte_table, inside_words, portions, spans, tune

UNKNOWN = "und"
MOST_LANGUAGES = 512
BITS = 16
SEGMENT = 128
#: Segments that are solved together hold at most so many cells of languages squared.
CELLS = 1 << 22
#: First code point of each script range, its end, its name.
SCRIPTS = [
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]
SCRIPT_NAMES = sorted({name for *_, name in SCRIPTS}) + ["other"]
#: Share of a language's words from which it counts as written in a script.
SCRIPT_SHARE = 0.005
#: What a word costs in a language that is not written in its script.
WRONG_SCRIPT = -50.0

LETTERS = byte_table(lambda b: b >= 128 or chr(b).isalpha())


def _script_table() -> np.ndarray:
    """Script number by the first 16 bits of a code point."""
    out = np.full(1 << 16, len(SCRIPT_NAMES) - 1, np.uint8)
    for low, high, name in SCRIPTS:
        out[low : high + 1] = SCRIPT_NAMES.index(name)
    return out


SCRIPT_OF = _script_table()


class Words:
    """Words of a batch: spans of letters, their script, and the hashed trigrams of each byte in its word."""

    def __init__(self, texts: pa.Array, bits: int):
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        empty, stop = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        raw, offs = batch_bytes(pc.binary_join_element_wise(texts, empty, stop))
        self.starts, self.ends, self.row = spans(raw, offs, LETTERS)
        self.letters = self.ends - self.starts
        inside = inside_words(raw, LETTERS)
        # a word's code point is enough for its script: that of its first letter
        first = np.pad(raw, (0, 4))[self.starts[:, None] + np.arange(3)].astype(np.int64) if len(self.starts) else np.zeros((0, 3), np.int64)
        a, b, c = first.T
        point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, 0)))
        self.script = SCRIPT_OF[point & 0xFFFF]
        # trigrams end at each letter and at the byte after the word; outside the word is a blank
        x = np.where(inside, raw, 32).astype(np.uint32)
        back = np.concatenate([[32], x[:-1]]).astype(np.uint32)
        back2 = np.where(back == 32, 32, np.concatenate([[32, 32], x[:-2]])[: len(x)]).astype(np.uint32)
        self.gram = ((back2 << 16 | back << 8 | x) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)

    def taught(self) -> np.ndarray:
        """All trigrams of words, end marks included."""
        use = np.zeros(len(self.gram), bool)
        for at in (self.starts, self.ends):
            use[at] = True
        step = np.zeros(len(self.gram) + 1, np.int8)
        step[self.starts] += 1
        step[np.minimum(self.ends + 1, len(self.gram))] -= 1
        return np.cumsum(step[:-1]) > 0

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum over each word's trigrams of the table's rows: words x languages."""
        out = np.empty((len(self.starts), table.shape[1]), np.float32)
        for l in range(table.shape[1]):
            total = np.zeros(len(self.gram) + 1)
            np.cumsum(np.ascontiguousarray(table[:, l]).take(self.gram), dtype=np.float64, out=total[1:])
            out[:, l] = total[self.ends + 1] - total[self.starts]
        return out


def viterbi(scores: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word, words of a text in order, a switch costing ``penalty``."""
    n, k = scores.shape
    path = np.zeros(n, np.int32)
    if not n or k < 2:
        return path
    # texts in groups that fit in memory; a longer text is its own group
    cuts = np.flatnonzero(np.diff(row, prepend=-1))
    most = max(1, CELLS // (k * k))
    at = 0
    bounds = [*cuts.tolist(), n]
    i = 0
    while i < len(cuts):
        j = i + 1
        while j < len(cuts) and bounds[j + 1] - at <= most:
            j += 1
        path[at : bounds[j]] = _viterbi_group(scores[at : bounds[j]], row[at : bounds[j]], penalty)
        at, i = bounds[j], j
    return path


def _viterbi_group(scores: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    n, k = scores.shape
    first = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(first, append=n)
    parts = -(-count // SEGMENT)
    text = np.repeat(np.arange(len(first)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[text] + nth * SEGMENT
    size = np.minimum(SEGMENT, count[text] - nth * SEGMENT)
    steps = int(size.max())
    order = np.argsort(-size, kind="stable")  # the segments still running are a prefix
    live = np.searchsorted(-size[order], -np.arange(steps), "left")
    begin = start[order]
    m = len(order)
    # best[s, a, b]: segment s, entered in language a, now in b
    best = np.where(np.eye(k, dtype=bool), 0.0, -np.inf).astype(np.float32)[None].repeat(m, 0)
    moved = np.zeros((steps, m, k, k), bool)
    origin = np.zeros((steps, m, k), np.int16)
    for t in range(steps):
        w = live[t]
        now = best[:w]
        top = now.max(axis=2)
        origin[t, :w] = now.argmax(axis=2)
        jump = (top - penalty)[:, :, None]
        moved[t, :w] = jump > now
        best[:w] = np.maximum(now, jump) + scores[begin[:w] + t][:, None, :]
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    # chain a text's segments; all texts take their next segment together
    state = np.zeros((len(first), k), np.float32)
    enter = np.zeros((m, k), np.int16)
    offset = np.cumsum(parts) - parts
    for p in range(int(parts.max())):
        these = np.flatnonzero(parts > p)
        seg = place[offset[these] + p]
        through = state[these][:, :, None] + best[seg]
        enter[seg] = through.argmax(axis=1)
        state[these] = through.max(axis=1)
        state[these] -= state[these].max(axis=1, keepdims=True)
    last = np.zeros(m, np.int64)
    entered = np.zeros(m, np.int64)
    end = state.argmax(axis=1)
    for p in range(int(parts.max()) - 1, -1, -1):
        these = np.flatnonzero(parts > p)
        seg = place[offset[these] + p]
        last[seg] = end[these]
        entered[seg] = enter[seg, end[these]]
        end[these] = entered[seg]
    path = np.zeros(n, np.int32)
    now = last.copy()
    every = np.arange(m)
    for t in range(steps - 1, -1, -1):
        w = live[t]
        some = every[:w]
        path[begin[:w] + t] = now[:w]
        now[:w] = np.where(moved[t, some, entered[:w], now[:w]], origin[t, some, entered[:w]], now[:w])
    return path


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, scripts: np.ndarray, bits: int, penalty: float):
        self.languages, self.table, self.scripts, self.bits, self.penalty = languages, table, scripts, bits, penalty

    def label(self, texts: pa.Array) -> tuple[Words, np.ndarray]:
        """The words of a batch, and the number of the language of each."""
        words = Words(texts, self.bits)
        scores = words.sums(self.table)
        if len(scores):
            scores += self.scripts[words.script]
        return words, viterbi(scores, words.row, self.penalty)

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each text, a portion of the texts at a time."""
        lang: list[str] = []
        score: list[float] = []
        for part in portions(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
            some = self._predict(part.column(0))
            lang += some[0]
            score += some[1]
        return lang, score

    def _predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        n, k = len(texts), len(self.languages)
        known = _has_letter(texts)
        if not k:
            return [UNKNOWN] * n, [0.0] * n
        words, path = self.label(texts)
        share = np.bincount(words.row * k + path, weights=words.letters, minlength=n * k).reshape(n, k)
        total = share.sum(axis=1)
        known &= total > 0
        best = share.argmax(axis=1)
        score = np.where(known, share[np.arange(n), best] / np.maximum(total, 1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], score.tolist()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(language, first byte, end byte) of the runs of one language, in bytes of the lower-cased text."""
        words, path = self.label(pa.array([text]))
        cuts = np.flatnonzero(np.diff(path, prepend=-1))
        ends = [*cuts[1:], len(path)]
        return [(self.languages[path[a]], int(words.starts[a]), int(words.ends[b - 1])) for a, b in zip(cuts, ends, strict=True)]


def _has_letter(texts: pa.Array) -> np.ndarray:
    ascii_letter = pc.match_substring_regex(texts, "[A-Za-z]")
    out = pc.fill_null(ascii_letter, False).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
    return out


def train(docs: DataFrame, penalty: float = 6.0) -> Model:
    """Learns from text and lang of every row of ``docs`` whose lang is not null."""
    tune(docs.sparkSession)
    taught = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r.lang for r in bounded_rows(taught.select("lang").distinct(), MOST_LANGUAGES, "languages"))
    if not languages:
        return Model([], np.zeros((1, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), np.float32), 8, penalty)
    bits, cells = BITS, 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = {}  # by language: trigram cells, then scripts
        for b in (part for whole in batches for part in portions(whole, 1)):
            words = Words(b.column(1), bits)
            langs = b.column(0).dictionary_encode()
            names = langs.dictionary.to_pylist()
            code = langs.indices.to_numpy(zero_copy_only=False)
            use = words.taught()
            step = np.zeros(len(use) + 1, np.int64)
            np.add.at(step, words.starts, 1)
            number = code[words.row][np.maximum(np.cumsum(step[:-1]) - 1, 0)] if len(words.row) else np.zeros(0, np.int64)
            for i, name in enumerate(names):
                have = grams.setdefault(name, np.zeros(cells + len(SCRIPT_NAMES), np.int64))
                have[:cells] += np.bincount(words.gram[use & (number == i)] if len(number) else [], minlength=cells)
                have[cells:] += np.bincount(words.script[code[words.row] == i], minlength=len(SCRIPT_NAMES))
        for name, have in grams.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(have[at])], ["lang", "cell", "n"])

    counted = taught.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), cells + len(SCRIPT_NAMES)), np.float64)
    found = counted.toArrow()  # at most MOST_LANGUAGES x cells rows
    number = {name: i for i, name in enumerate(languages)}
    lang = found.column(0).combine_chunks().dictionary_encode()
    if len(found):
        code = np.array([number[x] for x in lang.dictionary.to_pylist()])[lang.indices.to_numpy()]
        counts[code, found.column(1).to_numpy()] = found.column(2).to_numpy()
    grams, scripts = counts[:, :cells], counts[:, cells:]
    seen = max(1, int((grams.sum(axis=0) > 0).sum()))
    logs = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * seen))
    logs -= logs.max(axis=0, keepdims=True)  # only differences count
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    written = share >= SCRIPT_SHARE
    written |= ~written.any(axis=0, keepdims=True)  # a script that no language has leaves all of them
    return Model(languages, np.ascontiguousarray(logs.T.astype(np.float32)), np.where(written.T, 0.0, WRONG_SCRIPT).astype(np.float32), bits, penalty)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of ``keep``, lang_pred, score of every row of ``docs``."""
    tune(docs.sparkSession)
    names = ["doc_id", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = model.predict(b.column(len(names)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    return docs.select(*names, "text").mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """``docs`` without rows of unknown language, or of a score below ``least``; all columns stay."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = model.predict(b.column(at))
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
