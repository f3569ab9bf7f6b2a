"""Language identification: a linear-chain conditional random field labels every word.

A word's features are its affixes of two and three letters, its letter triples, and itself where it is in the
lexicon of frequent sample words; transitions between the labels of neighbouring words are
learned with them. Training sequences are code-switched: stretches of labelled documents put one
after another. Word probabilities come from forward-backward over the whole text, and a
document's language is the one with the largest mean probability.

Only the training sample is bounded (``per_lang`` documents a language, ``sample_words`` words
of each); prediction reads whole texts. lang, source and ids are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.llm.common import fraction

#: Runs of letters; a longer run (scripts without spaces) is read in pieces.
WORD = re.compile(r"[^\W\d_]{1,32}")

#: Rows that ``predict`` takes apart at a time.
ROWS_AT_ONCE = 100


def features(word: str) -> list[str]:
    w = f"^{word}$"
    return [w, w[:3], w[:4], w[-3:], w[-4:], *[w[i:i + 3] + "3" for i in range(1, len(w) - 3)]]


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int]   # feature -> row of weights
    weights: np.ndarray     # (features, labels)
    bias: np.ndarray        # labels
    moves: np.ndarray       # (labels, labels): from, to
    start: np.ndarray       # labels


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray, step: int = 256, whole: bool = True):
    """Probability of each label at each word of one long chain in which ``first`` marks text starts.

    The chain is cut into blocks of ``step`` words; matrix products of all blocks are formed side
    by side, carried over the blocks, and then filled in. Returns (alpha, beta, emission, gamma); if not ``whole``,
    gamma alone, made in the place of alpha.
    """
    n, k = scores.shape
    blocks = max(1, -(-n // step))
    emit = np.ones((blocks * step, k))
    np.subtract(scores, scores.max(axis=1, keepdims=True), out=emit[:n])
    np.exp(emit[:n], out=emit[:n])
    cut = np.ones(blocks * step, bool)
    cut[:n] = first
    e, c = emit.reshape(blocks, step, k), cut.reshape(blocks, step)
    t, s = np.exp(moves - moves.max()), np.exp(start - start.max())
    block = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(step):
        moved = np.where(c[:, i, None, None], block.sum(-1, keepdims=True) * s, block @ t) * e[:, i, None, :]
        block = moved / moved.max(axis=(1, 2), keepdims=True)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    carry = np.full(k, 1.0 / k)
    for b in range(blocks):
        into[b] = carry
        carry = carry @ block[b]
        carry /= carry.sum()
    carry = np.full(k, 1.0 / k)
    for b in range(blocks - 1, -1, -1):
        out[b] = carry
        carry = block[b] @ carry
        carry /= carry.sum()
    alpha, beta = np.empty((blocks, step, k)), np.empty((blocks, step, k)) if whole else None
    for i in range(step):
        into = np.where(c[:, i, None], s, into @ t) * e[:, i]
        into = into / into.sum(axis=1, keepdims=True)
        alpha[:, i] = into
    for i in range(step - 1, -1, -1):
        if whole:
            beta[:, i] = out
        else:
            alpha[:, i] *= out
        seen = out * e[:, i]
        out = np.where(c[:, i, None], 1.0 / k, seen @ t.T)
        out = out / out.sum(axis=1, keepdims=True)
    alpha = alpha.reshape(-1, k)[:n]
    if not whole:
        alpha /= alpha.sum(axis=1, keepdims=True)
        return alpha
    beta = beta.reshape(-1, k)[:n]
    gamma = alpha * beta
    return alpha, beta, emit[:n], gamma / gamma.sum(axis=1, keepdims=True)


def fit(texts: list[tuple[str, list[str]]], rounds: int = 40, rate: float = 0.2, stretch: int = 25, decay: float = 1e-4) -> Model:
    """Train on (language, words) pairs; a fixed order and fixed seed give the same model each time."""
    langs = sorted({lang for lang, _ in texts})
    if not langs:
        return Model([], {}, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    pick = np.random.default_rng(17)
    pieces = []
    for lang, words in texts:
        at = 0
        while at < len(words):
            size = int(pick.integers(3, 2 * stretch))
            pieces.append((langs.index(lang), words[at:at + size]))
            at += size
    order = pick.permutation(len(pieces))
    sequence = [(label, w) for p in order for label in [pieces[p][0]] for w in pieces[p][1]]
    types = {w: i for i, w in enumerate(dict.fromkeys(w for _, w in sequence))}
    seen = Counter(f for w in types for f in features(w))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1 or f.startswith("^") and f.endswith("$")))}
    own, feats = [], []
    for w, i in types.items():
        found = [index[f] for f in features(w) if f in index]
        own += [i] * len(found)
        feats += found
    own, feats = np.array(own), np.array(feats)
    n, k = len(sequence), len(langs)
    word = np.array([types[w] for _, w in sequence])
    gold = np.eye(k)[[label for label, _ in sequence]]
    first = np.zeros(n, bool)
    first[::400] = True  # sequences of 400 words
    params = [np.zeros((len(index), k)), np.zeros(k), np.zeros((k, k)), np.zeros(k)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold_moves = gold[:-1][~first[1:]].T @ gold[1:][~first[1:]]
    for r in range(1, rounds + 1):
        by_type = np.stack([np.bincount(own, params[0][feats, j], len(types)) for j in range(k)], 1)
        alpha, beta, emit, gamma = marginals(by_type[word] + params[1], first, params[2], params[3])
        inner = ~first[1:]
        joint = alpha[:-1][inner][:, :, None] * np.exp(params[2] - params[2].max()) * (emit[1:] * beta[1:])[inner][:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        off = gold - gamma
        typed = np.stack([np.bincount(word, off[:, j], len(types)) for j in range(k)], 1)
        slope = [np.stack([np.bincount(feats, typed[own, j], len(index)) for j in range(k)], 1), off.sum(0), gold_moves - joint.sum(0), off[first].sum(0)]
        for p, g, m, v in zip(params, slope, mean, square):
            g = g / n - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-7)
    return Model(langs, index, params[0].astype(np.float32), params[1], params[2], params[3])


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_lang: int = 150, sample_words: int = 200) -> Model:
    """Fit on a sample of ``labelled``: per language the ``per_lang`` documents with the smallest
    pseudo-random number of their id, ``sample_words`` words of each. Rows with a NULL are not used."""
    rows = labelled.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).dropna()
    rank = F.row_number().over(Window.partitionBy("l").orderBy(fraction("d"), "d"))
    ids = [r.d for r in rows.select("d", "l").withColumn("r", rank).where(F.col("r") <= per_lang).collect()]
    found = rows.where(F.col("d").isin(ids)).dropDuplicates(["d"]).collect() if ids else []
    pick, texts = np.random.default_rng(5), []
    for r in sorted(found, key=lambda r: r.d):
        words = WORD.findall(r.t.lower())
        at = int(pick.integers(0, max(1, len(words) - sample_words + 1)))
        if words:
            texts.append((r.l, words[at:at + sample_words]))
    return fit(texts)


class Tagger:
    """Scores of words under a model, with a memo of at most ``limit`` words between batches."""

    def __init__(self, model: Model, limit: int = 100_000) -> None:
        self.model, self.limit = model, limit
        self.weights = np.vstack([model.weights, np.zeros((1, len(model.langs)), np.float32)])
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)), np.float32)

    def _add(self, words: list[str]) -> None:
        """Score ``words`` and append them to the memo."""
        get, none = self.model.index.get, len(self.weights) - 1
        flat, starts = [], []
        for w in words:
            starts.append(len(flat))
            flat += [get(f, none) for f in features(w)]
        scores = np.add.reduceat(self.weights[flat], starts, axis=0) + self.model.bias.astype(np.float32)
        self.rows.update(zip(words, range(len(self.table), len(self.table) + len(words))))
        self.table = np.concatenate([self.table, scores])

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        """Label probabilities of all words of all texts, one after another."""
        if len(self.rows) > self.limit:
            self.clear()
        new = set().union(*texts).difference(self.rows)
        if new:
            self._add(list(new))
        ids = np.fromiter((self.rows[w] for words in texts for w in words), np.int64, sum(map(len, texts)))
        first = np.zeros(len(ids), bool)
        first[np.cumsum([0, *map(len, texts)])[:-1]] = True
        return marginals(self.table[ids].astype(float), first, self.model.moves, self.model.start, whole=False)


def _groups(texts: list[list[str]], words: int) -> Iterator[range]:
    """Ranges of texts of about ``words`` words; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > words:
            yield range(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield range(at, len(texts))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] = (), words_at_once: int = 300_000) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score (mean probability of lang_pred).

    NULL, empty texts and texts without a letter give ``und`` with score 0; so does every text
    where the model has learned no language.
    """
    kept = docs.select(*keep).schema
    sent = [*keep] if text in keep else [*keep, text]
    at_text = sent.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            # What comes in is handed on in pieces, with its texts: nothing of a batch's size is made besides it, here or by the reader.
            for rows in (batch.slice(at, ROWS_AT_ONCE) for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
                lang, score = ["und"] * rows.num_rows, [0.0] * rows.num_rows
                part = [WORD.findall(x.lower()) if (x := v.as_py()) else [] for v in rows.column(at_text)]
                some = [i for i, words in enumerate(part) if model.langs and any(map(str.isalpha, words))]
                full = [part[i] for i in some]
                for group in _groups(full, words_at_once):
                    texts = [full[i] for i in group]
                    p = tagger.probabilities(texts)
                    ends = np.cumsum([0, *map(len, texts)])
                    mean = np.add.reduceat(p, ends[:-1], axis=0) / np.diff(ends)[:, None]
                    for i, row in zip(group, mean):
                        best = int(row.argmax())
                        lang[some[i]], score[some[i]] = model.langs[best], float(min(1.0, row[best]))
                yield pa.RecordBatch.from_arrays([*rows.columns[:len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 [*rows.schema.names[:len(keep)], "lang_pred", "score"])

    out = kept.add("lang_pred", "string").add("score", "double")
    return docs.select(*sent).mapInArrow(label, out)


def label_words(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word of code-switched texts: doc_id, position (from 0), word, lang, probability."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                words = WORD.findall((value.as_py() or "").lower())
                if words and model.langs:
                    p = tagger.probabilities([words])
                    best = p.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(words), pa.int64()), pa.array(range(len(words)), pa.int64()), pa.array(words),
                         pa.array([model.langs[b] for b in best]), pa.array(p.max(axis=1))], ["doc_id", "position", "word", "lang", "probability"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        label, "doc_id long, position long, word string, lang string, probability double")
