"""Toxicity: a counterfactual-regularised linear classifier over whole texts.

Features of a text: for every distinct lower-cased word, the word and its prefixes of 4 to 9
characters (inflected forms share them), hashed to ``2**BITS`` slots; a feature's value is the number
of distinct words that have it, over the square root of the text's distinct words in fifties.
The ``n_features`` slots that separate the labels best are kept, and besides them all slots of the groups' names.

Training: logistic loss over a bounded, deterministic sample of labelled rows (at most about
``max_train``, a documented bound: rows are taken by a hash of their id) and over the same texts with a mention of one group added, under the same
label (a checksum of the text chooses the name), an L2 term, and the counterfactual term, the mean squared change of the raw score over three
kinds of pairs:

* every sentence of the sampled texts that names a group of people, against the same sentence with each term swapped for the
  next of its kind;
* every sentence of the sampled texts with a term of the list added, against the same with the next term of its kind.  These
  mentions hold the weights of a group's name, and those that it shares with other words (its prefixes), where the labelled texts name no group;
* every such sentence with a term added, against the sentence as it is, so that all names together do not move a score either.

Texts with an added mention tell the classifier that a mention alone changes no label; what chance makes of one name and not of another,
the penalty takes out.  A group's name therefore carries no score of its own, which lowers false positives on neutral mentions.  The squared changes
are a quadratic form of the weights, so what comes to the driver of all pairs is one sum per pair of features, in whole
numbers that no order of tasks changes.  The terms are a parameter.

Scoring is one pass without shuffle; the model that is broadcast has ``n_features`` weights.

Defined results: null or empty text has the score of the bias alone; texts of any length are
read whole; repeated rows get equal scores; rows without an id are scored, not learnt from; unlabelled or null-labelled rows are not
learnt from; an id is learnt from once for each of its texts and labels; of slots that separate the labels equally well the lower ones are
kept; without labels of both kinds the score is the smoothed base rate; other columns, whatever their names, are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

BITS = 20
CHUNK = 1 << 14
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")

#: Names of groups of people, by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("transgender", "cisgender"), ("deaf", "blind", "disabled"), ("old", "young"),
    ("immigrant", "native", "refugee"),
    ("chrétien", "musulman", "juif"), ("homme", "femme"), ("christlich", "muslimisch", "jüdisch"),
    ("mann", "frau"), ("cristiano", "musulmán", "judío"), ("hombre", "mujer"),
)


def swaps_of(terms: Sequence[Sequence[str]]) -> dict[str, str]:
    """Every term with the next of its kind."""
    return {t.lower(): kind[(i + 1) % len(kind)].lower() for kind in terms for i, t in enumerate(kind) if len(kind) > 1}


def scale(words: int) -> float:
    return float(np.sqrt(1.0 + words / 50.0))


class Features:
    """Hashed features of words, remembered per task up to a bound."""

    def __init__(self, max_words: int = 100_000):
        self.max_words, self.words = max_words, {}

    def of_word(self, word: str) -> list[int]:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= self.max_words:
                self.words.clear()
            keys = ["=" + word, *["^" + word[:k] for k in range(4, 10) if len(word) >= k]]
            got = self.words[word] = [zlib.crc32(k.encode("utf-8", "replace")) & ((1 << BITS) - 1) for k in keys]
        return got

    def of_text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = set(_WORD.findall((text or "").lower()))
        slots = [s for w in words for s in self.of_word(w)]
        if not slots:
            return np.zeros(0, np.int64), np.zeros(0)
        index, count = np.unique(np.array(slots, np.int64), return_counts=True)
        return index, count / scale(len(words))


def sentences(text: str | None) -> list[str]:
    return _SENTENCE.findall((text or "").lower())


def swapped(sentence: str, swaps: Mapping[str, str]) -> str:
    return _WORD.sub(lambda m: swaps.get(m[0], m[0]), sentence)


@dataclass
class Model:
    index: np.ndarray  # sorted slots
    weight: np.ndarray
    bias: float
    pairs: int = 0  # sentences that name a group
    mentions: int = 0  # sentences with a mention added, times terms
    touched: int = 0  # weights that the counterfactual term acts on

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        if not len(index) or not len(self.index):
            return self.bias
        at = np.minimum(np.searchsorted(self.index, index), len(self.index) - 1)
        return float(self.bias + (self.weight[at] * value * (self.index[at] == index)).sum())


def _best_slots(sample: DataFrame, n: int, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` slots that separate the labels best, and which of them any text has.  The sample is bounded, so are its tasks.

    Counts of all slots stay in the tasks: the driver gets the best of every chunk of slots.
    """
    p = n1 / (n0 + n1)

    def count(batches):
        features, seen = Features(), np.zeros((2, 1 << BITS), np.int32)
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                seen[int(label)][features.of_text(text)[0]] += 1
        for c in range((1 << BITS) // CHUNK):
            part = seen[:, c * CHUNK : (c + 1) * CHUNK]
            if part.any():
                yield pd.DataFrame({"chunk": [c], "counts": [part.tobytes()]})

    def best(pdf):
        total = np.zeros((2, CHUNK), np.int64)
        for counts in pdf["counts"]:
            total += np.frombuffer(counts, np.int32).reshape(2, CHUNK)
        one, both = total[1].astype(float), total.sum(axis=0).astype(float)
        z = np.abs(one - p * both) / np.sqrt(both * p * (1 - p) + 1.0)
        at = np.argsort(-z, kind="stable")[:n]
        return pd.DataFrame({"slot": int(pdf["chunk"].iloc[0]) * CHUNK + at, "z": z[at], "seen": both[at] > 0})

    # a chunk that no text has counts too: its slots separate nothing, as do those that both labels have alike
    counts = sample.select("text", "label").mapInPandas(count, "chunk int, counts binary")
    none = sample.sparkSession.range((1 << BITS) // CHUNK).select(F.col("id").cast("int").alias("chunk"), F.lit(bytes(8 * CHUNK)).alias("counts"))
    got = counts.unionByName(none).groupBy("chunk").applyInPandas(best, "slot int, z double, seen boolean").toArrow()
    slot, z, seen = (got[c].to_numpy() for c in ("slot", "z", "seen"))
    first = np.lexsort((slot, -z))[:n]
    return slot[first], seen[first]


def _csr(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = [len(c) for c, _ in rows]
    if not sum(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat(np.arange(len(rows)), lengths), np.concatenate([c for c, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows])


class Rows:
    """Features of texts, row after row, in 8 bytes each; products with weights go block by block."""

    def __init__(self, lengths: np.ndarray, cols: np.ndarray, counts: np.ndarray, over: np.ndarray, block: int = 1 << 16):
        ends = np.cumsum(lengths, dtype=np.int64)
        self.lengths, self.cols, self.counts, self.over = lengths, cols, counts, over
        cut = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, block), side="left"))
        self.blocks = [(a, b, int(ends[a] - lengths[a]), int(ends[b - 1])) for a, b in zip(cut, np.append(cut[1:], len(ends)))]

    def _parts(self):
        """(first row, row after the last, place of each feature's row, its column, its value)."""
        for a, b, at, end in self.blocks:
            row = np.repeat(np.arange(b - a), self.lengths[a:b])
            yield a, b, row, self.cols[at:end].astype(np.intp), self.counts[at:end] / self.over[a:b][row]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.lengths))
        for a, b, row, col, val in self._parts():
            out[a:b] = np.bincount(row, weights=w[col] * val, minlength=b - a)
        return out

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for a, b, row, col, val in self._parts():
            np.add.at(out, col, g[a:b][row] * val)
        return out


UNIT = 1 << 32  # of the counterfactual sums


def _within(index: np.ndarray, slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``index`` of the slots that it has, with their values."""
    if not len(index) or not len(slots):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(index, slots), len(index) - 1)
    hit = index[at] == slots
    return at[hit], values[hit]


def _change(features: Features, index: np.ndarray, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    (ca, xa), (cb, xb) = _within(index, *features.of_text(a)), _within(index, *features.of_text(b))
    delta = np.bincount(np.append(ca, cb).astype(np.int64), weights=np.append(xa, -xb))
    at = np.flatnonzero(np.abs(delta) > 1e-12)
    return at, delta[at]


def counterfactuals(sample: DataFrame, index: np.ndarray, terms: Sequence[Sequence[str]]) -> tuple[tuple, int, int]:
    """((rows, columns, values) of the mean outer product of changes, number of pairs, number of mentions, the same sums for mentions against none).

    A change is what swapping terms does to a sentence's features; sums are of whole numbers, one per pair of features that any change has.
    """
    swaps = swaps_of(terms)

    def run(batches):
        features, sums = Features(), {}
        count = room = pairs = 0

        for pdf in batches:
            for text in pdf["text"]:
                for sentence in sentences(text):
                    words = _WORD.findall(sentence)
                    count += 1
                    room += round(UNIT / scale(len(set(words)) + 1) ** 2)
                    if swaps.keys().isdisjoint(words):
                        continue
                    pairs += 1
                    at, delta = _change(features, index, sentence, swapped(sentence, swaps))
                    outer = np.rint(np.outer(delta, delta) * UNIT).astype(np.int64).ravel().tolist()
                    for i, j, v in zip(np.repeat(at, len(at)).tolist(), np.tile(at, len(at)).tolist(), outer):
                        sums[i, j] = sums.get((i, j), 0) + v
        rows = [(-1, 0, pairs), (-2, 0, count), (-3, 0, room), *((i, j, v) for (i, j), v in sums.items())]
        yield pd.DataFrame(rows, columns=["i", "j", "v"])

    total = F.sum(F.col("v").cast("decimal(38,0)")).alias("v")
    got = {(r.i, r.j): int(r.v) for r in sample.select("text").mapInPandas(run, "i int, j int, v long").groupBy("i", "j").agg(total).collect()}
    pairs, count, room = (got.pop((k, 0), 0) for k in (-1, -2, -3))
    mean = {at: v / UNIT / pairs for at, v in got.items()}
    features, single = Features(), {}

    def add(to: dict, at: np.ndarray, delta: np.ndarray) -> None:
        for x, i in enumerate(at.tolist()):
            for y, j in enumerate(at.tolist()):
                to[i, j] = to.get((i, j), 0.0) + part * delta[x] * delta[y]

    if count and swaps:
        # a mention adds the features of its words to the sentence's; the change is theirs, over the sentence's scale
        part = room / UNIT / count / len(swaps) * scale(1) ** 2
        for a, b in swaps.items():
            add(mean, *_change(features, index, a, b))
            add(single, *_within(index, *features.of_text(a)))

    def arrays(sums: dict) -> tuple:
        keys = sorted(sums)
        return np.array([i for i, _ in keys], np.int64), np.array([j for _, j in keys], np.int64), np.array([sums[k] for k in keys], float)

    return arrays(mean), pairs, count * len(swaps), arrays(single)


def optimise(x: Rows, y: np.ndarray, mentions, changes, n_features: int, *, l2: float, fairness: float, positive_weight: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Adam on logistic loss + l2 |w|^2 / 2 + fairness * w . M w, M the mean outer product of ``changes``; full batches, no randomness.

    ``mentions`` is (has, shrink, features): of each text whether it also counts with a mention, by how much the mention shrinks its own
    features, and the features that the mention adds.
    """
    has, shrink, (arow, acol, aval) = mentions
    mrow, mcol, mval = changes
    w = np.zeros(n_features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    cost = np.where(y == 1, positive_weight, 1.0) / (len(y) + has.sum())
    slope = lambda raw: 1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40))) - y
    for t in range(1, steps + 1):
        own = x.times(w)
        g = slope(own + w[-1]) * cost
        also = slope(own * shrink + np.bincount(arow, weights=w[acol] * aval, minlength=len(y)) + w[-1]) * cost * has
        grad = np.append(x.back(g + also * shrink, n_features), g.sum() + also.sum())
        grad[:-1] += np.bincount(acol, weights=also[arow] * aval, minlength=n_features) + l2 * w[:-1]
        if len(mval):
            grad[:-1] += 2.0 * fairness * np.bincount(mrow, weights=mval * w[mcol], minlength=n_features)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def mention_of(text: str | None, names: Sequence[str]) -> int:
    """Which of ``names`` is added to a text; -1 for none, where there are no names or the text has this one."""
    if not names:
        return -1
    k = zlib.crc32((text or "").encode("utf-8", "replace")) % len(names)
    return -1 if names[k] in _WORD.findall((text or "").lower()) else k


def fit(
    docs: DataFrame, labels: DataFrame, *, max_train: int = 40_000, n_features: int = 2048, l2: float = 1e-5, fairness: float = 1.0,
    positive_weight: float = 3.0, identity_terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> Model:
    """Learn from ``labels`` (doc_id, label 0/1) of ``docs`` (doc_id, text).

    At most about ``max_train`` labelled rows are used (an id's hash decides), so the label table that is
    broadcast and the sample are bounded; all sentences of the sample take part in the counterfactual term, of which
    sums over pairs of the ``n_features`` features come to the driver.
    """
    known = labels.where("label is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    n = known.count()
    share = min(1.0, max_train / max(n, 1))
    known = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sample = texts.join(F.broadcast(known), "doc_id").withColumn("sha", F.sha2("text", 256)).dropDuplicates(["doc_id", "label", "sha"])
    sample = materialize(sample.select("doc_id", "text", "label"))
    sizes = dict(sample.groupBy("label").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    base = (n1 + 1.0) / (n0 + n1 + 2.0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(base / (1 - base))))
    names = sorted(swaps_of(identity_terms))
    of_name = [np.unique(np.concatenate([Features().of_word(w) for w in _WORD.findall(name)])) for name in names]
    best, seen = _best_slots(sample, n_features, n0, n1)
    index = np.unique(np.concatenate([best[seen], *of_name])).astype(np.int64)
    narrow = "<u2" if len(index) < 1 << 16 else "<u4"

    def project(batches):
        features = Features()
        for pdf in batches:
            out = []
            for doc_id, text, label in zip(pdf["doc_id"], pdf["text"], pdf["label"]):
                words, (slots, x) = len(set(_WORD.findall((text or "").lower()))), features.of_text(text)
                c, x = _within(index, slots, np.rint(x * scale(words)))
                out.append((doc_id, int(label), words, mention_of(text, names), c.astype(narrow).tobytes(), x.astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "label", "words", "name", "cols", "counts"])

    # what the driver holds of the sample: 6 bytes for each of the kept features of a text
    learnt = sample.mapInPandas(project, "doc_id long, label int, words int, name int, cols binary, counts binary").toArrow()
    label, words, name, doc = (learnt[c].to_numpy() for c in ("label", "words", "name", "doc_id"))
    cols, counts = learnt["cols"].to_pylist(), learnt["counts"].to_pylist()
    del learnt
    order = np.array(sorted(range(len(doc)), key=lambda i: (doc[i], label[i], words[i], cols[i], counts[i])))
    cols, counts = [cols[i] for i in order], [counts[i] for i in order]
    y, words, name = label[order].astype(float), words[order], name[order]
    own, has = np.sqrt(1.0 + words / 50.0), (name >= 0).astype(float)
    x = Rows(np.array([len(c) // 4 for c in counts]), np.frombuffer(b"".join(cols), narrow), np.frombuffer(b"".join(counts), "<u4"), own)
    del cols, counts
    after = np.array([scale(w + len(_WORD.findall(names[k]))) if k >= 0 else scale(w) for w, k in zip(words.tolist(), name.tolist())])
    alone = [_within(index, *Features().of_text(name)) for name in names]  # of a name by itself
    added = _csr([(alone[k][0], alone[k][1] * scale(len(_WORD.findall(names[k]))) / s) if k >= 0 else (np.zeros(0, np.int64), np.zeros(0)) for k, s in zip(name.tolist(), after)])
    changes, pairs, mentions, single = counterfactuals(sample, index, identity_terms)
    touched, changes = len(np.unique(changes[0])), tuple(np.concatenate(both) for both in zip(changes, single))
    w, bias = optimise(x, y, (has, own / after, added), changes, len(index), l2=l2, fairness=fairness, positive_weight=positive_weight)
    return Model(index, w, bias, pairs, mentions, touched)


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Score of a text column, in Arrow batches."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, m = Features(), sent.value
        for texts in batches:
            raw = np.array([m.raw(*features.of_text(t)) for t in texts], float)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40))))

    return run(text)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    value = score_column(docs.sparkSession, model, F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("doc_id"), value.alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
