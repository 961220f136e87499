"""Document scores by masked pseudo-likelihood under a bidirectional window network.

Every word is predicted from the two words on either side, by a softmax of two levels that are both trained in numpy and both see both sides.

* Class. Frequent words are classes of their own; all others are clustered by the words beside them. A context is (group of the word two back, class before, class after, group of the word
  two ahead), so the corpus's windows are a table of counts of (context, class). The network (embeddings of the four places, a tanh layer, softmax over classes) is trained on that whole table.
* Word within its class: a softmax whose scores are a weight for (word, class before) and one for (word, class after), with its exact normaliser for each (class, before, after). The weights are
  fitted to the corpus's counts of words beside classes by scaling them in turn until what the layer expects is what the corpus holds. The vocabulary's words are leaves of their own, all others
  share leaves by hash, and are spelled by the corpus's byte bigrams within them.

A document's score ``log_likelihood`` is the sum of the log probabilities of all its words, each given its two sides; ``per_word`` is the mean. All counts are sums over all documents: words are counted
whole, and the vocabulary follows their number (a 64th of the distinct words, within ``LEAST_VOCABULARY`` and ``MOST_VOCABULARY``). Training starts from a fixed seed, so a run repeats.

What reaches the driver, and goes to the tasks, is bounded by the classes and the vocabulary's bound, not by the corpus. Scoring shuffles nothing.

Edge cases: null, empty and blank texts have no words, score 0 and a null mean; repeated rows are scored each and count each; ids may be null; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietus.session import cut

#: Leaves that words beyond the vocabulary share, classes of one word, all classes with the text's end, groups of the outer places.
SHARED, OWN, CLASSES, GROUPS = 256, 10, 32, 3
#: Words that are leaves: a share of the distinct words, within these.
LEAST_VOCABULARY, MOST_VOCABULARY, SHARE = 4096, 16_384, 64
END = CLASSES - 1
CONTEXTS = GROUPS * CLASSES * CLASSES * GROUPS
#: Words whose neighbourhood tells clusters apart.
ANCHORS = 31
#: Entries a task counts before it hands them on, and words it remembers: they bound its memory.
HELD, REMEMBERED = 400_000, 400_000
#: Words that are gone through together, at least.
RUN = 1 << 13


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class _Hashes(dict):
    """word -> its hash, for one worker process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 17)
        return value


_HASHES = _Hashes()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def runs(texts) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, number of words of each text) of some texts at a time: enough to go through them together, few enough to hold."""
    words: list[bytes] = []
    sizes: list[int] = []
    for text in texts:
        found = words_of(text.as_py()) if text.is_valid else []
        words += found
        sizes.append(len(found))
        if len(words) >= RUN:
            yield words, np.array(sizes, np.int64)
            words, sizes = [], []
    if sizes:
        yield words, np.array(sizes, np.int64)


def spread(values: np.ndarray, sizes: np.ndarray, edge) -> tuple[np.ndarray, np.ndarray]:
    """(values with two edges before, between and after texts, place of each word in them)."""
    at = np.arange(len(values)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    out = np.full(len(values) + 2 * (len(sizes) + 1), edge, values.dtype)
    out[at] = values
    return out, at


@dataclass
class Lexicon:
    """Leaf of each vocabulary word by its hash, ``known`` in rising order; leaf ``size`` and up are shared."""

    known: np.ndarray
    leaf: np.ndarray
    size: int

    @classmethod
    def of(cls, words: list[bytes]) -> Lexicon:
        h = np.array([xxhash.xxh64_intdigest(w, 17) for w in words], np.uint64)
        order = np.argsort(h)
        return cls(h[order], order.astype(np.int64), len(words))

    def leaves(self, h: np.ndarray) -> np.ndarray:
        shared = self.size + (h % np.uint64(SHARED)).astype(np.int64)
        if not self.size:
            return shared
        at = np.minimum(np.searchsorted(self.known, h), self.size - 1)
        return np.where(self.known[at] == h, self.leaf[at], shared)


def group_of(klass: np.ndarray) -> np.ndarray:
    """Coarse groups for the outer places: own classes, clusters, end."""
    return np.where(klass < OWN, 0, np.where(klass < END, 1, 2))


_GROUP_OF = group_of(np.arange(CLASSES)).astype(np.int64)


def contexts(klass: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, class before, class after) of each word of some texts, from their classes."""
    c, at = spread(klass, sizes, END)
    left, right = c[at - 1], c[at + 1]
    return ((_GROUP_OF[c[at - 2]] * CLASSES + left) * CLASSES + right) * GROUPS + _GROUP_OF[c[at + 2]], left, right


def spelling(words: list[bytes], rare: np.ndarray) -> np.ndarray:
    """Byte bigrams (previous * 256 + next) of the words at ``rare``; a zero byte begins and ends each."""
    raw = np.frombuffer(b"\0" + b"\0".join(words[k] for k in rare.tolist()) + b"\0", np.uint8).astype(np.int64)
    return raw[:-1] * 256 + raw[1:] if len(rare) else np.zeros(0, np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for words, _ in runs(batch.column(1)):
                counts.update(words)
                if len(counts) > HELD:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` words of highest count, by falling count, then by the word. ``counts``: word, n.

    A histogram of counts (sixteen classes to a doubling) finds what cannot be among them, so only about as many words as asked for are sorted, whatever the number of words.
    """
    counts = cut(counts.withColumn("c", F.floor(F.log2("n") * 16)))
    sizes = sorted(((r["c"], r["w"]) for r in counts.groupBy("c").agg(F.count("*").alias("w")).collect()), reverse=True)  # some hundred classes
    least, held = None, 0
    for c, words in sizes:
        least, held = c, held + words
        if held >= most:
            break
    if least is None:
        return []
    return [(bytes(r["word"]), r["n"]) for r in counts.where(F.col("c") >= least).orderBy(F.desc("n"), "word").limit(most).select("word", "n").collect()]


def _summed(docs: DataFrame, cells: int, count) -> np.ndarray:
    """Sums of ``cells`` counters over all texts: ``count(words, hashes, sizes)`` names the cells of some texts. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, np.int64)
        for batch in batches:
            for words, sizes in runs(batch.column(1)):
                if words:
                    found = count(words, hashes(words), sizes)
                    if len(found) * 8 > cells:
                        sums += np.bincount(found, minlength=cells)
                    else:
                        np.add.at(sums, found, 1)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(sums[cell], pa.int64())], names=["cell", "n"])

    got = docs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # ``cells`` rows at most
    sums = np.zeros(cells)
    sums[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return sums


def neighbourhoods(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Counts [leaf, side, anchor] of the frequent words beside each leaf; the last anchor stands for all other words and for the ends."""
    wide = ANCHORS + 1

    def count(words: list[bytes], h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        leaf = lexicon.leaves(h)
        c, at = spread(np.minimum(leaf, ANCHORS), sizes, ANCHORS)
        return np.concatenate([leaf * 2 * wide + c[at - 1], leaf * 2 * wide + wide + c[at + 1]])

    return _summed(docs, (lexicon.size + SHARED) * 2 * wide, count).reshape(-1, 2, wide)


def clusters(seen: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Class of each leaf: the OWN most frequent words each their own, the others by k-means of the square roots of their neighbours' shares, weighed by their counts."""
    n = seen[:, 0].sum(axis=1)
    x = np.sqrt((seen + 1e-3) / (seen + 1e-3).sum(axis=2, keepdims=True)).reshape(len(seen), -1)
    rest = np.arange(min(OWN, len(seen) - SHARED), len(seen))
    klass = np.arange(len(seen))
    if not len(rest):
        return klass
    x, w = x[rest], n[rest] + 1e-9
    k = END - OWN
    centre = x[: min(k, len(x))].copy()
    for c in range(1, len(centre)):  # each further centre is the heaviest leaf far from those before
        far = (1 - (x @ centre[:c].T).max(axis=1) / 2) * np.sqrt(w)
        centre[c] = x[int(np.argmax(far))]
    for _ in range(rounds):
        at = np.argmax(x @ centre.T, axis=1)
        for c in range(len(centre)):
            if (mine := at == c).any():
                centre[c] = np.average(x[mine], axis=0, weights=w[mine])
    klass[rest] = OWN + np.argmax(x @ centre.T, axis=1)
    return klass


class Network:
    """Embeddings of the four places -> tanh -> softmax over classes."""

    def __init__(self, inner: int = 12, outer: int = 4, hidden: int = 48, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape) * 0.2
        self.p = {"before": draw(CLASSES, inner), "after": draw(CLASSES, inner), "far_before": draw(GROUPS, outer), "far_after": draw(GROUPS, outer), "w": draw(2 * inner + 2 * outer, hidden), "b": np.zeros(hidden), "v": draw(hidden, CLASSES), "c": np.zeros(CLASSES)}
        self.m = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        self.t = 0

    @staticmethod
    def inputs(context: np.ndarray) -> dict[str, np.ndarray]:
        rest, far_after = np.divmod(context, GROUPS)
        rest, after = np.divmod(rest, CLASSES)
        far_before, before = np.divmod(rest, CLASSES)
        return {"far_before": far_before, "before": before, "after": after, "far_after": far_after}

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input, hidden layer, log probabilities)."""
        x = np.hstack([self.p[k][at] for k, at in self.inputs(context).items()])
        h = np.tanh(x @ self.p["w"] + self.p["b"])
        z = h @ self.p["v"] + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def step(self, context: np.ndarray, counts: np.ndarray, rate: float) -> float:
        """One Adam step on the mean negative log likelihood; returns that mean."""
        x, h, logp = self.forward(context)
        total = counts.sum()
        dz = (np.exp(logp) * counts.sum(axis=1, keepdims=True) - counts) / total
        dh = dz @ self.p["v"].T * (1 - h * h)
        dx, grads = dh @ self.p["w"].T, {"v": h.T @ dz, "c": dz.sum(axis=0), "w": x.T @ dh, "b": dh.sum(axis=0)}
        at = 0
        for k, rows in self.inputs(context).items():
            width = self.p[k].shape[1]
            grads[k] = np.zeros_like(self.p[k])
            np.add.at(grads[k], rows, dx[:, at : at + width])
            at += width
        self.t += 1
        for k, g in grads.items():
            m, v = self.m[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[k] -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-9)
        return float(-(counts * logp).sum() / total)


def train(counts: np.ndarray, steps: int = 150, rate: float = 0.03) -> Network:
    """Fit the network to the whole table of windows."""
    seen, network = np.flatnonzero(counts.sum(axis=1)), Network()
    for k in range(steps if len(seen) else 0):
        network.step(seen, counts[seen], rate * min(1.0, 2 * (1 - k / steps)))
    return network


def word_layer(sides: np.ndarray, klass: np.ndarray, joint: np.ndarray, rounds: int = 12, tie: float = 20.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights before [leaf, class before], weights after, log normaliser [class, before, after]) from counts ``sides`` [side, leaf, class beside] and ``joint`` [class, before, after].

    P(leaf | class, before, after) = exp(before + after - normaliser). A round scales the weights of one side, then those of the other, by what the corpus holds over what the layer expects; either is tied to the leaf's
    share of its class by ``tie`` pseudo-counts, so no weight runs off. It starts from either side's own shares.
    """
    leaves = sides.shape[1]
    before, after, norm = np.zeros((leaves, CLASSES)), np.zeros((leaves, CLASSES)), np.zeros((CLASSES, CLASSES, CLASSES))
    for k in range(CLASSES):
        mine = np.flatnonzero(klass == k)
        if not len(mine):
            continue
        n = sides[0][mine].sum(axis=1) + 0.5
        share = (n / n.sum())[:, None]
        seen = [side[mine] for side in sides]
        one, two = ((side + tie * share) / (side.sum(axis=0) + tie) for side in seen)
        two = two / share
        for _ in range(rounds if len(mine) > 1 else 0):
            windows = joint[k] / np.maximum(one.T @ two, 1e-300)
            one = one * (seen[0] + tie * share) / (one * (two @ windows.T) + tie * share)
            windows = joint[k] / np.maximum(one.T @ two, 1e-300)
            two = two * (seen[1] + tie * share) / (two * (one @ windows) + tie * share)
        before[mine], after[mine], norm[k] = np.log(one), np.log(two), np.log(one.T @ two)
    return before.astype(np.float32), after.astype(np.float32), norm.astype(np.float32)


@dataclass
class Model:
    lexicon: Lexicon
    klass: np.ndarray
    table: np.ndarray  # log P(class | context)
    before: np.ndarray
    after: np.ndarray
    norm: np.ndarray
    bigrams: np.ndarray  # log P(next byte | byte)

    def log_p(self, words: list[bytes], h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log P of each word of some texts, given the words around it."""
        leaf = self.lexicon.leaves(h)
        klass = self.klass[leaf]
        context, left, right = contexts(klass, sizes)
        out = (self.table[context, klass] + self.before[leaf, left] + self.after[leaf, right] - self.norm[klass, left, right]).astype(np.float64)
        rare = np.flatnonzero(leaf >= self.lexicon.size)
        if len(rare):
            spelled = self.bigrams[spelling(words, rare)]
            ends = np.cumsum([len(words[k]) + 1 for k in rare.tolist()])
            # Of a shared leaf's words, a 256th of all there are has its hash.
            out[rare] += np.add.reduceat(spelled, np.concatenate([[0], ends[:-1]])) + np.log(SHARED)
        return np.minimum(out, 0.0)


def fit(docs: DataFrame, vocabulary: int | None = None) -> Model:
    """The model of ``docs``: (doc_id, text as bytes)."""
    counts = cut(word_counts(docs))
    size = vocabulary or min(MOST_VOCABULARY, max(LEAST_VOCABULARY, counts.count() // SHARE))
    lexicon = Lexicon.of([w for w, _ in frequent(counts, size)])
    leaves = lexicon.size + SHARED
    klass = clusters(neighbourhoods(docs, lexicon))
    sides, table = 2 * leaves * CLASSES, CONTEXTS * CLASSES

    def count(words: list[bytes], h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        leaf = lexicon.leaves(h)
        k = klass[leaf]
        context, left, right = contexts(k, sizes)
        return np.concatenate([context * CLASSES + k, table + leaf * CLASSES + left, table + sides // 2 + leaf * CLASSES + right, table + sides + spelling(words, np.flatnonzero(leaf >= lexicon.size))])

    sums = _summed(docs, table + sides + 65_536, count)
    seen = sums[:table].reshape(CONTEXTS, CLASSES)
    network = train(seen).forward(np.arange(CONTEXTS))[2].astype(np.float32)
    joint = seen.reshape(GROUPS, CLASSES, CLASSES, GROUPS, CLASSES).sum(axis=(0, 3)).transpose(2, 0, 1)
    before, after, norm = word_layer(sums[table : table + sides].reshape(2, leaves, CLASSES), klass, joint)
    bigrams = sums[table + sides :].reshape(256, 256) + 0.01
    bigrams = np.log(bigrams / bigrams.sum(axis=1, keepdims=True)).ravel()
    return Model(lexicon, klass, network, before, after, norm, bigrams)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None) -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word) of every row, under a network trained on all of them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, vocabulary))  # bounded by the vocabulary and the contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, sizes in runs(batch.column(1)):
                total = np.zeros(len(sizes))
                if words:
                    total += np.bincount(np.repeat(np.arange(len(sizes)), sizes), model.value.log_p(words, hashes(words), sizes), len(sizes))
                mean = pa.array(total / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array(sizes), pa.array(total), mean], names=["doc_id", "n_words", "log_likelihood", "per_word"])
                at += len(sizes)

    return rows.mapInArrow(run, "doc_id long, n_words long, log_likelihood double, per_word double")
