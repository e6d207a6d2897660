"""Language-model scores: exact unigram counts and a log-bilinear model trained by noise-contrastive estimation.

The model covers every word of the training texts. Its outputs are in three levels,
each a softmax of log-bilinear scores of the two words before:

1. the most frequent words (the end of a text among them) and groups of all others;
2. within a class of words, a group's part by hash, sub-classes of the class's words
   by frequency, as many as words in each;
3. within a sub-class its words, each with an embedding and a bias of its own.

A group's classes have the shares of their counts: classes are made by hash. Classes
grow in number with the corpus, so that each has a bounded part of the words and
tokens; a class's words, their counts and all its tokens come together in one task,
which trains the class's two levels and scores its tokens. Only the first level's
model, of fixed size, goes to every task.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ensure_workers, materialize, partitions_for, runs, slices, worker_cache

#: The end of a text; no word holds white space.
END = b"\n"
CHUNKS = 128


@dataclass
class LogBilinear:
    """Logit of symbol w after symbols c2 c1: (r[c1] a1 + r[c2] a2) . q[w] + b[w]. The context after the last symbol is what precedes a text."""

    r: np.ndarray
    a1: np.ndarray
    a2: np.ndarray
    q: np.ndarray
    b: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def start(unigram: np.ndarray, dim: int, seed: int) -> LogBilinear:
        rng, n = np.random.default_rng(seed), len(unigram)
        eye = np.eye(dim, dtype=np.float32)
        return LogBilinear(rng.normal(0, 0.3, (n + 1, dim)).astype(np.float32), eye * 0.7, eye * 0.3, rng.normal(0, 0.1, (n, dim)).astype(np.float32), np.log(unigram).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.a1, self.a2, self.q, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float32)

    def like(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return LogBilinear(*out)


class Trainer:
    """Noise-contrastive estimation with Adagrad. A minibatch shares its noise symbols, drawn from the unigram shares."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int, rate: float = 0.1, batch: int = 1024, noise: int = 64) -> None:
        self.m = LogBilinear(*[p.copy() for p in model.parts()])
        self.rate, self.batch, self.noise = rate, batch, noise
        self.rng = np.random.default_rng(seed)
        self.cum = np.cumsum(unigram / unigram.sum())
        self.log_noise = (np.log(unigram / unigram.sum()) + np.log(noise)).astype(np.float32)
        self.sums = [np.full(p.shape, 1e-3, np.float32) for p in self.m.parts()]
        self.tokens = 0

    def _move(self, k: int, grad: np.ndarray) -> None:
        p, s = self.m.parts()[k], self.sums[k]
        s += grad * grad
        p -= self.rate * grad / np.sqrt(s)

    def learn(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
        order = self.rng.permutation(len(w))
        for a in range(0, len(w), self.batch):
            at = order[a : a + self.batch]
            self._step(c2[at], c1[at], w[at])
        self.tokens += len(w)

    def _step(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        dim = m.q.shape[1]
        x1, x2, qw = m.r[c1], m.r[c2], m.q[w]
        hid = x1 @ m.a1 + x2 @ m.a2
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(self.noise)), len(self.cum) - 1)
        qn = m.q[noise]
        real = np.einsum("ij,ij->i", hid, qw) + m.b[w] - self.log_noise[w]
        fake = hid @ qn.T + (m.b[noise] - self.log_noise[noise])
        g = (-1 / (1 + np.exp(np.clip(real, -30, 30)))).astype(np.float32)  # d loss / d score of the word
        h = (1 / (1 + np.exp(-np.clip(fake, -30, 30)))).astype(np.float32)  # and of the noise
        d_hid = g[:, None] * qw + h @ qn
        rows = np.concatenate((w, noise))
        d_q = np.concatenate((g[:, None] * hid, h.T @ hid))
        d_b = np.concatenate((g, h.sum(axis=0)))
        ctx = np.concatenate((c1, c2))
        d_r = np.concatenate((d_hid @ m.a1.T, d_hid @ m.a2.T))
        cols = np.arange(dim)
        add = lambda rows, vals, k: np.bincount((rows[:, None] * dim + cols).ravel(), weights=vals.ravel(), minlength=k * dim).reshape(k, dim).astype(np.float32)
        grads = [add(ctx, d_r, len(m.r)), x1.T @ d_hid, x2.T @ d_hid, add(rows, d_q, len(m.q)), np.bincount(rows, weights=d_b, minlength=len(m.b)).astype(np.float32)]
        for k, x in enumerate(grads):
            self._move(k, x / n)


class Tables:
    """A model's normalised log10 probabilities by lookup: log P(w | c2, c1) = t1[c1, w] + t2[c2, w] + b[w] - z[c1, c2]."""

    def __init__(self, m: LogBilinear) -> None:
        self.t1, self.t2, self.b = (m.r @ m.a1) @ m.q.T, (m.r @ m.a2) @ m.q.T, m.b
        top1, top2 = self.t1.max(axis=1, keepdims=True), self.t2.max(axis=1, keepdims=True)
        high = float(self.b.max())
        self.z = np.log((np.exp(self.t1 - top1) * np.exp(self.b - high)) @ np.exp(self.t2 - top2).T) + top1 + top2.T + high

    def log10(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.t1[c1, w].astype(np.float64) + self.t2[c2, w] + self.b[w] - self.z[c1, c2]) / np.log(10)


def tables_of(m: LogBilinear) -> Tables:
    """The worker process's tables of the last model."""
    kept = worker_cache("lm")
    if m.key not in kept:
        kept.clear()
        kept[m.key] = Tables(m)
    return kept[m.key]


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text in lower case (A-Z), split at the six white-space bytes; then the end."""
    out = text.lower().split()
    out.append(END)
    return out


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """:func:`words_of` without the ends, of all texts one after the other, and each text's number of words; in Arrow, null as empty."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, offsets = split.flatten(), np.asarray(split.offsets, np.int64)
    keep = np.asarray(pc.binary_length(flat)) > 0  # white space at a text's ends leaves empty words
    upto = np.concatenate(([0], np.cumsum(keep)))[offsets - offsets[0]]
    return flat.filter(pa.array(keep)) if not keep.all() else flat, np.diff(upto)


def is_training() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True))


def count_words(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """``word`` (binary), ``c``: exact counts over all of ``docs(text)``, ends included. A task holds about ``most`` distinct words, then sends them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows():
            words, n = list(seen.keys()), list(seen.values())
            seen.clear()
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.binary()), pa.array(n[a : a + 50_000], pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            flat, _ = _words(batch.column(0))
            found = flat.value_counts()
            for w, n in zip(found.field(0).cast(pa.binary()).to_pylist(), found.field(1).to_pylist(), strict=True):
                seen[w] += n
            seen[END] += batch.num_rows
            if len(seen) > most:
                yield from rows()
        yield from rows()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _contexts(ids: np.ndarray, lengths: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each position; ``before`` stands for what precedes a text."""
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    c1 = np.empty_like(ids)
    c1[1:] = ids[:-1]
    c1[first] = before
    c2 = np.empty_like(ids)
    c2[1:] = c1[:-1]
    c2[first] = before
    return c2, c1


@dataclass
class Vocabulary:
    """The first level's symbols: ``words`` 0..m-1, then ``groups`` of the other words. ``classes`` is a multiple of ``groups``; a word's class is its crc32 modulo that, its group its class modulo the groups."""

    words: list[bytes]
    counts: np.ndarray
    classes: int
    groups: int
    group_counts: np.ndarray
    total: int
    kinds: int
    add: float
    frequent: F.Column

    @property
    def unigram(self) -> np.ndarray:
        u = np.concatenate((self.counts, self.group_counts + self.add * self.classes / self.groups)).astype(np.float64)
        return u / u.sum()


def learn_vocabulary(counts: DataFrame, add: float = 0.1, words: int = 2047, groups: int = 128, class_tokens: int = 1 << 17, class_words: int = 1 << 15, least_classes: int = 64) -> Vocabulary:
    """Choose the frequent words and the number of classes from ``counts(word, c)``.

    The ``words`` most frequent ones (ties by word) are found by a histogram of the
    counts: only words from the bucket of the last of them up are ordered. Classes are
    as many as keep one at about ``class_tokens`` tokens and ``class_words`` words.
    To the driver come the histogram, the frequent words and a number for each group.
    """
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = F.floor(F.log2("c") * 8).cast("int")
    left, least = words, None
    for r in sorted(counts.groupBy(size.alias("b")).count().collect(), key=lambda r: -r.b):
        least, left = r.b, left - r["count"]
        if left <= 0:
            break
    top = counts.filter(size >= least).orderBy(F.desc("c"), "word").limit(words).toArrow() if least is not None else None
    names = top.column("word").to_pylist() if top is not None else []
    often = np.array(top.column("c"), np.int64) if top is not None else np.zeros(0, np.int64)
    if names:
        last = F.lit(bytearray(names[-1]))
        frequent = (F.col("c") > int(often[-1])) | ((F.col("c") == int(often[-1])) & (F.col("word") <= last))
    else:
        frequent = F.lit(False)
    rest = total - int(often.sum())
    classes = max(least_classes, -(-rest // class_tokens), -(-kinds // class_words))
    groups = min(classes, groups)
    classes = -(-classes // groups) * groups
    of = np.zeros(groups, np.int64)
    for r in counts.filter(~frequent).groupBy((F.crc32("word") % groups).cast("int").alias("g")).agg(F.sum("c").alias("n")).collect():
        of[r.g] = r.n
    return Vocabulary(names, often, classes, groups, of, total, kinds, add, frequent)


@dataclass
class _Batch:
    """The tokens of some texts: the distinct words, each token's word, tokens of each text; and each word's first-level symbol, place among the frequent words (-1: none) and class."""

    words: list[bytes]
    codes: np.ndarray
    lengths: np.ndarray
    symbol: np.ndarray
    place: np.ndarray
    owner: np.ndarray


def _read(column: pa.Array, place: dict[bytes, int], classes: int, groups: int) -> _Batch:
    flat, n = _words(column)
    coded = flat.dictionary_encode()
    words = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
    lengths = n + 1
    codes = np.full(int(lengths.sum()), len(words) - 1, np.int64)
    inner = np.ones(len(codes), bool)
    inner[np.cumsum(lengths) - 1] = False
    codes[inner] = np.asarray(coded.indices)
    at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
    owner = np.zeros(len(words), np.int64)
    rare = np.flatnonzero(at < 0)
    owner[rare] = [zlib.crc32(words[k]) % classes for k in rare.tolist()]
    return _Batch(words, codes, lengths, np.where(at < 0, len(place) + owner % groups, at), at, owner)


def train_model(docs: DataFrame, vocabulary: Vocabulary, dim: int = 16, seed: int = 5, shares: tuple[int, ...] = (1, 4, 11)) -> LogBilinear:
    """Train the first level on every text of ``docs(doc_id, text)`` by local descent and averaging.

    In each of the rounds (``shares`` of the texts in sixteenths, by hash; each text
    in one) every task starts from the common model, learns its texts of that round
    and sends its parameters in ``CHUNKS`` pieces; each piece is averaged by tokens in
    a task of its own. So what a task holds is one model, and the driver gets one.
    Which texts are learned together follows the files' partitions.
    """
    spark = docs.sparkSession
    ensure_workers(spark)
    unigram, classes, groups = vocabulary.unigram, vocabulary.classes, vocabulary.groups
    model = LogBilinear.start(unigram, dim, seed)
    place = {w: k for k, w in enumerate(vocabulary.words)}
    before = len(unigram)
    low = 0
    for share in shares:
        high = low + share
        part = docs.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(sum(shares))).between(low, high - 1)).select("text")
        low = high
        now = model

        def learn(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            t = Trainer(now, unigram, seed + TaskContext.get().partitionId())
            for batch in slices(batches, "text", most=4 << 20):
                b = _read(batch.column(0), place, classes, groups)
                ids = b.symbol[b.codes]
                c2, c1 = _contexts(ids, b.lengths, before)
                t.learn(c2, c1, ids)
            if t.tokens:
                pieces = np.array_split(t.m.flat(), CHUNKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([t.tokens] * CHUNKS, pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["chunk", "tokens", "v"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for chunk, n, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    x = total.setdefault(chunk, [0, 0.0])
                    x[0] += n
                    x[1] = x[1] + n * np.frombuffer(v, np.float32).astype(np.float64)
            rows = sorted(total.items())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([x[0] for _, x in rows], pa.int64()), pa.array([(x[1] / x[0]).astype(np.float32).tobytes() for _, x in rows], pa.binary())], names=["chunk", "tokens", "v"])

        kind = "chunk int, tokens long, v binary"
        rows = part.mapInArrow(learn, kind).repartition(partitions_for(spark), "chunk").mapInArrow(average, kind).collect()
        if rows:
            model = model.like(np.concatenate([np.frombuffer(r.v, np.float32) for r in sorted(rows, key=lambda r: r.chunk)]))
    return model


class ClassModel:
    """Two softmaxes over one class's words, in order of frequency: over sub-classes of ``fan`` successive words, and over a sub-class's words; scores are h . q + b for a context vector h.

    ``counts`` are the words' in falling order. An unseen word of the class has the
    share of ``add`` counts, the others share the rest.
    """

    def __init__(self, counts: np.ndarray, dim: int, add: float = 0.1) -> None:
        n = len(counts)
        self.fan = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.counts = counts
        self.unseen = add / (counts.sum() + add * (n + 1))
        self.nodes = -(-n // self.fan)
        node = np.arange(n) // self.fan
        of = np.bincount(node, weights=counts, minlength=self.nodes)
        self.node_share = of / max(of.sum(), 1)
        self.leaf_share = counts / of[node] if n else np.zeros(0)
        self.qn, self.bn = np.zeros((self.nodes, dim), np.float32), np.log(np.maximum(self.node_share, 1e-30)).astype(np.float32)
        self.qw, self.bw = np.zeros((n, dim), np.float32), np.log(np.maximum(self.leaf_share, 1e-30)).astype(np.float32)

    @staticmethod
    def _descend(q: np.ndarray, b: np.ndarray, share: np.ndarray, h: np.ndarray, y: np.ndarray, rng: np.random.Generator, noise: int, rate: float, batch: int) -> None:
        """Noise-contrastive estimation of rows ``q`` and biases ``b`` for targets ``y`` after contexts ``h``, with Adagrad; a minibatch shares its noise."""
        k, dim = q.shape
        if k < 2:
            return
        cum = np.cumsum(share)
        shift = (np.log(np.maximum(share, 1e-30)) + np.log(noise)).astype(np.float32)
        sq, sb, cols = np.full(q.shape, 1e-3, np.float32), np.full(b.shape, 1e-3, np.float32), np.arange(dim)
        for a in range(0, len(y), batch):
            x, t = h[a : a + batch], y[a : a + batch]
            z = np.minimum(np.searchsorted(cum, rng.random(noise) * cum[-1]), k - 1)
            real = np.einsum("ij,ij->i", x, q[t]) + b[t] - shift[t]
            fake = x @ q[z].T + (b[z] - shift[z])
            g = (-1 / (1 + np.exp(np.clip(real, -30, 30)))).astype(np.float32)
            f = (1 / (1 + np.exp(-np.clip(fake, -30, 30)))).astype(np.float32)
            rows = np.concatenate((t, z))
            dq, db = np.concatenate((g[:, None] * x, f.T @ x)), np.concatenate((g, f.sum(axis=0)))
            gq = np.bincount((rows[:, None] * dim + cols).ravel(), weights=dq.ravel(), minlength=k * dim).reshape(k, dim).astype(np.float32) / len(t)
            gb = np.bincount(rows, weights=db, minlength=k).astype(np.float32) / len(t)
            sq += gq * gq
            sb += gb * gb
            q -= rate * gq / np.sqrt(sq)
            b -= rate * gb / np.sqrt(sb)

    def train(self, h: np.ndarray, leaf: np.ndarray, seed: int, rate: float = 0.1, batch: int = 1024) -> None:
        """One pass over the class's training tokens: words ``leaf`` after context vectors ``h``."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(leaf))
        h, leaf = h[order], leaf[order]
        node = leaf // self.fan
        self._descend(self.qn, self.bn, self.node_share, h, node, rng, 32, rate, batch)
        by = np.argsort(node, kind="stable")
        ends = np.searchsorted(node[by], np.arange(self.nodes + 1))
        for k in range(self.nodes):
            lo, hi = k * self.fan, min((k + 1) * self.fan, len(self.counts))
            at = by[ends[k] : ends[k + 1]]
            self._descend(self.qw[lo:hi], self.bw[lo:hi], self.leaf_share[lo:hi], h[at], leaf[at] - lo, rng, 16, rate, batch)

    def log(self, h: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of words ``leaf`` (-1: unseen) after context vectors ``h``, each level normalised by a product of matrices over all its choices."""
        out = np.full(len(leaf), math.log(self.unseen))
        known = np.flatnonzero(leaf >= 0)
        node = leaf[known] // self.fan
        by = np.argsort(node, kind="stable")
        known, node = known[by], node[by]
        rest = math.log1p(-self.unseen) if self.unseen < 1 else 0.0
        for a in range(0, len(known), 4096):
            at, x = known[a : a + 4096], h[known[a : a + 4096]]
            z = x @ self.qn.T + self.bn
            out[at] = rest + z[np.arange(len(at)), node[a : a + 4096]].astype(np.float64) - _log_sum(z)
        ends = np.searchsorted(node, np.arange(self.nodes + 1))
        for k in range(self.nodes):
            lo, hi = k * self.fan, min((k + 1) * self.fan, len(self.counts))
            for a in range(ends[k], ends[k + 1], 4096):
                at = known[a : min(a + 4096, ends[k + 1])]
                z = h[at] @ self.qw[lo:hi].T + self.bw[lo:hi]
                out[at] += z[np.arange(len(at)), leaf[at] - lo].astype(np.float64) - _log_sum(z)
        return out


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=1)
    return np.log(np.exp(z - top[:, None]).sum(axis=1, dtype=np.float64)) + top


def context_rows(m: LogBilinear) -> tuple[np.ndarray, np.ndarray]:
    """What each symbol adds to the context vector one and two places before."""
    return m.r @ m.a1, m.r @ m.a2


HELD = 1 << 15
PACKED = "key long, kind int, batch long, c long, words binary, x binary"


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "kind": pa.int32(), "batch": pa.int64(), "c": pa.int64(), "words": pa.binary(), "x": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], names=list(kinds))


def score_documents(docs: DataFrame, add: float = 0.1, vocabulary: int = 2047, dim: int = 16, seed: int = 5, **sizes: int) -> DataFrame:
    """Base and model scores of every whole text of ``docs(doc_id, text)``; null as empty.

    Learns from documents whose crc32(doc_id as text) mod 10 isn't 0 (null ids: too):
    exact counts of all their words and ends, and the model over all their texts.
    ``vocabulary``: words of the first level; ``sizes``: of groups and classes, see
    :func:`learn_vocabulary`. A batch of texts sends each class its words of that class
    with their contexts, and gets back their counts and probabilities; nothing is
    joined row by row.

    Returns ``doc_id, held_out, n_tokens, n_known`` (count over 0), ``train_tokens``,
    ``base_score`` (log10, each word (c + add) / (N + add (V + 1))) and ``score``
    (log10, the model's). An empty text is its end alone. Repeated rows and null ids
    are scored like others; other columns are ignored; empty input: no rows. Without
    training documents every word is unseen. A word unseen in training has its group's
    probability, its class's share and the share of ``add`` counts there. ``score``
    depends on how the files are split into partitions, ``base_score`` doesn't.
    """
    learned = docs.select("doc_id", "text").filter(is_training())
    counts = materialize(count_words(learned), "counts")
    v = learn_vocabulary(counts, add, vocabulary, **sizes)
    return score_with(docs, counts, v, train_model(learned, v, dim, seed), seed)


def score_with(docs: DataFrame, counts: DataFrame, v: Vocabulary, model: LogBilinear, seed: int = 5) -> DataFrame:
    """:func:`score_documents` with a first level that is trained."""
    spark = docs.sparkSession
    ensure_workers(spark)
    place = {w: k for k, w in enumerate(v.words)}
    m, before, add, classes, groups = len(v.words), len(v.unigram), v.add, v.classes, v.groups
    log_base = float(np.log10(v.total + add * (v.kinds + 1)))
    log_c = np.log10(v.counts + add)
    group_counts, dim = v.group_counts, model.q.shape[1]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of kind 2 with the texts' sums over the frequent words, and one of kind 1 for each class of other words: theirs, each token's word, contexts and text."""
        tables, uid = tables_of(model), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", rows=1024, most=4 << 20):
            b = _read(batch.column(2), place, classes, groups)
            symbol = b.symbol[b.codes]
            c2, c1 = _contexts(symbol, b.lengths, before)
            lm = tables.log10(c2, c1, symbol)
            at = b.place[b.codes]
            here = at >= 0
            base = np.where(here, log_c[at] if m else 0.0, 0.0)
            starts = np.cumsum(b.lengths) - b.lengths
            total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  each text has a token at least
            ids = batch.column(0).cast(pa.int64())
            doc_ids = np.asarray(ids.fill_null(0), np.int64)
            x = b"".join([doc_ids.tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(), b.lengths.tobytes(), total(here.astype(np.int64)).tobytes(), (total(base) - b.lengths * log_base).tobytes(), total(lm).tobytes()])
            out = {"key": [uid], "kind": [2], "batch": [uid], "c": [batch.num_rows], "words": [None], "x": [x]}
            held = np.asarray(batch.column(1).cast(pa.uint8())).astype(np.int64)
            rare = np.flatnonzero(~here)
            codes = b.codes[rare]
            own = b.owner[codes]
            order = np.argsort(own, kind="stable")
            rare, codes, own = rare[order], codes[order], own[order]
            text = np.searchsorted(np.cumsum(b.lengths), rare, side="right")
            flag = (text + HELD * held[text]).astype("<u2")
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=False):
                mine, word = np.unique(codes[lo:hi], return_inverse=True)
                out["key"].append(int(own[lo]))
                out["kind"].append(1)
                out["batch"].append(uid)
                out["c"].append(hi - lo)
                out["words"].append(b" ".join(b.words[k] for k in mine.tolist()))
                out["x"].append(b"".join([word.astype("<u4").tobytes(), c1[rare[lo:hi]].astype("<u2").tobytes(), c2[rare[lo:hi]].astype("<u2").tobytes(), flag[lo:hi].tobytes()]))
            yield _rows(out)
            uid += 1

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 2 as they are, and of kind 3: for each token sent its text, its word's count and log10 probability within the group."""
        one, two = context_rows(model)
        for (key,), table in runs(batches, ["key"]):
            kinds = np.asarray(table.column("kind"))
            sums = table.filter(pa.array(kinds == 2))
            if sums.num_rows:
                yield from sums.to_batches()
            sent = table.filter(pa.array(kinds == 1))
            if not sent.num_rows:
                continue
            known = table.filter(pa.array(kinds == 0))
            seen = np.asarray(known.column("c"), np.int64)
            at = {w: k for k, w in enumerate(known.column("words").to_pylist())}
            sizes = sent.column("c").to_pylist()
            leaf, c1, c2, flag = [], [], [], []
            for n, words, x in zip(sizes, sent.column("words").to_pylist(), sent.column("x").to_pylist(), strict=True):
                words = np.array([at.get(w, -1) for w in words.split(b" ")], np.int64)
                leaf.append(words[np.frombuffer(x, "<u4", n)])
                c1.append(np.frombuffer(x, "<u2", n, 4 * n))
                c2.append(np.frombuffer(x, "<u2", n, 6 * n))
                flag.append(np.frombuffer(x, "<u2", n, 8 * n))
            leaf, c1, c2, flag = (np.concatenate(y) for y in (leaf, c1, c2, flag))
            fitted = ClassModel(seen.astype(np.float64), dim, add)
            learn = np.flatnonzero((flag < HELD) & (leaf >= 0))
            fitted.train(one[c1[learn]] + two[c2[learn]], leaf[learn], seed + key)
            share = math.log10((seen.sum() + add) / (group_counts[key % groups] + add * classes / groups))
            lp = np.empty(len(leaf))
            for a in range(0, len(leaf), 1 << 17):
                part = slice(a, a + (1 << 17))
                lp[part] = fitted.log(one[c1[part]] + two[c2[part]], leaf[part])
            lp = (lp / math.log(10) + share).astype("<f4")
            c = np.where(leaf >= 0, seen[leaf] if len(seen) else 0, 0).astype("<i8")
            text = (flag & (HELD - 1)).astype("<u2")
            ends = np.cumsum(sizes)
            xs = [b"".join((text[a:e].tobytes(), c[a:e].tobytes(), lp[a:e].tobytes())) for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            n = len(xs)
            yield _rows({"key": [key] * n, "kind": [3] * n, "batch": sent.column("batch").to_pylist(), "c": sizes, "words": [None] * n, "x": xs})

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, ["batch"]):
            kinds, sizes, xs = (table.column(k).to_pylist() for k in ("kind", "c", "x"))
            at = kinds.index(2)
            n, x = sizes[at], xs[at]
            col = lambda k, kind="<i8": np.frombuffer(x, kind, n, 9 * n + 8 * n * k)  # noqa: E731, B023
            doc_id, null = np.frombuffer(x, "<i8", n), np.frombuffer(x, np.uint8, n, 8 * n).astype(bool)
            tokens, known, base, lm = col(0), col(1).copy(), col(2, "<f8").copy(), col(3, "<f8").copy()
            for kind, k, y in zip(kinds, sizes, xs, strict=True):
                if kind == 3:
                    text, c, lp = np.frombuffer(y, "<u2", k), np.frombuffer(y, "<i8", k, 2 * k), np.frombuffer(y, "<f4", k, 10 * k)
                    known += np.bincount(text, weights=c > 0, minlength=n).astype(np.int64)
                    base += np.bincount(text, weights=np.log10(c + add), minlength=n)
                    lm += np.bincount(text, weights=lp, minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=null), pa.array(tokens), pa.array(known), pa.array(base), pa.array(lm)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    n = partitions_for(spark)
    none = F.lit(None).cast("binary")
    words = counts.filter(~v.frequent).select((F.crc32("word") % classes).cast("long").alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("batch"), "c", F.col("word").alias("words"), none.alias("x"))
    sent = docs.select("doc_id", (~is_training()).alias("held_out"), "text").mapInArrow(emit, PACKED).unionByName(words)
    scored = sent.repartition(n, "key").sortWithinPartitions("key", "kind", "batch", F.desc("c"), "words").mapInArrow(by_class, PACKED)
    joined = scored.repartition(n, "batch").sortWithinPartitions("batch", "kind", "key").mapInArrow(by_batch, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return joined.select("doc_id", (~is_training()).alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")
