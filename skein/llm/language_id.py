"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ensure_workers, slices, worker_cache

BUCKETS = 1 << 16
LONGEST = 4


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; built once in a process."""
    kept = worker_cache("language")
    if "letters" not in kept:
        kept["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return kept["letters"]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every subword of 1 to 4 characters in whole texts.

    Lower case; what isn't a letter is a border, and a border may begin or end a
    subword, not lie within one.
    """
    rows = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    c = np.where(letters()[c], c, 0).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])
    c, doc = c[keep], doc[keep]
    inner = c != 0
    out, where = [], []
    h, ok = np.zeros(len(c), np.uint32), np.ones(len(c), bool)
    for n in range(1, LONGEST + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x01000193) ^ c[n - 1 :]) * np.uint32(0x9E3779B1)
        if n > 2:
            ok = ok[:m] & inner[n - 2 : n - 2 + m]  # the last but one is inside
        good = ok[:m] & (inner[:m] if n == 1 else inner[:m] | inner[n - 1 :])
        out.append((h[good] >> np.uint32(16)).astype(np.int64))
        where.append(doc[:m][good])
    return np.concatenate(out), np.concatenate(where)


@dataclass
class LanguageModel:
    """``table``: each subword bucket's share of the logits (embedding times softmax weights).

    Calibrated on held-back documents: ``temperature``; ``threshold``, under which a
    probability is rejected; and how familiar a text is: ``usual`` is each bucket's
    log share in the training texts, a text's mean of them has the distance
    (mean - ``center``) / sqrt(``spread`` + ``noise`` / subwords) from what is usual, and is
    rejected under ``strange``. A text in a language or a script that was not learned,
    or of random letters, has few of the learned languages' subwords, whatever the
    softmax makes of it.
    """

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    usual: np.ndarray | None = None
    center: float = 0.0
    spread: float = 1.0
    noise: float = 0.0
    strange: float = -np.inf

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of each text, its number of subwords (0: no letter) and its mean log share."""
        out, count, usual = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) < 1 << 18):
                size += len(texts[b])
                b += 1
            bucket, doc = subwords(texts[a:b])
            n = np.bincount(doc, minlength=b - a)
            for k in range(len(self.langs)):
                out[a:b, k] = np.bincount(doc, weights=self.table[bucket, k], minlength=b - a)
            if self.usual is not None:
                usual[a:b] = np.bincount(doc, weights=self.usual[bucket], minlength=b - a)
            count[a:b] = n
            a = b
        return out / np.maximum(count, 1)[:, None] + self.bias, count, usual / np.maximum(count, 1)

    def distance(self, usual: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (usual - self.center) / np.sqrt(self.spread + self.noise / np.maximum(count, 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, calibrated probability, rejected) of each text; ``und``, 0 and rejected without a letter."""
        z, n, usual = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(n > 0, p.max(axis=1), 0.0)
        return [self.langs[k] if c else "und" for k, c in zip(best, n, strict=True)], score, (n == 0) | (score < self.threshold) | (self.distance(usual, n) < self.strange)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str], documents: np.ndarray | None = None, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 1, reject: float = 0.001, spare: float = 0.6) -> LanguageModel:
    """Stochastic gradient descent over texts given as (buckets, counts); ``documents`` tells which texts are of one document.

    A tenth of the documents, with all their texts, is held back for calibration: the
    temperature (0.5 at least) minimises its negative log-likelihood; the probability
    and the familiarity under which a text is rejected lie under all but the share
    ``reject`` of its rightly predicted texts, with some to spare (the probability times
    ``spare``, the distance 1.25 times as far).
    """
    rng = np.random.default_rng(seed)
    documents = np.arange(len(features)) if documents is None else documents
    emb = (rng.random((BUCKETS, dim), np.float32) - 0.5) / dim
    w, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    share = [(i, (c / c.sum()).astype(np.float32)) for i, c in features]
    every = np.unique(documents)
    back = rng.permutation(every)[: len(every) // 10]
    out = np.isin(documents, back)
    held, order = np.flatnonzero(out), np.flatnonzero(~out)
    total, step = max(1, epochs * len(order)), 0
    for _ in range(epochs):
        for d in rng.permutation(order):
            idx, s = share[d]
            rows = emb[idx]
            x = s @ rows
            z = x @ w + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[labels[d]] -= 1
            lr = rate * (1 - step / total)
            # the mean's gradient is tiny for one subword: embeddings move by the share's square root of scale
            emb[idx] = rows - (lr * 20) * np.outer(s, w @ g)
            w -= lr * np.outer(x, g)
            bias -= lr * 0.1 * g
            step += 1
    model = LanguageModel(langs, (emb @ w).astype(np.float32), bias.astype(np.float64))
    seen = np.zeros(BUCKETS)
    for d in order:
        seen[share[d][0]] += share[d][1]
    model.usual = np.log((seen + 0.01) / (seen.sum() + 0.01 * BUCKETS)).astype(np.float32)
    if len(held):
        z = np.stack([share[d][1] @ model.table[share[d][0]] + model.bias for d in held])
        y = labels[held]
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.5, 5, 47), key=loss))
        p = softmax(z / model.temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            model.threshold = float(spare * np.quantile(p.max(axis=1)[right], reject, method="lower"))
            n = np.array([features[d][1].sum() for d in held])
            mean = np.array([share[d][1] @ model.usual[share[d][0]] for d in held])
            model.noise = float(np.mean([share[d][1] @ (model.usual[share[d][0]] - m) ** 2 for d, m in zip(held, mean, strict=True)]))
            model.center = float(np.average(mean, weights=np.sqrt(n)))
            model.spread = float(max(np.average((mean - model.center) ** 2 - model.noise / n, weights=np.sqrt(n)), 1e-3))
            model.strange = float(min(np.quantile(model.distance(mean, n)[right], reject, method="lower"), -1.0) * 1.25)
    return model


def excerpts(text: str) -> list[str]:
    """Two short runs of words from about a third and two thirds of a text, so that the model learns short texts too."""
    words = text.split()
    n = len(words)
    return [" ".join(words[n * k // 3 : n * k // 3 + size]) for k, size in ((1, 6), (2, 20))] if n > 8 else []


def fit(docs: DataFrame, most_rows: int = 3000, most_bytes: int = 256 << 20, seed: int = 1) -> LanguageModel:
    """Train on a bounded sample of labelled rows of ``docs(doc_id, text, lang)``.

    At most about ``most_rows`` documents, the same number of each language where there
    are as many (two at least), chosen by the hash of doc_id; fewer of a language whose
    texts are long, so that what reaches the driver stays at about ``most_bytes``. The
    subwords of the whole text and of two :func:`excerpts` are counted on the executors.
    """
    spark = docs.sparkSession
    ensure_workers(spark)
    labelled = docs.filter("lang is not null and text is not null")
    # a text has at most four subwords a character and a bucket has six bytes
    size = F.least(4 * F.length("text"), F.lit(BUCKETS)) * 12 + 256
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy("lang").collect()  # a row for each language
    if not counts:
        return LanguageModel(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    each = max(2, most_rows // len(counts))
    parts = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, each / r.n, most_bytes / len(counts) / r.bytes)))])
    chosen = labelled.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < F.coalesce(F.try_element_at(parts, "lang"), F.lit(0.0)) * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=256):
            doc, lang, idx, n = [], [], [], []
            for d, x, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for part in (t, *excerpts(t)):
                    b, c = np.unique(subwords([part])[0], return_counts=True)
                    doc.append(d)
                    lang.append(x)
                    idx.append(b.astype("<u2").tobytes())
                    n.append(c.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lang, pa.string()), pa.array(idx, pa.binary()), pa.array(n, pa.binary())], names=["doc", "lang", "idx", "n"])

    rows = chosen.select(F.xxhash64("doc_id", "text").alias("doc"), "lang", "text").mapInArrow(count, "doc long, lang string, idx binary, n binary").filter("length(idx) > 0").collect()
    langs = sorted({r.lang for r in rows}) or ["und"]
    rows.sort(key=lambda r: (r.lang, r.doc, bytes(r.idx), bytes(r.n)))
    place = {x: k for k, x in enumerate(langs)}
    return train([(np.frombuffer(r.idx, "<u2").astype(np.int64), np.frombuffer(r.n, "<f4")) for r in rows], np.array([place[r.lang] for r in rows], np.int64), langs, np.array([r.doc for r in rows], np.int64), seed=seed)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row of ``docs(doc_id, text)``, from its whole text alone.

    ``score`` is the calibrated probability. Null texts and ones without a letter
    are ``und`` with score 0, and rejected; so are texts whose probability or familiarity
    is under the model's thresholds. Null and repeated ids pass; other columns are ignored. Empty input:
    no rows.
    """
    ensure_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lang, score, rejected = model.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents to learn from: those that aren't :func:`held_out`."""
    return docs.filter(~held_out())


def held_out() -> F.Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text the model doesn't reject."""
    ensure_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rejected = model.predict([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
