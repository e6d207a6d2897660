"""The pipeline's stages against their operators on their own inputs, and run() as a whole."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm import language_id, mixing, packing, registry, simhash
from skein.llm.tokenizing import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "source_mixing", "best_fit_packing"]
    one = corpus_pipeline.known_language(spark, docs, SF).cache()
    assert one.columns == docs.columns and one.count() >= 0.99 * docs.count()
    two = corpus_pipeline.without_near_copies(spark, one, SF).cache()
    groups = simhash.simhash_groups(one).collect()
    assert sorted(r.doc_id for r in two.collect()) == sorted({r.component_id for r in groups})
    three = corpus_pipeline.mixed(spark, two, SF).cache()
    rates = {r.doc_id: r.copies for r in mixing.mix(two, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert three.columns == docs.columns
    assert Counter(r.doc_id for r in three.collect()) == Counter({k: n for k, n in rates.items() if n})
    four = corpus_pipeline.packed(spark, three, SF).collect()
    assert {r.doc_id for r in four} == {r.doc_id for r in three.collect()}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in whole) == Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in four)


def test_registry(spark):
    q = registry.queries()
    assert [n.split("_")[0] for n in q] == [f"op{k}" for k in range(1, 11)]
    assert packing.SCHEMA.split(",")[0] == "doc_id long"


def slow_posterior(text, absent, weights):
    """The classifier of one text by a loop over its marks."""
    row = mixing_marks(text)
    logs = {d: a + sum(weights[m][k] for m in row if m in weights) for k, (d, a) in enumerate(absent.items())}
    top = max(logs.values())
    e = {d: math.exp(v - top) for d, v in logs.items()}
    return [e[d] / sum(e.values()) for d in e]


def mixing_marks(text):
    raw = [w for w in text.translate(str.maketrans("\n\t\r\x0b\x0c", "     ")).split(" ") if w]
    words = [w for w in text.lower().translate(str.maketrans(mixing._BREAKS, " " * len(mixing._BREAKS))).split(" ") if w]
    n, size = max(len(raw), 1), max(len(text), 1)
    upper = sum(c.isupper() for c in text)
    shape = {"#upper": upper > 0.4 * size, "#signs": sum(c in "!|#%&$*" for c in text) > 0.3 * n, "#digits": sum(c in "0123456789" for c in text) > 0.1 * size, "#repeats": len(set(words)) < 0.3 * n, "#short": n < 8, "#long": n > 3000}
    return set(words) | {k for k, v in shape.items() if v}


def test_stages_by_brute_force(spark):
    """Each stage from its input, row by row in Python, with the models that the stages train."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.fit(language_id.training_rows(docs))
    kept = {k for k, r in rows.items() if not model.predict([r.text or ""])[2][0]}
    one = corpus_pipeline.known_language(spark, docs, SF).cache()
    assert {r.doc_id for r in one.collect()} == kept
    ids = sorted(kept)
    fps = np.array([simhash.fingerprint((rows[k].text or "").encode()) for k in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 4)):
        a, b = find(int(i)), find(int(j))
        root[max(a, b)] = min(a, b)
    first = {ids[find(i)] for i in range(len(ids))}
    two = corpus_pipeline.without_near_copies(spark, one, SF).cache()
    assert {r.doc_id for r in two.collect()} == first
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    absent, weights, members, steps = mixing._fit(two, labels, dict(mixing.TARGETS), None, 8000)
    got = {r.doc_id: r for r in mixing.mix(two, labels).collect()}
    for k in first:
        p = slow_posterior(rows[k].text, absent, weights)
        assert [got[k][f"p_{d}"] for d in absent] == pytest.approx(p, abs=1e-6), k
        p = [round(x, 9) for x in p]
        rate = ahead = 1.0
        for *e, momentum in steps:
            move = max(0.0, ahead - (sum(x * y for x, y in zip(p, e)) + mixing.RIDGE * (ahead - 1)) / (1 + mixing.RIDGE))
            rate, ahead = move, move + momentum * (move - rate)
        assert got[k].rate == pytest.approx(rate, abs=1e-6) and math.floor(rate - 1e-6) <= got[k].copies <= math.ceil(rate + 1e-6)
    three = corpus_pipeline.mixed(spark, two, SF).cache()
    times = Counter(r.doc_id for r in three.collect())
    assert times == Counter({k: got[k].copies for k in first if got[k].copies})
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.packed(spark, three, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for k, n in times.items():
        x = [*t.encode(rows[k].text, add_special_tokens=False).ids, 0]
        want = Counter({(s, np.array(x[s : s + m], "<u4").tobytes()): n for s, m in packing.pieces_of(len(x), 2048)})
        assert Counter((r.start, bytes(r.ids)) for r in pieces[k]) == want


def test_hard_cases(spark, tmp_path):
    """Nulls, repeats, empty texts, clashing columns; and nothing at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "a", 0), (None, "the words of a text without an id are here to stay", "en", "a", 9), (10**9, "!!!", None, None, None)], docs.schema)
    repeated = docs.orderBy("doc_id").limit(1)
    every = docs.union(odd).union(repeated).select("*", *[F.lit("x").alias(c) for c in ("tokens", "p", "copies", "rate", "ids", "component_id", "fp", "marks", "row", "_0")])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, d in (("odd", every), ("none", every.filter("false"))):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.union(spark.createDataFrame([(None, 1, 1)], labels.schema)).write.parquet(str(tmp_path / name / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).select("doc_id", "sequence_id").collect()
    assert len(got) > 0 and 10**9 not in {r.doc_id for r in got}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_queries_of_small_tables(spark):
    """Every query's columns in the order of its contract; digests of the outputs themselves."""
    import zlib

    got = registry.op5_best_fit_packing(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = {(r.doc_id, r.piece): zlib.crc32(bytes(r.ids)) for r in packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got.collect()} == ids
    files = registry.op2_token_files(spark, SF).collect()
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    start = 0
    for r, d in zip(sorted(files, key=lambda r: r.doc_id), sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id), strict=True):
        x = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert registry.op9_lm_scoring(spark, SF).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
