"""Each operator against brute force, round trips or held-out accuracy, and the hard cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import embedding_dedup, html_extract, language_id, lm_score, mixing, packing, registry, simhash, token_counts, token_files, topk_search
from skein.llm.cluster import connected_components
from skein.llm.tokenizing import WordEncoder, tokenizer_path

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all".split()


def text(k, n=40):
    rng = np.random.default_rng(k)
    return " ".join(rng.choice(WORDS, n))


ROWS = [
    (1, text(1), "en", "a", 5), (2, text(1), "en", "a", 5), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "!!! ...", "en", "b", 3),
    (6, text(6, 20000), "en", "b", 9), (7, "  odd\n\n spaces \t and tabs  ", "en", "b", 1), (8, text(8) + " İÉ ß 你好 <|endoftext|> x", "en", "c", 1),
    (None, text(9), "en", "c", 1), (9, text(9, 3), None, "c", 1), (9, text(9, 3), None, "c", 1), (10, text(10, 5000), "en", "c", 1),
]
CLASH = ["marks", "t", "tokens", "words", "fp", "component_id", "rate", "copies", "ids", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def reference_ids(name, texts):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


# tokens ----------------------------------------------------------------------------------------

ODD = st.lists(st.sampled_from([*"abE's,.!?19 \n\t\r\u00a0\u200b\u00c9\u00e9\u00df\u0130\u0131\u0301你😀<|>", "<|endoftext|>", " the", " ein Haus", "  ", "\n\n"]), max_size=60).map("".join)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_exact(name):
    enc = WordEncoder(tokenizer_path(name), most=50)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(ODD, max_size=6))
    def check(texts):
        got = [np.frombuffer(x, np.uint32).tolist() for x in enc.ids(texts)]
        assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    check()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
def test_planes_round_trip(ids, bits):
    a = np.array(ids, "<u4")
    assert token_files.join_planes(token_files.split_planes(a, bits), len(a)).tolist() == ids


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(docs, none, bits):
    folder, files = token_files.write_token_files(docs, block=97, shard_ids=5000, bits=bits)
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in token_files.read_token_files(folder, files).collect())
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [x + [2] for x in reference_ids("word_bpe_49k.json", [r[1] for r in want])]
    start = np.cumsum([0, *map(len, ids)])
    assert got == [(int(s), r[0], np.array(x, "<u4").tobytes()) for s, r, x in zip(start, want, ids)]
    assert token_files.read_token_files(*token_files.write_token_files(none)).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, length=64).collect()
    want = Counter((r[0], np.array(x + [0], "<u4").tobytes()) for r, x in zip(ROWS, reference_ids("byte_bpe_50k.json", [r[1] for r in ROWS])))
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 <= 64
    for d, rs in by_doc.items():
        starts = sorted(rs, key=lambda r: (r.start, r.piece))
        if d != 9:
            assert want[d, b"".join(bytes(r.ids) for r in starts)] == 1
            assert all(r.length == 64 for r in starts[1:])
    assert sum(r.length for r in rows) == sum(len(k[1]) // 4 * n for k, n in want.items())
    for rs in bins.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *[r.length for r in rs]])[:-1].tolist()
        assert sum(r.length for r in rs) <= 64
    assert packing.pack_documents(none).count() == 0


def test_packing_stays_near_the_bound_over_many_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(211)
    rows = packing.pack_documents(docs).select("sequence_id", "length").collect()
    bound = -(-sum(r.length for r in rows) // 2048)
    assert len({r.sequence_id for r in rows}) <= bound + 0.7 * 2 * spark.sparkContext.defaultParallelism + 1


def test_best_fit_by_lists():
    """The bitset's placement against open bins in a list: the tightest that fits, the fullest closes when there are too many."""
    rng = np.random.default_rng(0)
    bins, free, next_id = packing.OpenBins(50, 6, 0), [], 0
    for n in rng.integers(1, 51, 2000).tolist():
        fits = [b for b in free if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
            free = [x for x in free if x is not b]
            want = b[0]
        else:
            b, want, next_id = [50, next_id], 50, next_id + 1
        got = bins.put(n)
        assert got[1] == 50 - want  # bins of equal space are alike
        if want - n:
            free.append([want - n, got[0]])
            if len(free) > 6:
                free.remove(min(free, key=lambda b: b[0]))


def test_open_bins_close_the_fullest():
    b = packing.OpenBins(10, 2, 0)
    assert b.put(6) == (0, 0) and b.put(7) == (1, 0)
    assert b.put(8) == (2, 0)  # three open: the fullest, 2, closes
    assert b.put(2) == (1, 7) and b.put(4) == (0, 6)


def test_token_counts(docs, none):
    got = {r.n_tokens: r for r in token_counts.token_counts(docs).collect()}
    n = np.array([len(x) for x in reference_ids("byte_bpe_50k.json", [r[1] for r in ROWS])])
    assert set(got) == set(n.tolist())
    for length, r in got.items():
        over = n[n > length]
        assert (r.n_docs, r.docs_over, r.tokens_over, r.total_tokens) == ((n == length).sum(), len(over), over.sum(), n.sum())
        assert (r.kept_tokens, r.cut_tokens) == (np.minimum(n, length).sum(), n.sum() - np.minimum(n, length).sum())
        assert r.quantile == pytest.approx((n <= length).mean())
    q = {r.share: r.n_tokens for r in token_counts.quantile_lengths(token_counts.token_counts(docs), [0.5, 1.0]).collect()}
    assert q == {0.5: sorted(n)[len(n) // 2 - 1], 1.0: n.max()}
    assert token_counts.token_counts(none).count() == 0


# text ------------------------------------------------------------------------------------------


def slow_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(keys, linked):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    out = []
    for i in range(len(keys)):
        ids = [keys[j] for j in range(len(keys)) if find(j) == find(i) and keys[j] is not None]
        out.append(min(ids, default=None))
    return out


def test_simhash(spark, docs, none):
    near = text(50, 400).split()
    rows = [(100 + k, " ".join(near[:k] + ["zz"] + near[k + 1 :])) for k in range(30)]
    every = docs.select("doc_id", "text", "fp", "component_id").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = simhash.simhash_groups(every, tiles=6, least_tile=4).collect()
    all_rows = [(r[0], r[1]) for r in ROWS] + rows
    fps = [slow_fingerprint(t) for _, t in all_rows]
    want = slow_groups([d for d, _ in all_rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{f:016x}", c) for (d, _), f, c in zip(all_rows, fps, want))
    kept = [r.doc_id for r in simhash.one_of_each_group(every).collect()]
    assert Counter(kept) == Counter({d: 1 for (d, _), c in zip(all_rows, want) if d is not None and d == c} | {None: 1})
    assert simhash.simhash_groups(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300))
def test_link_tiles(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    fp = np.unique(base[rng.integers(0, 20, n)] ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)))
    x, y = simhash.link_tiles(fp, None, 4)
    f = simhash.Forest(len(fp))
    f.link(x, y)
    want = simhash.Forest(len(fp))
    want.link(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp) <= 4))
    assert (f.roots(np.arange(len(fp))) == want.roots(np.arange(len(fp)))).all()
    cut = len(fp) // 2
    if cut:
        x, y = simhash.link_tiles(fp[:cut], fp[cut:], 4)
        f, want = simhash.Forest(len(fp)), simhash.Forest(len(fp))
        f.link(x, y)
        i, j = np.nonzero(np.bitwise_count(fp[:cut, None] ^ fp[cut:]) <= 4)
        want.link(i, j + cut)
        assert (f.roots(np.arange(len(fp))) == want.roots(np.arange(len(fp)))).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(2000, 2100)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    names = sorted({x for e in edges if e[0] != e[1] for x in e})
    f, at = simhash.Forest(len(names)), {x: k for k, x in enumerate(names)}
    f.link(*np.array([(at[a], at[b]) for a, b in edges if a != b]).T)
    assert got == {x: names[f.roots(np.array([at[x]]))[0]] for x in names}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy</div>
<main><h1>Head &amp; line</h1><p>One <b>t</b>wo<br>three<p>four &#233;<script>var x="</p>"</script><div class="share-box">Tweet</div><p>Five.</main>
<div id="comments"><p>First!</p></div><footer>(c)</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>plain words only</p>"), (5, "u", "<"), (None, "u", PAGE), (6, "u", "<div>" * 5000 + "deep words here now" + "</div>" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract_main_text(pages).collect()}
    main = "Head & line One two three four é Five."
    assert got == {(1, "u"): (main, len(main)), (2, None): ("", 0), (3, "u"): ("", 0), (4, "u"): ("plain words only", 16), (5, "u"): ("<", 1), (None, "u"): (main, len(main)), (6, "u"): ("deep words here now", 19)}
    assert html_extract.extract_main_text(pages.filter("false")).count() == 0


STORY = "<h1>Head</h1><p>" + "long story words " * 20 + "end.</p><p>" + "and so it goes on " * 9 + "here.</p>"
TOLD = "Head " + "long story words " * 20 + "end. " + "and so it goes on " * 9 + "here."
SIDE = '<div class="sidebar"><p>Side words here</p></div><div id="comments"><p>First comment</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content with-sidebar">{STORY}{SIDE}</div>',
        f'<div class="has-sidebar"><article>{STORY}</article></div>',
        f'<div class="entry no-comments"><article>{STORY}</article></div>',
        f'<div class="post search-engines"><article>{STORY}</article></div>',
        f'<article class="post search-engines">{STORY}</article>',
        f'<div id="page" class="no-sidebar"><article>{STORY}</article>{SIDE}</div>',
        f'<div class="search-result"><div class="share-layout"><main>{STORY}</main></div>{SIDE}</div>',
        f'<div role="main" class="with-sidebar">{STORY}{SIDE}</div>',
        f'<main><div class="related-layout">{STORY}{SIDE}</div></main>',
        f'<div class="has-header"><article>{STORY}</article><div id="comments"><article>{"A reader says so. " * 60}</article></div></div>',
        f'<article>{STORY}</article><section><article class="comment"><p>{"A reader says so. " * 20}</p></article></section>',
        f'<div>{STORY}</div><div id="comments"><p>{"A reader says so. " * 30}</p></div>',
        f'<div>Home | About us | Contact | Imprint</div><div>{STORY}</div><div>© 2024 Someone. All rights reserved.</div>',
        f'<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul><div>{STORY}</div><p><a href="/x">Next</a></p>',
        f'<main>{STORY.replace("</p><p>", "</p><aside><p>Read this too, it is very good.</p></aside><div class=share>Tweet it</div><p>")}</main>',
    ],
)
def test_html_keeps_the_article(page):
    assert html_extract.extract(page, html_extract.fit_weights({})) == TOLD


def test_html_weights_follow_the_labels():
    """What labelled pages show is learned, in either direction; the labels' own tags are no feature."""
    page = lambda k: f'<article><div class="widget"><p>{"Good words in here. " * (20 + k)}</p></div></article><div class="teaser"><blockquote>{"Other words out there. " * 5}</blockquote></div>'
    counts = Counter()
    for k in range(30):
        counts.update(html_extract.count_features(page(k)))
    w = html_extract.fit_weights(counts)
    assert w["in:blockquote"] < -0.5 < 0.5 < w["in:p"] and not any(f.startswith("in:article") for f in w)
    assert {i for (f, i) in counts if "in:p" in f} == {True}
    text = "<div><p>" + "Good words in here. " * 9 + "</p></div><blockquote>" + "Other words out there. " * 5 + "</blockquote>"
    assert html_extract.extract(text, w) == ("Good words in here. " * 9).strip()


def test_html_region_by_brute_force():
    """On whole pages no other contiguous run of words and tags scores more."""
    weights = html_extract.fit_weights({})
    for page in (PAGE, f"<div>Home | About</div>{STORY}{SIDE}<p>x</p>", "<p>one.</p><nav>two</nav><li>three<p>four five six seven.</p>"):
        p = html_extract.parse(page)
        scores, _ = html_extract.scored(p, weights)
        a, b = html_extract.best_region(scores)
        assert sum(scores[a:b]) == pytest.approx(max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)))


@pytest.mark.parametrize("page", ["<b></i>" * 100_000, "<p><div>" + "<b>" * 50_000 + "<hr>" * 50_000, "<li>" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, '<div class="ad">' * 50_000 + "x"])
def test_html_is_linear(page):
    start = time.perf_counter()
    html_extract.extract(page, html_extract.fit_weights({}))
    assert time.perf_counter() - start < 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_best_region(scores):
    a, b = html_extract.best_region(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    assert sum(scores[a:b]) == max(best, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("<>/pab \"'=!-&;") + ["<p>", "</p>", "<script>", "<!--", "-->"]), max_size=50).map("".join))
def test_html_never_fails(page):
    html_extract.extract(page, html_extract.fit_weights({}))


GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split()


def test_language_id(spark, none):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(GERMAN if k % 2 else WORDS, 3 + k % 60)), "de" if k % 2 else "en") for k in range(600)]
    d = spark.createDataFrame([*rows, (1000, None, "de"), (1001, "123 !!", "en"), (None, "the of and", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.fit(language_id.training_rows(d))
    got = {r.doc_id: r for r in language_id.identify(d, model).collect()}
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k].lang_pred == rows[k][2] for k in held]) > 0.97
    assert (got[1000].lang_pred, got[1000].score, got[1000].rejected) == ("und", 0.0, True)
    assert got[1001].lang_pred == "und" and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_identified(d, model)
    assert kept.columns == d.columns and 1000 not in [r.doc_id for r in kept.collect()] and kept.count() > 590
    assert language_id.identify(none, language_id.fit(none)).count() == 0


FOREIGN = [
    "ja se on niin kuin se on ollut ennen mutta nyt kaikki on toisin eikä kukaan tiedä miksi näin kävi",
    "że nie wszystko jest takie jak się wydaje ale przecież można spróbować jeszcze raz od początku",
    "это не совсем то что мы хотели сказать но пусть будет так как есть до завтрашнего дня",
    "xqzv kjwp zzkq vbnm qwxz jjkv pqzx wvkq zxcv kkqj vzzp qxjw bvkz pzqx jwvk qqzz xkcd",
    "这是一个很长的句子没有任何意义只是为了测试",
]


def test_language_id_rejects_what_it_has_not_learned(spark):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(GERMAN if k % 2 else WORDS, 20 + k % 60)), "de" if k % 2 else "en") for k in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(language_id.training_rows(d))
    assert model.predict([t for _, t, _ in rows])[2].mean() < 0.005
    assert model.predict(FOREIGN)[2].all()
    mixed = spark.createDataFrame([*rows, *[(2000 + k, t, None) for k, t in enumerate(FOREIGN)]], "doc_id long, text string, lang string")
    assert max(r.doc_id for r in language_id.keep_identified(mixed, model).collect()) < 2000


def test_language_id_query(spark, tmp_path):
    rows = [(k, " ".join(np.random.default_rng(k).choice(GERMAN if k % 2 else WORDS, 30)), "de" if k % 2 else "en") for k in range(100)]
    spark.createDataFrame([*rows, (None, "the of and", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 101 and {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


# vectors ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    rows = [(k, (base[k % 12] + rng.standard_normal(16) * (0.02 if k % 3 else 0.3)).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[7][1]) for k in range(60)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (None, rows[3][1]), (5, rows[5][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_near_duplicates(vectors):
    rows, df = vectors
    got = embedding_dedup.near_duplicates(df, bucket=8, tile=32).collect()
    unit = [np.array(v) / np.linalg.norm(v) if good(v) and any(v) else None for _, v in rows]
    link = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9
    comp = slow_groups([k for k, _ in rows], link)
    n = [sum(link(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))]
    want = Counter((k, m, c if unit[i] is not None else k) for i, ((k, _), m, c) in enumerate(zip(rows, n, comp)))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(df.filter("false")).count() == 0


def test_near_duplicates_at_the_border(spark):
    """Pairs within the rounding of packed vectors are decided by the vectors: cosines a little under, at and over 0.9."""
    rows = [(0, [1.0, 0.0])] + [(k + 1, [c, math.sqrt(1 - c * c)]) for k, c in enumerate((0.9 - 1e-9, 0.9 + 1e-9, 0.9 - 1e-5, 0.9 + 1e-5, 0.5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, recall=0.999999).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    assert got == {i: sum(bool(unit[i] @ unit[j] >= 0.9) for j in range(len(rows)) if j != i) for i in range(len(rows))}
    rng = np.random.default_rng(1)
    v = embedding_dedup._unit(rng.standard_normal((200, 64)))
    q, step = embedding_dedup.pack(v)
    assert np.abs(embedding_dedup.unpack(q, step) @ embedding_dedup.unpack(q, step).T - v @ v.T).max() <= embedding_dedup.error(64)


def best_of(rows, k=5, scale=256):
    q = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if good(v) and i is not None]
    want = []
    for i, v in q:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(w) == len(v))[:k]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(want)


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
def test_top_k(vectors, most_bytes):
    rows, df = vectors
    ask = lambda d, **o: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(d, F.col("vec_id") % 50 == 0, **o).collect())
    assert ask(df, buckets=7, block=64, query_block=3, most_bytes=most_bytes) == best_of(rows)
    assert ask(df.filter("false")) == []
    assert topk_search.top_k(df.filter("vec_id in (50, 51)"), F.col("vec_id") == 50).count() == 1


def test_top_k_of_large_numbers(spark):
    """Scores beyond 2^53 are exact; ones that may not fit 64 bits raise."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, 3)]) for k in range(120)] + [(200 + k, [float((1 << 21) + k), 1.0, -1.0]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == best_of(rows) and max(r[3] for r in got) > 1 << 53
    with pytest.raises(ValueError):
        topk_search.top_k(spark.createDataFrame([(0, [1e10]), (1, [4e10])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)


# models ----------------------------------------------------------------------------------------


SMALL = {"groups": 4, "class_words": 8, "class_tokens": 1 << 30, "least_classes": 2}


def test_lm_scores(spark, docs, none):
    more = spark.createDataFrame([(100 + k, text(k, 30)) for k in range(300)], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(more)
    got = lm_score.score_documents(every, vocabulary=20, **SMALL).collect()
    rows = [(r.doc_id, lm_score.words_of((r.text or "").encode())) for r in every.collect()]
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 != 0
    c = Counter(w for d, ws in rows if train(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), not train(d), len(ws), sum(w in c for w in ws), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert lm_score.score_documents(none).count() == 0
    unseen = lm_score.score_documents(docs.filter("doc_id = 7").withColumn("doc_id", F.lit(10).cast("long")))  # crc32("10") mod 10 is not 0
    assert unseen.first().score < 0


def test_lm_scores_by_brute_force(spark):
    """The whole model by dictionaries: every symbol, class, sub-class and word, token by token."""
    rng = np.random.default_rng(8)
    names = [f"w{k}" for k in range(60)]
    chance = 1 / (1 + np.arange(60.0))
    rows = [(k, " ".join(rng.choice(names, int(rng.integers(0, 40)), p=chance / chance.sum())) + (" Fresh" if k % 7 == 0 else "")) for k in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    learned = d.filter(lm_score.is_training())
    counts = lm_score.materialize(lm_score.count_words(learned), "counts")
    v = lm_score.learn_vocabulary(counts, 0.1, 10, **SMALL)
    model = lm_score.train_model(learned, v, 4)
    got = {r.doc_id: r.score for r in lm_score.score_with(d, counts, v, model).collect()}
    c = Counter({bytes(r.word): r.c for r in counts.collect()})
    assert v.words == [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:10]] and v.classes % v.groups == 0 and v.classes > v.groups
    one, two = lm_score.context_rows(model)
    symbol = lambda w: v.words.index(w) if w in v.words else 10 + zlib.crc32(w) % v.classes % v.groups
    by_class = {k: sorted((w for w in c if w not in v.words and zlib.crc32(w) % v.classes == k), key=lambda w: (-c[w], w)) for k in range(v.classes)}
    texts = {k: lm_score.words_of(t.encode()) for k, t in rows}
    contexts = {k: [(symbol(ws[i - 1]) if i else len(v.unigram), symbol(ws[i - 2]) if i > 1 else len(v.unigram)) for i in range(len(ws))] for k, ws in texts.items()}
    fitted = {}
    for k, ws in by_class.items():
        fitted[k] = lm_score.ClassModel(np.array([c[w] for w in ws], float), 4)
        seen = [(one[a] + two[b], ws.index(w)) for doc in texts if zlib.crc32(str(doc).encode()) % 10 != 0 for w, (a, b) in zip(texts[doc], contexts[doc]) if w in ws]
        fitted[k].train(np.array([h for h, _ in seen], np.float32).reshape(-1, 4), np.array([y for _, y in seen], np.int64), 5 + k)

    def soft(h, q, b):
        z = np.exp(q.astype(float) @ h + b)
        return z / z.sum()

    def probabilities(a, b):  # of every word after a, b one and two places before, and of an unseen one of each class
        h = (one[a] + two[b]).astype(float)
        first = soft(h, model.q, model.b)
        out = {w: first[k] for k, w in enumerate(v.words)}
        for k, ws in by_class.items():
            f = fitted[k]
            total = sum(c[w] for w in ws)
            share = first[10 + k % v.groups] * (total + 0.1) / (v.group_counts[k % v.groups] + 0.1 * v.classes / v.groups)
            unseen = 0.1 / (total + 0.1 * (len(ws) + 1))
            out[k] = share * unseen
            nodes = soft(h, f.qn, f.bn) if ws else []
            for j, w in enumerate(ws):
                lo = j // f.fan * f.fan
                out[w] = share * (1 - unseen) * nodes[j // f.fan] * soft(h, f.qw[lo : lo + f.fan], f.bw[lo : lo + f.fan])[j - lo]
        return out

    for a, b in ((0, 0), (3, 11), (len(v.unigram), len(v.unigram))):
        assert sum(probabilities(a, b).values()) == pytest.approx(1, abs=1e-5)
    for k, ws in list(texts.items())[:60]:
        want = 0.0
        for w, (a, b) in zip(ws, contexts[k]):
            p = probabilities(a, b)
            want += math.log10(p[w] if w in p else p[zlib.crc32(w) % v.classes])
        assert got[k] == pytest.approx(want, abs=1e-3), k


def test_lm_is_normalised():
    m = lm_score.LogBilinear.start(np.array([0.5, 0.3, 0.2]), 4, 1)
    t = lm_score.Tables(m)
    for c1 in range(4):
        for c2 in range(4):
            p = 10 ** t.log10(np.full(3, c2), np.full(3, c1), np.arange(3))
            assert p.sum() == pytest.approx(1, abs=1e-5)


def test_nce_learns_order():
    seq = np.tile([0, 1, 2], 4000)
    uni = np.array([1, 1, 1, 1e-3])
    t = lm_score.Trainer(lm_score.LogBilinear.start(uni / uni.sum(), 8, 1), uni, 1, batch=256)
    for _ in range(4):
        t.learn(seq[:-2], seq[1:-1], seq[2:])
    p = lm_score.Tables(t.m).log10(seq[:3], seq[1:4], seq[2:5])
    assert (10**p > 0.7).all()


def test_mixing(spark, docs, none):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(400):
        kind = k % 4
        words = rng.choice(WORDS, 50).tolist() + (["idiot", "scum"] if kind == 3 else ["!!!"] * 60 if kind == 2 else [])
        rows.append((k + 100, " ".join(words)))
        if k % 2 == 0 or k % 4 == 3 and k < 200:
            labels.append((k + 100, 0 if kind == 2 else 1, int(kind == 3)))
    d = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (102, None, None), (100, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(d, lab).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in d.collect())
    tokens = {r.doc_id: len((r.text or "").split()) for r in d.collect()}
    assert all(r.tokens == tokens[r.doc_id] and r.rate >= 0 for r in got if r.doc_id not in (7, 9))
    p = np.array([[r[f"p_{x}"] for x in mixing.TARGETS] for r in got])
    assert p.sum(axis=1) == pytest.approx(1, abs=1e-6)
    total = (np.array([r.rate * r.tokens for r in got])[:, None] * p).sum(axis=0)
    assert total / total.sum() == pytest.approx(list(mixing.TARGETS.values()), abs=2e-3)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[k + 100].p_toxic > 0.5 for k in range(3, 400, 4)]) > 0.95
    assert np.mean([by[k + 100].p_poor > 0.5 for k in range(2, 400, 4)]) > 0.95
    out = mixing.mixed_documents(d, lab)
    assert out.columns == d.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: n for k, n in sum((Counter({r.doc_id: r.copies}) for r in got), Counter()).items() if n})
    assert mixing.mix(none, lab).count() == 0 and mixing.mix(docs, lab.filter("false")).count() == len(ROWS)
    assert mixing.mixed_documents(none, lab).count() == 0


def test_projected_gradient_matches_a_direct_solution(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200).round(6)
    t = rng.integers(1, 100, 200)
    m = spark.createDataFrame([(int(n), tuple(map(float, x))) for n, x in zip(t, p)], "tokens long, p struct<clean:double,poor:double,toxic:double>")
    _, reached = mixing.fit_rates(m, mixing.TARGETS, budget=5000.0)
    assert list(reached.values()) == pytest.approx([4500, 400, 100], rel=1e-3)


def skewed(spark, shares, n=2000):
    """Documents and labels; ids rise from clean over poor to toxic ones by the shares."""
    rng, of = np.random.default_rng(3), np.cumsum([round(n * x) for x in shares[:2]])
    kind = [int(np.searchsorted(of, k, side="right")) for k in range(n)]
    sign = [[], ["!!!"] * 5 + ["spam", "buynow"], ["idiot", "scum"]]
    rows = [(k, " ".join(rng.choice(WORDS, 50).tolist() + sign[x])) for k, x in enumerate(kind)]
    labels = [(k, int(x != 1), int(x == 2)) for k, x in enumerate(kind)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), np.array(kind)


def mixed_shares(got, by):
    total = (np.array([r[by] * r.tokens for r in got])[:, None] * np.array([[r[f"p_{x}"] for x in mixing.TARGETS] for r in got])).sum(axis=0)
    return total / total.sum()


def test_mixing_keeps_clean_documents_beside_scarce_domains(spark):
    d, lab, kind = skewed(spark, (0.95, 0.04, 0.01))
    got = sorted(mixing.mix(d, lab).collect(), key=lambda r: r.doc_id)
    rate = np.array([r.rate for r in got])
    assert rate[kind == 0] == pytest.approx(1, abs=1e-2) and min(r.copies for r in got) >= 1
    assert rate[kind == 1].mean() > 1.5 and rate[kind == 2].mean() > 1.5
    assert mixed_shares(got, "rate") == pytest.approx(list(mixing.TARGETS.values()), abs=1e-3)
    with pytest.warns(UserWarning, match="poor, toxic"):
        got = mixing.mix(d, lab.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))).collect()
    assert {(r.rate, r.copies) for r in got} == {(1.0, 1)}


@pytest.mark.parametrize("shares", [(0.3, 0.1, 0.6), (0.95, 0.04, 0.01)])
def test_copies_meet_the_targets(spark, shares):
    d, lab, kind = skewed(spark, shares)
    got = sorted(mixing.mix(d, lab).collect(), key=lambda r: r.doc_id)
    rate, copies, tokens = (np.array([r[c] for r in got]) for c in ("rate", "copies", "tokens"))
    for k in range(3):
        at, rest = kind == k, rate - np.floor(rate)
        noise = np.sqrt((tokens**2 * rest * (1 - rest))[at].sum())
        assert abs((tokens * (copies - rate))[at].sum()) <= 4 * noise + 1e-3
        assert copies[at].sum() > 0
    assert mixed_shares(got, "copies") == pytest.approx(list(mixing.TARGETS.values()), abs=0.02)
