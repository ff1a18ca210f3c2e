"""Pages, pieces, quality, mixing, embeddings and codes on small fixtures."""

import collections
import glob
import hashlib
import os
import pathlib
import random
import shutil
import subprocess
import sys
import time
import weakref

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import embed_dedup, hamming_topk, html_text, mixing, ngram_join, quality, queries, repeats, sp_codec

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", ""),
        ("<article><h1>T &amp; t</h1><p><b>One<br> two<p>Three\n four</article><footer>f</footer>", "T & t\nOne two\nThree four"),
        ("<nav><a href=x>m</a></nav><main><div class='ad'>buy</div><p>Kept</p><aside>s</aside><ul><li>a<li>b</ul><form>f</form></main>", "Kept\na\nb"),
        ("<article><p>x<script>var a='</p>'</script>y</p><!-- c --><style>p{}</style><div id=comments><p>no</p></div></article>", "xy"),
        ("<article><p>in<p>&lt;b&gt; &eacute;&#8364;</article><p>out</p>", "in\n<b> é€"),
        ("<div class='cookie-notice'>c</div><div class='post'><p>a</p></div>", "a"),
        ("<nav><ul><li>open<article><p>text</p></article>", "text"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_main_text_without_article():
    good = "It is the story of a man who was in the town and of the people that he had met there, " * 4
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><p>{good}</p><p>He left.</p><p>{good}</p><div><a href=3>Contact</a></div><p>\N{COPYRIGHT SIGN} X</p></body>"
    assert html_text.main_text(page) == "\n".join([good.strip(), "He left.", good.strip()])


PROSE = "It is the story of a man who was in the town and of the people that he had met there, " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a teaser doesn't outweigh a dense body in a plain div
        (f"<body><nav><a href=x>Home</a></nav><article><p>See this.</p></article><nav><a href=x>Home</a><br><br><a href=y>News</a></nav><div><p>{PROSE}</p><p>He left.</p><p>{PROSE}</p></div></body>", f"{PROSE.strip()}\nHe left.\n{PROSE.strip()}"),
        # nothing of an article's flow is lost: a paragraph that is one link, one without stop words, a short one
        (f"<article><h1><a href=x>Title</a></h1><p>{PROSE}</p><p><a href=y>{PROSE}</a></p><p>{'qwx ' * 30}</p><p>© sign</p></article><p>out</p>", f"Title\n{PROSE.strip()}\n{PROSE.strip()}\n{('qwx ' * 30).strip()}\n© sign"),
        # hints inside an article are weighed by density, names that say it plainly aren't
        (f"<article><div class=legal><p>{PROSE}</p></div><div class=related><a href=x>More</a></div><div class=notice>{PROSE}</div><div class=post-header><h1>T</h1></div></article>", f"{PROSE.strip()}\nT"),
        # articles in an aside that is closed are part of it
        ("<aside><h3>More</h3><article><p>teaser</p></article></aside><article><p>own</p></article>", "own"),
        # broken markup
        ("<article><p title='a>b\">x</p><p>y</p></article>", 'b">x\ny'),
        ("<article><p>1 < 2 and a<b</p> <![CDATA[ z ]]><p>3", "1 < 2 and a\n3"),
        ("<article><p>x</p><!-- open <p>y", "x"),
        ("<article><p>x<script>var a = '", "x"),
    ],
)
def test_main_text_by_density(page, text):
    assert html_text.main_text(page) == text


def test_broken_pages_take_linear_time():
    def took(page):
        start = time.process_time()
        html_text.main_text(page)
        return time.process_time() - start

    for piece in ('<a "', "<b></i>", "<li>", "<p>", "a<", "<!", "<!--", "<![CDATA[>", "<script>", "<nav><article>"):
        assert took(piece * 16_000) < 8 * took(piece * 4_000) + 0.5


def test_long_page():
    assert html_text.main_text("<article>" + f"<p>{PROSE}</p>" * 3_000 + "</article>") == "\n".join([PROSE.strip()] * 3_000)


def test_extract_text(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", "x"), (2, None, None, "x"), (1, "u", "<article><p>é</p></article>", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract_text(pages).collect()), key=str) == [(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return sp_codec.Pieces(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(model):
    texts = ["", " ", "  a  b ", "x\n y\n\n", "▁x y", "日本 語\t", "<s> </s> <0x0A>", "The  thing, don't! é́ \U0001f600", "a" * 3000, "one two " * 500]
    encoded, library = model.encode(texts), model.model.encode(texts)
    assert [e.tolist() for e in encoded] == library
    assert [model.decode(e.tolist()) for e in encoded] == [model.model.decode(e) for e in library]


def test_samples_are_distinct_and_follow_the_lattice(model):
    ids = model.encode(["tion the"])[0]
    steps = sp_codec.Steps(model, ids)
    first = collections.Counter()
    for key in range(3000):
        found, edge = sp_codec.sample_paths(steps, key, 4)
        values = [f[2] for f in found] + [edge]
        assert values == sorted(values, reverse=True)
        assert len({tuple(f[0]) for f in found}) == len(found)
        assert all(model.decode(steps.spelled(f[0]).tolist()) == "tion the" for f in found)
        first[round(found[0][1], 9)] += 1
    log_p, n = first.most_common(1)[0]
    assert abs(n / 3000 - np.exp(log_p)) < 0.04


def test_all_paths_of_a_small_lattice(model):
    steps = sp_codec.Steps(model, model.encode(["at"])[0])
    found, edge = sp_codec.sample_paths(steps, 5, 1000)
    assert edge == -np.inf and abs(sum(np.exp(f[1]) for f in found) - 1) < 1e-9


def spellings(model, word):
    """All ways to write a word in pieces of the vocabulary, with their weights in logs."""
    ways = [[((), 0.0)]] + [[] for _ in word]
    for end in range(1, len(word) + 1):
        for start in range(end):
            if (p := model.plain.get(word[start:end])) is not None:
                ways[end] += [((*w, p), x + model.logit[p]) for w, x in ways[start]]
    return dict(ways[-1])


def test_lattice_crosses_the_encoding(model):
    word = "▁aneder"
    every = spellings(model, word)
    total = np.logaddexp.reduce(list(every.values()))
    steps = sp_codec.Steps(model, model.encode(["aneder"])[0])
    found, edge = sp_codec.sample_paths(steps, 7, 10_000)
    got = {tuple(steps.spelled(f[0]).tolist()): f[1] for f in found}
    assert edge == -np.inf and set(got) == set(every) and {model.plain[p] for p in ("ane", "aned", "ned")} <= {p for w in got for p in w}
    assert all(abs(got[w] - (x - total)) < 1e-8 for w, x in every.items())
    first = collections.Counter(tuple(steps.spelled(sp_codec.sample_paths(steps, key, 1)[0][0][0]).tolist()) for key in range(3000))
    assert all(abs(first[w] / 3000 - np.exp(p)) < 0.04 for w, p in got.items())


def test_lattices_of_texts_are_independent(model):
    texts = ["aneder  x", "", "日本 Ⅷ\n\U0001f600", "an " * 40, "aneder  x", "a" * 300]
    keys = [1, 2, 3, 4, 1, 6]
    together = sp_codec.Steps.over(model, [model.chunks(t) for t in texts])
    for text, key, (found, edge) in zip(texts, keys, sp_codec.sample_texts(together, keys, 3), strict=True):
        alone = sp_codec.Steps(model, model.encode([text])[0])
        again, same = sp_codec.sample_paths(alone, key, 3)
        assert edge == same and [f[1:] for f in found] == [f[1:] for f in again]
        assert all(model.decode(together.spelled(f[0]).tolist()) == text for f in found)


def test_words_with_other_marks_share_a_lattice(model):
    own = sp_codec.Pieces(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    texts = ["aneder, aneder. aneder;\naneder\n(aneder)", "x1y2-z \n\n é,Ñandú", "  a,\n  b--\t日本x 本. ab", "ана,x…a”"]
    assert [e.tolist() for e in own.encode(texts[:1])] == own.model.encode(texts[:1])
    assert own.lattice.nodes <= 2 * len(" aneder") + 12  # each word with its marks took 8 and more
    assert [e.tolist() for e in own.encode(texts)] == own.model.encode(texts)
    kinds = [set(own._kind[[ord(c) for c in p.lstrip(sp_codec.SPACE)]].tolist()) for p in own.plain if p.strip(sp_codec.SPACE)]
    assert max(map(len, kinds)) == 1 and {1} in kinds and {2} in kinds


def test_cuts_within_words_and_shared_hashes_change_no_sample(model, monkeypatch):
    texts = ["aneder, x.y\nZz(aneder) 1a2b", "", "日本,ab Ⅷ\n\U0001f600a", "  an--an; an, an.\nAn" * 20, "a" * 300]
    keys = [1, 2, 3, 4, 5]
    drawn = lambda m: [([(s.spelled(w).tolist(), round(p, 9), round(v, 9)) for w, p, v in found], round(edge, 9)) for s in [sp_codec.Steps.over(m, [m.chunks(t) for t in texts])] for found, edge in sp_codec.sample_texts(s, keys, 3)]
    expected = drawn(model)
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    with monkeypatch.context() as at:
        at.setattr(sp_codec.tn, "span_hash", lambda prefix, start, end: np.zeros(len(start), np.uint64))
        same = sp_codec.Pieces(path)
        assert drawn(same) == expected and [e.tolist() for e in same.encode(texts)] == same.model.encode(texts)
    monkeypatch.setattr(sp_codec.Pieces, "_alphabet", lambda self: "")
    whole = sp_codec.Pieces(path)
    assert whole.chunks("a,b  c") == [" a,b", "  c"] and model.chunks("a,b  c") == [" a", ",", "b", "  c"]
    assert drawn(whole) == expected


def test_forgotten_words_are_met_again(monkeypatch):
    monkeypatch.setattr(sp_codec, "MEMO_EDGES", 20)
    own = sp_codec.Pieces(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    for text in ["some words here, some", "other words there", "other words, some there", "", "here other"]:
        own.lattice.trim()
        assert own.encode([text])[0].tolist() == own.model.encode(text)
    own.lattice.trim()
    assert own.lattice.words == own.lattice.number.n == 4


def test_codec_digest(spark):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "some text here", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "some text here", 0)], "doc_id long, text string, ids int")
    rows = sp_codec.codec_digest(docs, path).collect()
    assert len(rows) == 5 and all(r["samples_agree"] for r in rows)
    assert len({str(r["samples"]) for r in rows if r["doc_id"] == 1}) == 1
    assert sp_codec.codec_digest(docs.limit(0), path).count() == 0
    encoded = sp_codec.encode(docs, path).collect()
    shape = lambda s: [(len(x["ids"]), round(x["log_p"], 6), round(x["inclusion"], 6)) for x in s]
    assert sorted(str((r["doc_id"], shape(r["samples"]))) for r in encoded) == sorted(str((r["doc_id"], [tuple(x) for x in r["samples"]])) for r in rows)
    texts = {r["doc_id"]: r["decoded"] for r in sp_codec.decode(sp_codec.encode(docs, path), path).collect()}
    assert texts == {1: "some text here", 2: "", 3: "", None: "x"}
    assert {r["text_sha256"] for r in rows} == {hashlib.sha256(t.encode()).hexdigest() for t in texts.values()}


def test_codec_digest_tells_every_sample(spark, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "some text here"), (2, None), (3, "aneder 日本"), (4, "")], "doc_id long, text string").coalesce(1)
    sha = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    expected = {r["doc_id"]: (sha(r["ids"]), [sha(s["ids"]) for s in r["samples"]], [round(s["perturbed"], 6) for s in r["samples"]]) for r in sp_codec.encode(docs, path, k=4).collect()}
    assert {r["doc_id"]: (r["ids_sha256"], r["samples_sha256"], r["perturbed"]) for r in sp_codec.codec_digest(docs, path, k=4).collect()} == expected

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["some text here", None, "aneder"])], names=["doc_id", "text"])
    encode = sp_codec._encode

    def last_is_wrong(path, k):
        """The last sample of the last text loses its last piece."""

        def run(batches):
            for b in encode(path, k)(batches):
                rows = b.column("samples").to_pylist()
                rows[-1][-1]["ids"].pop()
                yield b.set_column(2, "samples", pa.array(rows, b.column("samples").type))

        return run

    agree = lambda: [x for b in sp_codec._digest(path, 3)(iter([batch])) for x in b.column("samples_agree").to_pylist()]
    assert agree() == [True, True, True]
    monkeypatch.setattr(sp_codec, "_encode", last_is_wrong)
    assert agree() == [True, True, False]


def test_a_worker_that_goes_on_lets_go_of_the_model():
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6]), pa.array([0, 0]), pa.array(["some text here", None])], names=["doc_id", "row", "order", "text"])
    encode = lambda: [b.to_pylist() for b in sp_codec._encode(path, 2)(iter([docs]))]
    others = [
        lambda: quality._stat_rows(iter([docs])),
        lambda: ngram_join._celled(5, ngram_join.Cells.of(0.8))(iter([docs])),
        lambda: repeats._run_rows(repeats.WORDS_50)(iter([docs])),
    ]
    first = encode()
    for other in others:
        model = weakref.ref(sp_codec.pieces(path))
        assert encode() == first and sp_codec.pieces(path) is model()  # the next task of the encoder finds it
        list(other())
        assert model() is None
        assert encode() == first


def test_codec_of_long_texts_through_spark(spark):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    texts = ["word " * 40_000, "x" * 30_000, "日本 " * 9_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["decoded"] for r in sp_codec.decode(sp_codec.encode(docs, path), path).collect()} == dict(enumerate(texts))


def test_sampling_is_top_k_without_replacement(model):
    """Order and inclusion of the first two samples against all ordered pairs of a small lattice."""
    word = "▁aned"
    every = spellings(model, word)
    total = np.logaddexp.reduce(list(every.values()))
    p = {w: float(np.exp(x - total)) for w, x in every.items()}
    steps = sp_codec.Steps(model, model.encode(["aned"])[0])
    pairs, scores, n = collections.Counter(), collections.Counter(), 4000
    for key in range(n):
        found, edge = sp_codec.sample_paths(steps, key, 2)
        drawn = [tuple(steps.spelled(f[0]).tolist()) for f in found]
        pairs[tuple(drawn)] += 1
        for w, f in zip(drawn, found, strict=True):
            scores[w] += -np.expm1(-np.exp(f[1] - edge)) ** -1
    for (a, b), count in pairs.most_common(6):
        assert abs(count / n - p[a] * p[b] / (1 - p[a])) < 0.04
    assert all(abs(scores[w] / n - 1) < 0.25 for w in sorted(p, key=p.get)[-3:])  # 1 / inclusion is unbiased


def test_quality_on_shouting(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        good = i % 3 > 0
        text = " ".join(r.choice(words) for _ in range(60))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality").where("doc_id < 500")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(1000, None), (1001, ""), (None, "x")], "doc_id long, text string"))
    got = {g["doc_id"]: g for g in quality.score_quality(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= g["score"] <= 1 for g in got.values())
    held = [got[i]["predicted"] == q for i, _, q in rows if got[i]["held_out"]]
    assert sum(held) / len(held) > 0.95
    assert quality.keep_good(docs.where("doc_id < 600"), labels).columns == docs.columns


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(docs, empty).first()["score"] == 0.5


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1])).tolist() == [0, 0.5, 0.5, 1]


def vectors(spark, arrays, labels=None):
    rows = [(i, v, (labels or {}).get(i, 0), "e") for i, v in enumerate(arrays)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x)
    arrays = [unit(rng.standard_normal(64)).tolist() for _ in range(200)]
    for i in range(30):  # near copies of one vector, close and at the threshold's edge
        arrays.append((unit(np.array(arrays[0]) + rng.standard_normal(64) * (0.01 if i < 20 else 0.045))).tolist())
    arrays += [None, [0.0] * 64, [float("nan")] * 64, arrays[5], arrays[5], arrays[6][:10]]
    labels = {5: None, 7: 1}
    df = vectors(spark, arrays, labels)
    df = df.withColumn("label", F.when(F.col("vec_id") == 5, None).otherwise(F.col("label")))
    got = {r["vec_id"]: r for r in embed_dedup.embedding_digest(df).collect()}
    x = np.array([a if a is not None and len(a) == 64 and np.isfinite(a).all() and any(a) else [0.0] * 64 for a in arrays], np.float32).astype(float)
    norm = np.linalg.norm(x, axis=1)
    x = x / np.where(norm, norm, 1)[:, None]
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    hit[5], hit[:, 5] = False, False
    hit[7], hit[:, 7] = False, False
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(arrays) and 0.9 * hit.sum() <= found <= hit.sum()
    assert all(r["n_links"] <= hit[i].sum() for i, r in got.items())
    assert got[233]["component_id"] == 233 and got[234]["component_id"] == 233 and not got[234]["kept"] and got[230]["n_links"] == 0


def test_embedding_blocks_and_empty(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    arrays = [(base + rng.standard_normal(32) * 0.2).tolist() for _ in range(60)]
    counts, _ = embed_dedup.lattice_links(vectors(spark, arrays), pairwise=0, block=7)
    x = np.array(arrays, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    total = (x @ x.T >= 0.93).sum() - len(x)
    assert 0.9 * total <= counts.agg(F.sum("n_links")).first()[0] <= total
    assert embed_dedup.embedding_digest(vectors(spark, arrays).limit(0)).count() == 0


def test_embedding_recall(spark):
    """Planted neighbours at and above the threshold, through the whole query."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((400, 64)))
    cos = rng.uniform(0.931, 0.99, 400)[:, None]
    away = unit(rng.standard_normal((400, 64)))
    away = unit(away - (away * base).sum(1, keepdims=True) * base)
    near = base * cos + away * np.sqrt(1 - cos**2)
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.embedding_digest(vectors(spark, np.concatenate([base, near]).tolist())).collect()}
    assert sum(got.values()) >= 0.99 * 800 and max(got.values()) == 1


def test_lattice_points_are_nearest():
    x = np.random.default_rng(0).standard_normal((50, 8)) * 3
    p = embed_dedup.nearest_e8(x)
    for v in embed_dedup.MINIMAL:
        assert (((x - p) ** 2).sum(1) <= ((x - p - v) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize(("size", "block"), [(64, 50_000), (100, 50_000), (64, 9)])
def test_top_k(spark, monkeypatch, size, block):
    monkeypatch.setattr(hamming_topk, "BLOCK", block)
    rng = np.random.default_rng(5)
    arrays = rng.standard_normal((150, size)).tolist()
    arrays += [arrays[0]] * 15 + [None, [None] * 64, [1.0] * 10]
    df = vectors(spark, arrays)
    df = df.union(df.where("vec_id < 4"))  # repeated rows
    got = collections.defaultdict(list)
    for r in hamming_topk.search_digest(df, 10, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    bits = {i: np.array([(a[j] or 0) > 0 if j < len(a) else False for j in range(size)]) for i, a in enumerate(arrays) if a is not None and None not in a}
    for q in (i for i in bits if i % 20 == 0):
        assert got[q] == sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:10]
    assert set(got) == {i for i in bits if i % 20 == 0}


def test_top_k_of_few(spark):
    few = vectors(spark, np.random.default_rng(5).standard_normal((3, 64)).tolist())
    assert hamming_topk.search_digest(few, 10, 1).count() == 6
    assert hamming_topk.search_digest(few.limit(1), 10, 1).count() == 0
    assert hamming_topk.search_digest(few.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(i, "a b c", "big" if i % 10 else "small", ["en", "de", None][i % 3], 5) for i in range(600)]
    docs = spark.createDataFrame(rows + [(None, None, None, None, None)], "doc_id long, text string, source string, lang string, factor int")
    out = mixing.with_probability(docs, mixing.Mix(temper=(0.0, 1.0, 1.0), fraction=0.5))
    assert out.columns == [*docs.columns, "mix"] and out.count() == 601
    share = {r["s"]: r["w"] for r in out.groupBy("mix.source").agg(F.sum(F.col("mix.factor") * mixing.tokens(F.col("text"))).alias("w")).withColumnRenamed("source", "s").collect()}
    assert abs(share["big"] / share["small"] - 1) < 0.01
    targets = {"source": spark.createDataFrame([("big", 3.0), ("small", 1.0)], "value string, share double")}
    out = mixing.with_probability(docs.where("doc_id is not null"), mixing.Mix(), targets)
    share = {r["s"]: r["w"] for r in out.groupBy(F.col("mix.source").alias("s")).agg(F.sum(F.col("mix.factor") * mixing.tokens(F.col("text"))).alias("w")).collect()}
    assert abs(share["big"] / share["small"] - 3) < 0.01
    assert mixing.sample_mix(docs).columns == docs.columns
    assert mixing.mixing_digest(docs.limit(0)).count() == 0


def test_expected_sample_meets_targets(spark):
    cells = {("a", "en"): 300, ("a", "de"): 20, ("b", "en"): 100, ("b", "de"): 180}
    rows = [(i, "x", *cell) for i, cell in enumerate(c for c, n in cells.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    weight = F.sum(F.col("mix.probability") * mixing.tokens(F.col("text")))

    def expected(mix, c):
        out = mixing.with_probability(docs, mix)
        assert out.agg(F.max("mix.probability")).first()[0] <= 1
        return {r[0]: r[1] for r in out.groupBy(f"mix.{c}").agg(weight).collect()}

    open_mix = mixing.Mix(temper=(1.0, 0.0, 1.0))  # factors would give cell (a, de) 1.48: the others make up for it
    for c, target in (("source", {"a": 160, "b": 140}), ("lang", {"en": 150, "de": 150})):
        assert all(abs(w / target[v] - 1) < 0.02 for v, w in expected(open_mix, c).items())
    scarce = mixing.Mix(temper=(1.0, 0.0, 1.0), fraction=0.9)  # de has 200 of the 270 tokens wanted: en gets the others
    assert all(abs(w / {"de": 200, "en": 340}[v] - 1) < 0.02 for v, w in expected(scarce, "lang").items())


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, expected = queries.QUERIES[name](spark, SF), db.execute(queries.ORACLE_SQL[name])
    names = sorted(got.columns)
    told = [d[0] for d in expected.description]
    as_rows = lambda rows: sorted(map(str, (tuple(r[n] for n in names) for r in rows)))
    assert sorted(told) == names
    assert as_rows(got.collect()) == as_rows(dict(zip(told, r, strict=True)) for r in expected.fetchall())


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert rows and rows <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_entry_without_this_subpackage(tmp_path):
    root = pathlib.Path(__file__).parents[2]
    shutil.copytree(root / "waymark", tmp_path / "waymark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    told = "import __spark_entry__ as e; print(*e.queries())"
    names = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, env={"PATH": os.environ["PATH"]}, capture_output=True, text=True, check=True).stdout.split()
    assert "match_end_to_end" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)


ODD = [(1, "fine words in a row", "a", "en", 4), (1, "fine words in a row", "a", "en", 4), (1, "another text", None, None, None), (None, "no id", "b", "de", 1), (2, None, None, "en", 0), (3, "", "a", "en", 0), (4, "long " * 5000, "a", "en", 25000)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, rows):
    """Nulls, empty and long texts, ties, repeated rows, extra and clashing columns, and no rows at all."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (4, 0)][: len(rows)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r, 1, "x", [1]) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, row int, node string, ids array<int>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert len(kept) <= len(rows)
        if name.startswith("n-gram"):
            assert len(kept) == len(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == len(rows)
