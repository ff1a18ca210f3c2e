"""Helper names that clash, ids that clash, rare values, and odd pages."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from waymark.llm import embed_dedup, html_text, mixing, ngram_join, quality, window_dedup
from waymark.llm.scratch import unused

NAMES = ["row", "_row", "_row_", "_kept", "_gone", "node", "ids", "mix", "_mix", "_source", "_lang", "_topic", "words", "spans", "factor", "total", "n_shingles", "component", "score", "stats", "hash", "bin"]
PASSAGE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        own = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(30))
        rows.append((i, f"{own} {PASSAGE}" if i % 4 == 0 else rows[-1][1] if i % 4 == 2 else own, "en", "s1" if i % 3 else "s2", 7))
    rows += [(None, None, None, None, None), (3, "", "en", "s1", 0), (3, "the other text of three", "de", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def unchanged(docs, out):
    assert out.columns == docs.columns
    assert out.select(*NAMES).distinct().collect() == docs.select(*NAMES).distinct().collect()


def test_stages_carry_columns_of_any_name(spark, clashing):
    kept = ngram_join.keep_first_of_groups(clashing, words=5, similarity=Fraction(4, 5))
    unchanged(clashing, kept)
    assert {r.doc_id for r in clashing.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in range(40) if i % 4 == 2}
    cut = window_dedup.dedup_windows(clashing)
    unchanged(clashing, cut)
    assert cut.where("text like '%word30%'").count() == 1
    assert cut.where("doc_id = 4").first().n_chars == len(cut.where("doc_id = 4").first().text)
    unchanged(clashing, mixing.sample_mix(clashing))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality long")
    unchanged(clashing, quality.keep_good(clashing, labels))


def test_unused_names(spark):
    assert unused("a", spark.createDataFrame([(1, 2)], "A int, a_ int")) == "a__"


def mixed(spark, sizes):
    rows = [(f"{s}{i}", "one two three four", s, "en", "prose") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, lang string, topic string")
    out = mixing.with_probability(docs, mixing.Mix(temper=(0.5, 1, 1), fraction=0.5))
    return docs, {r.source: r.p for r in out.groupBy("source").agg(F.sum("mix.probability").alias("p")).collect()}


def test_a_rare_value_costs_the_others_nothing(spark):
    _, before = mixed(spark, {"a": 1500, "b": 500})
    docs, after = mixed(spark, {"a": 1500, "b": 500, "rare": 1})
    assert after["rare"] == pytest.approx(1, abs=0.01)
    assert sum(after.values()) == pytest.approx(0.5 * 2001, rel=0.01)
    for s in "ab":
        assert after[s] == pytest.approx(before[s], rel=0.01)
    report = {r.value: r for r in mixing.mixing_report(docs, mixing.Mix(temper=(0.5, 1, 1), fraction=0.5)).where("dimension = 'source'").collect()}
    assert report["rare"].missing == pytest.approx(report["rare"].target * 4 * 2001 * 0.5 - 4, rel=0.02)
    assert report["a"].missing == pytest.approx(0, abs=4)
    assert sum(r.expected for r in report.values()) == pytest.approx(1)


def test_more_than_all_is_all(spark):
    docs, kept = mixed(spark, {"a": 30, "b": 5})
    assert mixing.sample_mix(docs, mixing.Mix(fraction=1.0)).count() == 35
    assert mixing.mixing_report(docs.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    def unit(k, more=0.0):
        v = [0.0] * 16
        v[k], v[(k + 1) % 16] = 1.0, more
        return v

    rows = [(1, unit(0), 0), (2, unit(0, 0.1), 0), (2, unit(5), 0), (3, unit(5, 0.1), 0), (3, unit(5, 0.1), 0), (None, unit(9), 0), (7, unit(9, 0.05), 0), (None, unit(12), 0), (8, None, 0)]
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(2)
        got = embed_dedup.embedding_digest(docs).select("vec_id", "n_links", "component_id", "kept").collect()
        results.add(tuple(sorted(map(tuple, got), key=str)))
    [got] = results
    assert Counter(got) == Counter([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False), (3, 1, 2, False), (None, 1, 7, False), (7, 1, 7, True), (None, 0, None, True), (8, 0, 8, True)])


WORDS = "der die und lorem ipsum sit amet zug weg haus the of and".split()


@pytest.mark.parametrize("seed", range(25))
def test_planted_blocks_come_back(seed):
    """Blocks in a random structure: nothing of an article is lost, whatever its ids say, and nothing named comes with it."""
    rng = random.Random(seed)
    planted = []

    def block(depth):
        kind = rng.randint(0, 5 if depth else 3)
        text = " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 12, 60]))) + f" n{len(planted)}."
        ident = rng.choice(["", ' id="subscription-prices"', ' id="a-cookie-recipe"', ' id="menu-of-the-day"', ' id="notices-1"'])
        if kind == 0:
            planted.append(text)
            return f"<h2{ident}>{text}</h2>"
        if kind == 1:
            planted.append(text)
            return f"<p{ident}>{text}</p>"
        if kind == 2:
            planted.append(text)
            return f"<ul><li{ident}>{text}</li></ul>"
        if kind == 3:
            name = rng.choice(['<aside>', '<nav>', '<div class="comments">', '<div id="comments">', '<div id="newsletter-box">', '<div class="ad">', "<footer>"])
            return f"{name}<p>drop {text}</p></{name[1:].split()[0].strip('>')}>"
        tag = rng.choice(["section", "div"])
        return f"<{tag}{ident if tag == 'section' else ''}>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"

    body = "".join(block(3) for _ in range(8))
    planted.append("The end of the story and of the day.")
    page = f"<body><nav><a href=x>Home</a></nav><article>{body}<p>{planted[-1]}</p></article><div class=sidebar><p>drop</p></div></body>"
    assert html_text.main_text(page) == "\n".join(planted)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div>Привет, это первая фраза этой страницы и она довольно длинная, чтобы быть абзацем.</div><nav>меню</nav>", "Привет, это первая фраза этой страницы и она довольно длинная, чтобы быть абзацем."),
        ("<h1>Steps</h1><ul><li>First do this<li>Then that</ul><footer>f</footer>", "Steps\nFirst do this\nThen that"),
        ("<p>One short paragraph.</p>", "One short paragraph."),
        ("<p><a href=x>Only a link</a></p>", ""),
        ("<article><p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn></math> be.</p></article>", "Let x+1 be."),
    ],
)
def test_pages_without_marks_and_formulas(page, text):
    assert html_text.main_text(page) == text
