"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import ngram_join, repeats, suffix_dedup, token_ids, window_dedup
from waymark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(200), text(70)
    docs = [base, base, base.upper(), base.replace(" w1 ", " x "), text(30), "", None, "one", "one", "One two", " \t\n", text(3000), text(90) + " " + passage, passage + "\n" + text(40), "a b " * 200, "é" * 300 + base[:100], "é" * 300]
    for _ in range(12):
        w = base.split()
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = "edit"
        docs.append(" ".join(w))
    return [(i * 3, d) for i, d in enumerate(docs)]


DOCS = corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 7) for i, t in rows], "doc_id long, text string, node string, pos long").repartition(3)


def sets(rows, n):
    out = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def joined(rows, n, s):
    shingles, parent = sets(rows, n), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in shingles:
        for b in shingles:
            if a < b and shingles[a] and s.denominator * len(shingles[a] & shingles[b]) >= s.numerator * len(shingles[a] | shingles[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(shingles[i]), root(i)) for i, _ in rows}


@pytest.mark.parametrize(("n", "s"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_jaccard_components(spark, n, s):
    got = {tuple(r) for r in ngram_join.jaccard_components(frame(spark, DOCS), n, s).collect()}
    assert got == joined(DOCS, n, s)


def test_jaccard_recursion(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.metric_join, "__defaults__", (3, 2))
    got = {tuple(r) for r in ngram_join.jaccard_components(frame(spark, DOCS), 3, Fraction(4, 5)).collect()}
    assert got == joined(DOCS, 3, Fraction(4, 5))


def test_regions_of_one_task(monkeypatch):
    r = random.Random(5)
    base = [[r.randrange(10**9) for _ in range(60)] for _ in range(4)]
    drawn = [np.unique([v if r.random() > 0.06 else r.randrange(10**9) for v in r.choice(base)]) for _ in range(300)]
    links = {frozenset(x) for x in ngram_join.region_links(drawn, Fraction(4, 5))}
    full = ngram_join.similar(drawn, drawn, Fraction(4, 5))[1]
    assert all(full[min(x), max(x)] for x in links if len(x) == 2)

    def groups(pairs):
        root = list(range(len(drawn)))
        for _ in drawn:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert groups([tuple(x) for x in links if len(x) == 2]) == groups(list(zip(*np.nonzero(full), strict=True)))


@pytest.mark.parametrize("large", [64, 2])
def test_large_cells(spark, monkeypatch, large):
    monkeypatch.setattr(ngram_join, "LARGE_CELL", large)
    monkeypatch.setattr(ngram_join.Cells, "of", classmethod(lambda cls, s: cls(1, 40, 0)))  # cells that mix unlike sets
    r = random.Random(9)
    common, rows = " ".join(f"c{i}" for i in range(60)), []
    for i in range(40):
        rows.append((i, common + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 90)))))
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 40, 3)]
    got = {tuple(x) for x in ngram_join.jaccard_components(frame(spark, rows), 3, Fraction(9, 10)).collect()}
    assert got == joined(rows, 3, Fraction(9, 10))


def test_ids_that_clash(spark):
    rows = [(1, DOCS[0][1]), (2, "other words " * 9), (2, DOCS[0][1] + " tail"), (3, None)]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows), 3, Fraction(9, 10)).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 3)]


def test_repeats_in_rows_that_share_an_id(spark):
    r = random.Random(2)
    p = " ".join(f"p{r.randrange(10**6)}" for _ in range(120))
    other = " ".join(f"o{r.randrange(10**6)}" for _ in range(110))
    rows = [(1, p), (2, other), (2, p + " tail"), (2, p + " tail"), (3, other + " end")]
    size = len(p.encode())
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffix_dedup.suffix_digest(frame(spark, rows)).collect())
    n = len(other.encode())
    assert got == sorted([(1, size, size), (2, n, n), (2, size + 5, size + 5), (2, size + 5, size + 5), (3, n + 4, n)])
    got = sorted((x["doc_id"], x["n_words"], x["n_removed"]) for x in window_dedup.window_digest(frame(spark, rows)).collect())
    assert got == sorted([(1, 120, 0), (2, 110, 0), (2, 121, 120), (2, 121, 120), (3, 111, 110)])


def test_empty_tables(spark):
    empty = frame(spark, DOCS).limit(0)
    assert ngram_join.jaccard_components(empty).count() == 0
    assert window_dedup.window_digest(empty).count() == 0
    assert suffix_dedup.suffix_digest(empty).count() == 0


@pytest.mark.parametrize("in_one_task", [500_000, 0])
def test_components(spark, monkeypatch, in_one_task):
    monkeypatch.setattr("waymark.llm.components.LINKS_PER_TASK", in_one_task)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "x long, y long")
    got = dict(tuple(r) for r in components(links).collect())
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def test_window_dedup(spark):
    first = {}
    for i, t in DOCS:
        w = WORD.findall(t or "")
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    expected = set()
    for i, t in DOCS:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        expected.add((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert any(e[2] for e in expected)
    assert {tuple(r) for r in window_dedup.window_digest(frame(spark, DOCS)).collect()} == expected


def test_common_passage_is_a_row_for_each_slice():
    """A passage of all texts of a slice makes as many rows of runs as one text's, with all places."""
    r = random.Random(5)
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(300))
    rows = lambda texts: pa.Table.from_batches(
        repeats._run_rows(repeats.WORDS_50)(iter([pa.record_batch([pa.array(texts), pa.array(range(7, 7 + len(texts))), pa.array(range(len(texts)))], names=["text", "row", "order"])]))
    ).to_pylist()
    one, many = rows([passage]), rows([passage] * 200 + ["short", None])
    assert len(many) == len(one) > 5 and {x["slice"] for x in many} == {7}
    assert all(sorted((p["order"], p["row"]) for p in x["places"]) == [(i, i + 7) for i in range(200)] for x in many)


def test_common_passage_through_many_slices(spark):
    r = random.Random(6)
    words = lambda n: " ".join(f"p{r.randrange(10**6)}" for _ in range(n))
    passage = words(130)
    docs = [(i, f"{words(r.randrange(60))} {passage} {words(r.randrange(60))}".strip()) for i in range(60)]
    docs += docs[40:45]  # equal rows, in other slices
    got = sorted((x["doc_id"], x["n_words"], x["n_removed"]) for x in window_dedup.window_digest(frame(spark, docs).repartition(7)).collect())
    assert got == sorted((i, len(t.split()), 130 if i else 0) for i, t in docs)
    size = len(passage.encode())
    got = sorted((x["doc_id"], x["n_removed"] >= size, x["n_spans"]) for x in suffix_dedup.suffix_digest(frame(spark, docs).repartition(7)).collect())
    assert got == sorted((i, True, 1) for i, t in docs)


def test_dedup_windows_keeps_rows_and_columns(spark):
    df = frame(spark, DOCS)
    out = window_dedup.dedup_windows(df)
    assert out.columns == df.columns and out.count() == df.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] == DOCS[0][1] and texts[3] == "" and texts[18] is None


def test_suffix_dedup(spark):
    raw = {i: (t or "").encode() for i, t in DOCS}
    seen = collections.Counter(b[j : j + 200] for b in raw.values() for j in range(len(b) - 199))
    expected = set()
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected.add((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert any(e[3] > 1 for e in expected)
    assert {tuple(r) for r in suffix_dedup.suffix_digest(frame(spark, DOCS)).collect()} == expected


def test_null_ids_and_repeated_rows(spark):
    rows = frame(spark, [(None, DOCS[0][1]), (1, DOCS[0][1]), (1, DOCS[0][1]), (2, None)])
    got = sorted((r["doc_id"] or 0, r["n_removed"] > 0) for r in suffix_dedup.suffix_digest(rows).collect())
    assert got == [(0, False), (1, True), (1, True), (2, False)]
    assert window_dedup.window_digest(rows).count() == 4
    assert ngram_join.jaccard_components(rows).count() == 4


@pytest.mark.parametrize("values", [[], [0], [5, 5, 9], list(range(0, 5000, 7)), sorted(random.Random(3).sample(range(10**7), 900))])
def test_elias_fano(values):
    ef = token_ids.EliasFano.of(np.array(values, np.int64))
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 37)] == values[::37]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_token_ids(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = DOCS + [(1000, "Straße x <|endoftext|> don't\x1cé́ 123"), (999, "1 \x0b2")]
    out = str(tmp_path / "ids")
    token_ids.write_token_ids(frame(spark, rows), out, path, 2)
    t, start, expected = tokenizers.Tokenizer.from_file(path), 0, []
    for i, text in sorted(rows):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_ids.read_token_ids(spark, out).collect())) == expected
    assert [len(r["ids"]) for r in token_ids.read_document(spark, out, 900).collect()] == [e[2] for e in expected if e[0] == 900]
    token_ids.write_token_ids(frame(spark, rows).limit(0), str(tmp_path / "none"), path, 2)
    assert token_ids.read_token_ids(spark, str(tmp_path / "none")).count() == 0
    assert {r["doc_id"]: len(r["ids"]) for r in token_ids.read_documents(spark, out).collect()} == {e[0]: e[2] for e in expected}
