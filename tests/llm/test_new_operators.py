"""BPE by prefixes, the source audit and fill-in-the-middle on small fixtures, against the library, SQL and plain Python."""

import hashlib
import itertools
import json
import random
import re
from array import array

import duckdb
import pytest

from waymark.llm import bpe_codec, fim, source_audit

TEXTS = [
    "", "  ", "a" * 5000, "aaaa " * 10, "x́ é", "İstanbul ΣΑΣ ς", "<|endoftext|>a<|startoftext|>", "it's IT'S we'll",
    "中文字\U0001f600 ﬁ", " x y​z", "'S 'tis", "<|endoftext", "1234 ½ ²", "</w> a</w>b", "\x00\x01\x7f", "ſ K å Å",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice("abceinorst<|>/w'é中 \n1A") for _ in range(rng.randint(1, 60)))
        yield "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        yield "".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0x300, 0x3000), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 20)))


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def path(request):
    return pytest.importorskip("public_tokenizers").path(request.param)


def test_ids_and_texts_equal_the_library(path):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(path), bpe_codec.Codec(path)
    texts = TEXTS + list(random_texts(400, 1))
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(text).tolist()
        assert ids == expected.ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def small_model(merges):
    base = "abc"
    ids = {c: i for i, c in enumerate(base)}
    for a, b in merges:
        ids[a + b] = len(ids)
    return {"type": "BPE", "vocab": ids, "merges": [list(m) for m in merges]}


def merged(symbols, merges):
    """Plain BPE: the best pair, leftmost first, until there is none."""
    symbols = list(symbols)
    while True:
        found = [(merges.index(p), i) for i, p in enumerate(itertools.pairwise(symbols)) if p in merges]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_every_prefix_of_every_short_word(seed):
    rng, merges, tokens = random.Random(seed), [], ["a", "b", "c"]
    while len(merges) < 9:
        pair = (rng.choice(tokens), rng.choice(tokens))
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    model = small_model(merges)
    v = bpe_codec.Vocabulary(model)
    name = {i: t for t, i in model["vocab"].items()}
    assert {name[i] for i in v.never} == {t for t in tokens if merged(t, merges) != [t]}
    for word in map("".join, itertools.chain.from_iterable(itertools.product("abc", repeat=n) for n in range(1, 8))):
        last = v.last_tokens(word)
        assert [name[i] for i in v.ids(word)] == merged(word, merges), word
        assert [name[i] for i in last[1:]] == [merged(word[:k], merges)[-1] for k in range(1, len(word) + 1)]


def test_odd_models_are_refused():
    with pytest.raises(ValueError, match="merges"):
        bpe_codec.Vocabulary({"type": "BPE", "vocab": {"a": 0, "aa": 1, "aaa": 2}, "merges": [["aa", "a"], ["a", "a"]]})
    with pytest.raises(ValueError, match="plain"):
        bpe_codec.Vocabulary({"type": "BPE", "vocab": {}, "merges": [], "dropout": 0.1})


def test_codec_over_rows(spark, path):
    codec = bpe_codec.Codec(path)
    rows = [(1, "It's one", "x"), (1, "It's one", "x"), (None, "two", None), (3, None, ""), (4, "", ""), (5, "word " * 40_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe_codec.codec_digest(docs, path).collect()), key=str)
    expected = []
    for doc_id, text, _ in rows:
        ids = codec.tokenizer.encode(text or "", add_special_tokens=False).ids
        told = codec.tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    encoded = bpe_codec.encode(docs, path)
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encoded.collect()) == sorted((e[0] or 0, e[1]) for e in expected)
    assert {r.text for r in bpe_codec.decode(encoded.where("doc_id is null"), path).collect()} == {codec.decode(codec.encode("two"))}
    assert bpe_codec.codec_digest(docs.limit(0), path).count() == 0


def brute_fim(doc_id, text, settings):
    units = re.findall(fim.UNIT, text)
    n = len(units)
    told = hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= settings.rate:
        return "plain", text, n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < settings.spm:
        return "spm", f"<S>{s}<P>{p}<M>{m}", n, len(p), len(m)
    return "psm", f"<P>{p}<S>{s}<M>{m}", n, len(p), len(m)


def test_fim_equals_plain_python():
    rng = random.Random(3)
    for settings in (fim.Settings(), fim.Settings(rate=100), fim.Settings(rate=100, spm=0)):
        for i in range(1500):
            text = "".join(rng.choice("ab \n\té<P>SM  ") for _ in range(rng.choice([0, 1, 3, 9, 30, 3000 if i % 50 == 0 else 5])))
            done = fim.transform(i, text, settings)
            output = fim.flat(done.out)
            assert (done.form, output, done.n, done.prefix_chars, done.middle_chars) == brute_fim(i, text, settings)
            assert fim.restore(output, done.form) == text


def test_splits_walk_one_path():
    text = "".join(f"w{i} " for i in range(100_000))
    whole = fim.rope(text)
    assert whole.units == len(re.findall(fim.UNIT, text))
    assert whole.chars == len(text)
    assert whole.depth <= 10
    for rank in (0, 1, 255, 256, 257, 50_000, whole.units):
        left, right = fim.split(whole, units=rank)
        assert fim.flat(left) == "".join(re.findall(fim.UNIT, text)[:rank])
        assert fim.flat(left) + fim.flat(right) == text
        assert left.units == rank
    old = {id(leaf) for leaf in whole.leaves()}
    left, right = fim.split(whole, units=70_001)
    assert sum(id(leaf) not in old for side in (left, right) for leaf in side.leaves()) == 2


def test_fim_over_rows(spark):
    rows = [(i, t, "f") for i, t in enumerate(["", None, "one two  three\n", "a <P> b", "x y " * 30_000, "  "])] + [(None, "a b c", None)] + [(i, "the same text", "f") for i in (20, 20, 21, 22, 23, 24, 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    filled = fim.fill_in_middle(docs)
    expected = [(d, *brute_fim(d, t or "", fim.Settings())) for d, t, _ in rows]
    assert sorted([(r.doc_id, r.form, r.output, r.n, r.prefix_chars, r.middle_chars) for r in filled.collect()], key=str) == sorted(expected, key=str)
    assert sorted([tuple(r) for r in fim.restore_texts(filled).collect()], key=str) == sorted([(d, t or "") for d, t, _ in rows], key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digest = [(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.fim_digest(docs).collect()]
    assert sorted(digest, key=str) == sorted([(e[0], sha(e[2]), sha(t or "")) for e, (_, t, _) in zip(expected, rows, strict=True)], key=str)
    assert fim.fim_digest(docs.limit(0)).count() == 0
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    sql = db.execute(fim.fim_sql()).fetchall()
    assert sorted([(s[0], s[1], s[4], s[5], s[6]) for s in sql], key=str) == sorted([(e[0], e[3], e[1], sha(e[2]), sha(t or "")) for e, (_, t, _) in zip(expected, rows, strict=True)], key=str)


def brute_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall("[A-Za-z\x80-\U0010ffff]+", text or "")) for text, lang, source in rows]
    docs = [(la, s, ["".join(c.lower() if c.isascii() else c for c in w) for w in words]) for la, s, words in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        found = {}
        for _, _, words in mine:
            for w in set(words):
                found[w] = found.get(w, 0) + 1
        kept = [w for w, n in found.items() if n >= min_docs]

        def shares(of, kept=kept):
            count = {w: sum(words.count(w) for words in of) for w in kept}
            total = sum(count.values())
            return count, {w: 1 + 10**9 * (n + 2) // (total + 2 * len(kept)) for w, n in count.items()}

        groups = {s: shares([d[2] for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        whole = shares([d[2] for d in mine])[1]
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, (count, p) in groups.items():
            pairs = sorted(((sum(f(p[w], q[w]) for w in kept), o) for o, (_, q) in groups.items() if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[w], whole[w]), w) for w in kept if count[w] and p[w] > whole[w]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, value, i) for part, ranked in (("pair", pairs), ("term", terms)) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "THE", "of", "Été", "été", "naïve", "x1y", "\U0001f600", "z z", "a-b", "的"]
    for _ in range(n):
        source = rng.choice(["s", "s", "s", "t", "u", None, "", "ü"])
        yield " ".join(rng.choice(words[: 6 if source == "s" else 12]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None, "xx"]), source
    yield from [(None, "en", "empty"), ("", "none", "a"), ("1 2 3", "none", "b"), ("lone word here", "one", "only"), ("the " * 20_000, "en", "s")]


@pytest.mark.parametrize(("min_docs", "top"), [(10, 10), (1, 2), (3, 10)])
def test_audit_equals_plain_python_and_sql(spark, min_docs, top):
    rows = list(audit_rows(min_docs, 120))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, rank int")
    expected = brute_audit(rows, min_docs, top)
    got = source_audit.audit_sources(docs, min_docs, top)
    assert dict(got.dtypes)["value"] == "bigint"
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == expected
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(db.execute(source_audit.audit_sql(min_docs, top)).fetchall()) == expected


def test_audit_of_nothing_and_of_large_counts(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert source_audit.audit_sources(empty).count() == 0
    n = 50_000_000_000
    row = spark.range(1).select(source_audit.share(*[source_audit.F.lit(x).cast("bigint") for x in (n, 3 * n + 7, 5)]).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (3 * n + 7 + 10)


def test_odd_tokenizer_files_are_refused(tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    with open(path) as f:
        told = json.load(f)
    told["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="added tokens"):
        bpe_codec.Codec(str(tmp_path / "t.json"))
