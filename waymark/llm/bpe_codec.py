"""BPE encoding by dynamic programming over prefixes, and decoding.

The ids of a prefix of a word are those of a shorter prefix and one more token, so one token for each prefix, its last one,
holds the encodings of all of them. The last token of a prefix is the only token that

* ends there: an automaton over the vocabulary, whose states are the beginnings of tokens with links to their longest
  suffixes, lists the tokens that end at each position, longest first, and
* is compatible with the last token of the prefix before it: merging the two tokens' symbols gives the two tokens again.

Two tokens are compatible if no merge crosses their border: the right edge of the one and the left edge of the other are
the symbols that merging shows there in turn, each until its parent's rank, and a pair of them whose rank comes before both
would be merged (of equal ranks the pair further left goes first). Adjacent compatible tokens make up an encoding, whatever
its length, so following last tokens back from a word's end emits the exact ids, in time linear in the word. Words are cut and
normalised as the tokenizer file says; a worker remembers the ids of the words met so far (MEMO_PARTS), and forgetting costs time only.

Null and empty texts have no ids, and decode to ''. Each row stands for itself, so null, tied and repeated doc_ids are
carried as they are; an empty table gives an empty table; other columns are ignored; texts are encoded whole, in pieces of
CHUNK parts, so that beside a very long text no list of all its ids is held by the digest.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import text_cut

#: Parts of texts whose ids a worker remembers, and the longest one it remembers.
MEMO_PARTS, MEMO_CHARS = 400_000, 64
#: Pairs of tokens whose compatibility a worker remembers.
MEMO_PAIRS = 1_000_000
CHUNK = 1 << 15
#: Fixed: how byte-level tokenizers write bytes that aren't printable Latin-1, as characters from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPELL = [BYTE_CHARS[b] for b in range(256)]
#: Added to the character of a word's last byte, where a vocabulary marks the ends of words.
LAST = 0x1000


class Vocabulary:
    """Tokens as strings of symbols, the merges that make them, and the automaton of their ends."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models are known")
        ids, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in merges}
        self.rank = {pair: rank for rank, pair in enumerate((ids[a], ids[b]) for a, b in merges)}
        own = {token: self.rank[pair] for token, pair in self.parts.items()}
        if len(own) != len(merges) or any(own.get(side, -1) >= r for r, pair in enumerate(self.rank) for side in pair):
            raise ValueError("merges have to make each token once, after its parts")
        self.symbols: dict[int, str] = {i: self._base(t) for t, i in ids.items() if i not in self.parts}
        for token, (a, b) in self.parts.items():  # in the order of ranks, parts before wholes
            self.symbols[token] = self.symbols[a] + self.symbols[b]
        self._fits: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = {}, {}
        #: Tokens that merging their own symbols doesn't give; encodings never have them.
        self.never: set[int] = set()
        for token, (a, b) in self.parts.items():
            if a in self.never or b in self.never or not self.fits(a, b, but=(a, b)):
                self.never.add(token)
        self._build()

    def _base(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token.removesuffix(self.suffix)
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def _build(self) -> None:
        """`step` from state and symbol to state, `link` to a state's longest suffix, `ends`: tokens that end at a state."""
        step: dict[int, int] = {}
        own: list[int | None] = [None]
        for token, symbols in self.symbols.items():
            if token in self.never:
                continue
            state = 0
            for c in map(ord, symbols):
                state = step.setdefault(state << 16 | c, len(own))
                if state == len(own):
                    own.append(None)
            own[state] = token
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in step.items():
            below.setdefault(key >> 16, []).append((key & 0xFFFF, to))
        link, ends = [0] * len(own), [()] * len(own)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            if own[state] is not None:
                ends[state] = ((own[state], len(self.symbols[own[state]])), *ends[link[state]])
            else:
                ends[state] = ends[link[state]]
            for c, to in below.get(state, ()):
                back = link[state]
                while back and back << 16 | c not in step:
                    back = link[back]
                link[to] = step.get(back << 16 | c, 0) if state else 0
                queue.append(to)
        self.step, self.link, self.ends = step, link, ends

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Symbols at the left (0) or right (1) edge of a token in its making, each with the rank that ends it."""
        known = self._edges[side]
        if token not in known:
            at, until, out = token, float("inf"), []
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until = self.rank[self.parts[at]]
                at = self.parts[at][side]
            known[token] = out
        return known[token]

    def fits(self, first: int, second: int, but: tuple[int, int] | None = None) -> bool:
        """Whether merging what both spell gives the two tokens again, the pair `but` left unmerged."""
        rank = self.rank
        right = self._edge(second, 0)
        for x, x_until in self._edge(first, 1):
            for y, y_until in right:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until and (x, y) != but:
                    return False
        return True

    def last_tokens(self, symbols: str) -> list[int]:
        """The last token of the encoding of each prefix, the empty one (-1) first."""
        step, link, ends, fits = self.step, self.link, self.ends, self._fits
        last, state = [-1], 0
        for at, c in enumerate(map(ord, symbols), 1):
            to = step.get(state << 16 | c)
            while to is None and state:
                state = link[state]
                to = step.get(state << 16 | c)
            state = to or 0
            for token, size in ends[state]:
                before = last[at - size]
                if before < 0:
                    break
                pair = before << 32 | token
                good = fits.get(pair)
                if good is None:
                    if len(fits) > MEMO_PAIRS:
                        fits.clear()
                    good = fits[pair] = self.fits(before, token)
                if good:
                    break
            else:
                raise ValueError(f"the vocabulary has no token for {symbols[at - 1]!r}")
            last.append(token)
        return last

    def ids(self, symbols: str) -> list[int]:
        """Ids of a word, by following last tokens back."""
        last, at, out = self.last_tokens(symbols), len(symbols), []
        while at:
            out.append(last[at])
            at -= len(self.symbols[last[at]])
        out.reverse()
        return out


class Codec:
    """A tokenizer file: cuts texts into words as the file says, encodes words by Vocabulary, decodes ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.vocabulary = Vocabulary(told["model"])
        self.cut = text_cut(told)
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("added tokens have to stand for exactly their text")
        by_length = sorted(self.added, key=len, reverse=True)
        self.around_added = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self.bytewise = (told["decoder"] or {}).get("type") == "ByteLevel"
        if told["decoder"] and not self.bytewise:
            raise ValueError("this decoder isn't known")
        self.tokens: list[str] = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.bytes_of = [t.encode() if t in self.added else bytes(map({c: b for b, c in BYTE_CHARS.items()}.__getitem__, t)) for t in self.tokens] if self.bytewise else []
        self.memo: dict[str, bytes] = {}

    def _word(self, spelled: str) -> list[int]:
        """Ids of a word in byte characters."""
        if self.vocabulary.suffix:
            spelled = spelled[:-1] + chr(ord(spelled[-1]) + LAST)
        return self.vocabulary.ids(spelled)

    def _part(self, part: str) -> bytes:
        """Ids of a part that stands for itself, as little-endian unsigned 32-bit integers."""
        if self.cut and part.isascii() and part.isalpha():
            return array("I", self._word(part.lower())).tobytes()
        out: list[int] = []
        for k, piece in enumerate(self.around_added.split(part) if self.around_added else [part]):
            if k % 2:
                out.append(self.added[piece])
            elif piece:
                normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
                plain = normalizer.normalize_str(piece) if normalizer else piece
                for word, _ in cutter.pre_tokenize_str(plain):
                    out += self._word(word)
        return array("I", out).tobytes()

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text, CHUNK parts at a time."""
        if self.cut is None:
            yield self._part(text)
            return
        unclear, clear, mixed = self.cut
        found = (m.group() for m in mixed.finditer(text)) if unclear.search(text) else map(re.Match.group, clear.finditer(text))
        memo = self.memo
        while parts := list(islice(found, CHUNK)):
            for part in set(parts).difference(memo):
                memo[part] = self._part(part)
            yield b"".join(map(memo.__getitem__, parts))
            if len(memo) > MEMO_PARTS:
                memo.clear()
            elif max(map(len, parts)) > MEMO_CHARS:
                for part in {p for p in parts if len(p) > MEMO_CHARS}:
                    del memo[part]

    def encode(self, text: str) -> array:
        return array("I", b"".join(self.pieces(text)))

    def decode_pieces(self, pieces: Iterator[bytes]) -> Iterator[bytes]:
        """UTF-8 of the decoded text, from ids in pieces."""
        if self.bytewise:
            raw = b"".join(self.bytes_of[i] for p in pieces for i in array("I", p))
            yield raw.decode(errors="replace").encode()
            return
        first, tokens = True, self.tokens
        for p in pieces:
            if p:
                yield ("" if first else " ").encode() + " ".join([tokens[i] for i in array("I", p)]).encode()
                first = False

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.decode_pieces(iter([array("I", ids).tobytes()]))).decode()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text they decode to."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()

        def seen() -> Iterator[bytes]:
            nonlocal n
            for p in self.pieces(text):
                n += len(p) // 4
                ids.update(p)
                yield p

        for d in self.decode_pieces(seen()):
            decoded.update(d)
        return n, ids.hexdigest(), decoded.hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list]]:
    """doc_id and the other column, few rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).to_pylist()


def _keyed(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), column)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int> of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, texts in _rows(batches):
            ids = [codec(tokenizer_path).encode(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _keyed(docs, "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of every row of encoded (doc_id, ids), special tokens included; null ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in _rows(batches):
            yield pa.RecordBatch.from_arrays([doc_id, pa.array([codec(tokenizer_path).decode(i or []) for i in ids], pa.string())], names=["doc_id", "text"])

    return _keyed(encoded, "ids").mapInArrow(run, "doc_id bigint, text string")


def codec_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs, encoded and decoded again in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for doc_id, texts in _rows(batches):
            n, ids, decoded = zip(*[codec(tokenizer_path).digest(t or "") for t in texts], strict=True)
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=names)

    return _keyed(docs, "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


__all__ = ["Codec", "Vocabulary", "codec_digest", "decode", "encode"]
