"""SentencePiece encoding and decoding, with sampled segmentations by Gumbel top-k without replacement.

Encoding is the library's. Pieces hold spaces only in front, and none joins a letter of the alphabet that most pieces are made
of with another character. So a text's encoding is that of its words, cut before spaces and where that alphabet begins or ends,
each encoded once for a worker. Decoding joins the pieces' bytes.

Sampling. The lattice of a text is that of its words, end to end, with every vocabulary piece that spells a part of a
word as an edge (no piece crosses words); a character that no piece spells alone has an edge of its byte pieces. A
segmentation's log-probability is the sum over its pieces of ALPHA * score - BETA, normalised: backward log-sums make each
edge's share of what follows from its node. Perturbing every path with Gumbel noise, the k greatest are a sample without
replacement. They are found by A* search from the top: the root's perturbed maximum is a Gumbel draw; following it down fixes
one path, and what each step leaves out is a subtree whose maximum is a Gumbel variable truncated at the path's, drawn
when it is met. The next best subtree is opened until k + 1 paths are out; the last one is the threshold that gives the
others their inclusion scores 1 - exp(-exp(log p - threshold)) (1 where a lattice holds no more paths). Words are
walked side by side, those of all texts of a slice at once.
All draws are hashes of the row's key, so results don't depend on partitions, batches or retries.

Null and empty texts have no pieces and one empty sample; null keys draw as key 0; repeated rows are sampled alike; texts are
taken whole; columns with other names are ignored. A lattice with fewer paths than k yields all of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

ALPHA, BETA = 1e-4, 1.5
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"
#: Edges of lattices that a worker keeps; words met later are forgotten after their slice.
MEMO_EDGES = 5_000_000
#: Bytes of text whose lattices are walked at a time.
WALK_BYTES = 1 << 18
U64 = np.uint64


class Pieces:
    """One model, kept by a worker: the encoder's memory, the pieces' bytes, and the words' lattices."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(n)]
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [
            b"" if self.model.is_control(i) else bytes([int(names[i][3:5], 16)]) if self.model.is_byte(i) else " \N{DOUBLE QUESTION MARK} ".encode() if self.model.is_unknown(i) else names[i].replace(SPACE, " ").encode()
            for i in range(n)
        ]
        self.size = np.array([len(b) for b in self.bytes])
        self.begin = np.cumsum(self.size) - self.size
        self.spelling = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.names = names
        self.plain = {names[i]: i for i in range(n) if not special[i] and not self.model.is_byte(i)}
        self.logit = np.array([self.model.get_score(i) * ALPHA - BETA for i in range(n)])
        self.byte_of = {int(names[i][3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.letters: dict[str, list[int]] = {}
        alphabet = self._alphabet()
        self._kind = np.full(0x110000, 2, np.uint8)
        self._kind[[ord(c) for c in alphabet]] = 1
        self._kind[ord(" ")] = 0
        #: What a word without a space is encoded behind: a character of the other kind.
        self._guards = (alphabet[0], next(chr(c) for c in itertools.count(33) if chr(c) not in alphabet)) if alphabet else ("", "")
        self._alphabet_of = frozenset(alphabet)
        self._lattice: Lattice | None = None

    @property
    def lattice(self) -> Lattice:
        """Made when first asked for: decoding has no use for it."""
        if self._lattice is None:
            self._lattice = Lattice(self)
        return self._lattice

    def _alphabet(self) -> str:
        """The characters of the largest part of the vocabulary whose pieces share no character, behind spaces, with the others.

        Empty, so that words are cut only before spaces, for models that change texts or merge unknown characters.
        """
        probe = "e\u0301 \N{LATIN SMALL LIGATURE FI} \N{FULLWIDTH LATIN SMALL LETTER A}"
        if not self.byte_of or self.model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            return ""
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        bodies = [p.lstrip(SPACE) for p in self.plain]
        for body in bodies:
            for c in body[1:]:
                root[find(c)] = find(body[0])
        parts = Counter(find(body[0]) for body in bodies if len(body) > 1)
        most = max(parts, key=parts.get, default=None)
        return "".join(sorted(c for c in root if find(c) == most and c != SPACE))

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Texts end to end, a space before each that isn't empty, and cut into words, spaces in front, which no piece crosses.

        All of it, its letters, the bounds of its words, and the n + 1 bounds of the texts' words.
        """
        whole = "".join(" " + t for t in texts if t).replace(SPACE, " ")
        letters = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([0] + [len(t) + 1 if t else 0 for t in texts])
        kind, begins = self._kind[letters], np.zeros(len(letters) + 1, bool)
        begins[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        begins[ends] = True
        bounds = np.flatnonzero(begins)
        return whole, letters, bounds, np.searchsorted(bounds, ends)

    def chunks(self, text: str) -> list[str]:
        """The words of a text."""
        whole, _, bounds, _ = self.cut([text])
        return [whole[a:b] for a, b in itertools.pairwise(bounds.tolist())]

    def fallback(self, letter: str) -> list[int]:
        """The pieces of a character that isn't a piece."""
        if letter not in self.letters:
            unknown = self.model.unk_id()
            self.letters[letter] = [self.byte_of.get(b, unknown) for b in letter.encode()] if self.byte_of else [unknown]
        return self.letters[letter]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole, letters, bounds, words = self.cut(texts)
        ids, ends = self.lattice.encodings(self.lattice.records(whole, letters, bounds), words)
        return [ids[a:b] for a, b in itertools.pairwise(ends.tolist())]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The library's encoding of words; it puts a space before each text."""
        guards = ["" if w[0] == " " else self._guards[w[0] in self._alphabet_of] for w in words]
        before = {g: len(self.model.encode(g)) for g in self._guards}
        encoded = self.model.encode([g + w if g else w[1:] for w, g in zip(words, guards, strict=True)], num_threads=1)
        return [ids[before[g] :] if g else ids if w != " " else [self.plain[SPACE]] for w, g, ids in zip(words, guards, encoded, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts that runs of ids spell."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        spelled = self.spelling[np.repeat(self.begin[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[bounds].tolist()
        texts = [spelled[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [t[1:] if t[:1] == " " else t for t in texts]


class Table:
    """Numbers by keys that are not negative: a hash table with linear probing."""

    def __init__(self):
        self.n, self.keys, self.numbers = 0, np.full(1, -1, np.int64), np.zeros(1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (tn.mix(keys.view(U64)) & U64(len(self.keys) - 1)).view(np.int64)

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Different keys that are not yet there."""
        self.n += len(keys)
        if 4 * self.n > len(self.keys):
            have = self.keys >= 0
            keys, numbers = np.concatenate([self.keys[have], keys]), np.concatenate([self.numbers[have], numbers])
            slots = 1 << (8 * self.n).bit_length()
            self.keys, self.numbers = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            slot, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slot], self.numbers[slot] = keys[placed], numbers[placed]
            left = np.setdiff1d(left, placed)
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for those that are not there."""
        at = self._slot(keys)
        have = self.keys[at]
        lost = np.flatnonzero((have != keys) & (have >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & (len(self.keys) - 1)
            have[lost] = self.keys[at[lost]]
            lost = lost[(have[lost] != keys[lost]) & (have[lost] >= 0)]
        return np.where(have == keys, self.numbers[at], -1).astype(np.int64)


class Lattice:
    """Nodes and edges of all words met: a word has a node for each of its characters, a node's longest edges stand first.

    A word's record has its first node, its length, and where its encoding stands among those of all words.
    """

    RECORD = {"base": np.int64, "length": np.int64, "begin": np.int64, "count": np.int64}
    KINDS = {"piece": np.int32, "span": np.int16, "logp": float, "share": float, "rest": float}
    #: Characters of words whose lattices are made at a time; a longer word is taken whole.
    PART = 1 << 14

    def __init__(self, model: Pieces):
        self.model = model
        state = {p: i for i, p in enumerate(sorted({n[:i] for n in model.plain for i in range(len(n) + 1)}))}
        moves = [(state[p[:-1]] << 21 | ord(p[-1]), i) for p, i in state.items() if p]
        self.moves = Table()
        self.moves.put(*(np.array(column, np.int64) for column in zip(*moves, strict=True)))
        self.state_piece = np.full(len(state), -1, np.int32)
        self.state_piece[[state[p] for p in model.plain]] = list(model.plain.values())
        self.number = Table()
        self.words = self.ids_of = self.nodes = self.edges = 0
        self.kept: tuple[int, int, int, int] | None = None
        self.first, self.ids, self.letter = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.base, self.length, self.begin, self.count = (np.zeros(0, kind) for kind in self.RECORD.values())
        self.piece, self.span, self.logp, self.share, self.rest = (np.zeros(0, kind) for kind in self.KINDS.values())

    def trim(self) -> None:
        """Between slices: forget the words met since MEMO_EDGES was reached."""
        if self.kept:
            self.words, self.ids_of, self.nodes, self.edges = self.kept
        elif self.edges > MEMO_EDGES:
            self.kept = self.words, self.ids_of, self.nodes, self.edges

    def records(self, whole: str, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The records of the words between bounds; new ones are added. Words are found by a hash and compared letter by letter."""
        size = np.diff(bounds)
        key = (tn.span_hash(tn.prefix_hash(letters.astype(U64)), bounds[:-1], bounds[1:]) >> U64(1)).view(np.int64)
        at = self.number.find(key)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            new, first, own = np.unique(key[lost], return_index=True, return_inverse=True)
            at[lost] = self.words + own
            if not self.kept:
                self.number.put(new, self.words + np.arange(len(new)))
            self._learn(whole, bounds, lost[first])
        self._relearn(whole, bounds, at, np.flatnonzero(self.length[at] != size))
        place = np.flatnonzero(self.letter[np.repeat(self.base[at] - bounds[:-1], size) + np.arange(len(letters))] != letters)
        self._relearn(whole, bounds, at, np.unique(np.searchsorted(bounds, place, "right") - 1))
        return at

    def _relearn(self, whole: str, bounds: np.ndarray, at: np.ndarray, others: np.ndarray) -> None:
        """Words that share their hash with another one have records of their own, each time."""
        if len(others):
            at[others] = self.words + np.arange(len(others))
            self._learn(whole, bounds, others)

    def _learn(self, whole: str, bounds: np.ndarray, words: np.ndarray) -> None:
        """Add records of words."""
        new = [whole[a:b] for a, b in zip(bounds[words].tolist(), bounds[words + 1].tolist(), strict=True)]
        spelled = self.model.encode_words(new)
        count, length = (np.fromiter(map(len, x), np.int64, len(new)) for x in (spelled, new))
        order = np.argsort(length, kind="stable")
        ends, base = np.cumsum(length[order]), np.empty(len(new), np.int64)
        base[order] = self.nodes + ends - length[order]
        for name, values in zip(self.RECORD, (base, length, self.ids_of + np.cumsum(count) - count, count), strict=True):
            self._put(name, self.words, values)
        self._put("ids", self.ids_of, np.fromiter(itertools.chain.from_iterable(spelled), np.int32, int(count.sum())))
        self.words, self.ids_of = self.words + len(new), self.ids_of + int(count.sum())
        new = [new[i] for i in order.tolist()]
        begin = 0
        for end in [*(np.flatnonzero(np.diff(ends // self.PART)) + 1).tolist(), len(new)]:
            self._add(new[begin:end])
            begin = end

    def encodings(self, records: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The encodings, one after the other, of texts whose words are the records between bounds, and the n + 1 bounds of theirs."""
        n = self.count[records]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(self.begin[records] - ends[:-1], n) + np.arange(ends[-1])], ends[bounds]

    def _put(self, name: str, have: int, values: np.ndarray) -> None:
        column = getattr(self, name)
        if have + len(values) > len(column):
            grown = np.zeros(2 * have + len(values), column.dtype)  # pages not yet written take no memory
            grown[:have] = column[:have]
            column = grown
            setattr(self, name, column)
        column[have : have + len(values)] = values

    def _pieces_at(self, letters: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All edges, by place and the longest first: place, span, piece (-1 - letter for several byte pieces), logit."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at, state, length = np.arange(len(letters)), np.zeros(len(letters), np.int64), 0
        while len(at):
            state = self.moves.find(state << 21 | letters[at + length])
            on = state >= 0
            state = state[on]
            at, length = at[on], length + 1
            piece = self.state_piece[state]
            whole = piece >= 0
            found.append((at[whole], piece[whole]))
            on = left[at] > length
            at, state = at[on], state[on]
        lone = np.ones(len(letters), bool)
        lone[found[0][0]] = False
        alone = np.flatnonzero(lone)
        kinds, kind = np.unique(letters[alone], return_inverse=True)
        spelled = [self.model.fallback(chr(c)) for c in kinds]
        found.append((alone, np.array([w[0] if len(w) == 1 else -1 - c for c, w in zip(kinds.tolist(), spelled, strict=True)], np.int32)[kind]))
        logits = [self.model.logit[p] for _, p in found[:-1]] + [np.array([self.model.logit[w].sum() for w in spelled])[kind]]
        node = np.concatenate([w for w, _ in found[::-1]])
        span = np.repeat([1, *range(len(found) - 1, 0, -1)], [len(w) for w, _ in found[::-1]])
        order = np.argsort(node.astype(np.min_scalar_type(len(letters))), kind="stable")  # sorted by digits if 16 bits hold it
        piece, logit = (np.concatenate(x)[order] for x in ([p for _, p in found[::-1]], logits[::-1]))
        return node[order], span[order], piece, logit

    def _add(self, words: list[str]) -> None:
        size = np.array([len(w) for w in words])
        starts = np.cumsum(size) - size
        letters = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        left = np.repeat(starts + size, size) - np.arange(len(letters))
        node, span, piece, logit = self._pieces_at(letters, left)
        away = left[node]
        order = np.argsort(away.astype(np.min_scalar_type(len(letters))), kind="stable")
        own, to, value = node[order], (node + span)[order], logit[order]
        value_after = span[order] < away[order]
        opens = np.flatnonzero(np.diff(own, prepend=-1))
        bounds = np.searchsorted(away[order], np.arange(1, int(left.max()) + 2))
        groups = np.searchsorted(opens, bounds)
        sums = np.zeros(len(letters) + 1)
        for i in range(len(bounds) - 1):  # nodes so far from their word's end, nearest first
            part = slice(bounds[i], bounds[i + 1])
            first = opens[groups[i] : groups[i + 1]] - bounds[i]
            v = value[part]
            v += np.where(value_after[part], sums[to[part]], 0.0)
            most = np.maximum.reduceat(v, first)
            count = np.diff(first, append=len(v))
            total = most + np.log(np.add.reduceat(np.exp(v - np.repeat(most, count)), first))
            sums[own[part][first]] = total
            v -= np.repeat(total, count)
        logp = np.empty(len(value))
        logp[order] = value
        first = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(letters)))])
        share = np.exp(logp)
        for name, values in zip(self.KINDS, (piece, span, logp, share, self._log_rest(logp, share, node, first)), strict=True):
            self._put(name, self.edges, values)
        self._put("first", self.nodes, first + self.edges)
        self._put("letter", self.nodes, np.where(letters == ord(SPACE), ord(" "), letters))
        self.edges += len(node)
        self.nodes += len(letters)

    @staticmethod
    def _log_rest(logp: np.ndarray, share: np.ndarray, node: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log of the share of each edge's siblings together (-inf for an only edge)."""
        several = np.diff(first)[node] > 1
        with np.errstate(divide="ignore"):
            rest = np.where(several, np.log1p(-np.minimum(share, 1.0)), -np.inf)
        near = np.flatnonzero((share > 1 - 1e-6) & several)  # too near to 1 to subtract
        if len(near):
            begin, n = first[node[near]], first[node[near] + 1] - first[node[near]]
            at = np.cumsum(n) - n
            others = logp[np.repeat(begin - at, n) + np.arange(n.sum())]
            others[at + near - begin] = -np.inf
            most = np.maximum.reduceat(others, at)
            rest[near] = most + np.log(np.add.reduceat(np.exp(others - np.repeat(most, n)), at))
        return rest


def pieces(path: str) -> Pieces:
    """The model of a file, kept until the worker goes on to another operator's tasks."""
    kept = tn.kept_by("sp_codec")
    if path not in kept:
        kept[path] = Pieces(path)
    return kept[path]


def draw_seed(key: int, draw: int) -> int:
    """The number that all values of a draw come from."""
    return (key * 0x9E3779B97F4A7C15 + draw * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1


def uniforms(keys: list[int], draw: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for each row's key and the number of a draw."""
    x = tn.mix(tn.mix(np.array([draw_seed(key, draw) for key in keys], U64))).view(np.uint32)
    u = (x + 0.5) * 2.0**-32
    return u[::2], u[1::2]


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def truncated(value: float, free: float) -> float:
    """A Gumbel variable whose free draw is `free`, given that it is below `value`; grows with `free`."""
    return -float(np.logaddexp(-value, -free))


class Steps:
    """The lattices of some texts' words, laid end to end: a place for each character."""

    def __init__(self, model: Pieces, ids: np.ndarray):
        self._lay(model, *model.cut([model.decode(ids.tolist())]))

    @classmethod
    def over(cls, model: Pieces, chunks: list[list[str]]) -> Steps:
        """The steps of texts that are already cut into words."""
        whole = "".join(itertools.chain.from_iterable(chunks))
        bounds = np.cumsum([0] + [len(w) for c in chunks for w in c])
        return cls.at(model, whole, np.frombuffer(whole.encode("utf-32-le"), np.uint32), bounds, np.cumsum([0] + [len(c) for c in chunks]))

    @classmethod
    def at(cls, model: Pieces, whole: str, letters: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> Steps:
        """The steps of what `cut` gives."""
        own = object.__new__(cls)
        own._lay(model, whole, letters, bounds, words)
        return own

    def _lay(self, model: Pieces, whole: str, letters: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> None:
        self.model, self.lattice, self.starts, self.words = model, model.lattice, bounds, words
        self.records = self.lattice.records(whole, letters, bounds)
        n = int(bounds[-1])
        self.node = np.repeat(self.lattice.base[self.records] - bounds[:-1], np.diff(bounds)) + np.arange(n)
        self.begins = np.zeros(n + 1, bool)
        self.begins[self.starts] = True

    def walk(self, at: np.ndarray, seed: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each place to its word's end by drawn edges: for every place met its edge (else -1), and a second draw."""
        edges, noise = np.full(len(self.node), -1, np.int64), np.zeros(len(self.node))
        first, shares, span = self.lattice.first, self.lattice.share, self.lattice.span
        while len(at):
            x = tn.mix(seed + (at - origin).astype(U64) * U64(0xD1B54A32D192ED03)).view(np.uint32)
            u = (x + 0.5) * 2.0**-32
            choice, noise[at] = u[::2], u[1::2]
            node = self.node[at]
            edge, last = first[node], first[node + 1] - 1
            share = shares[edge]
            over = np.flatnonzero((choice >= share) & (edge < last))
            choice, share, way, last = choice[over], share[over], edge[over], last[over]
            while len(over):
                choice = choice - share
                way = way + 1
                share = shares[way]
                on = (choice >= share) & (way < last)
                edge[over] = way
                over, choice, share, way, last = over[on], choice[on], share[on], way[on], last[on]
            edges[at] = edge
            at = at + span[edge]
            on = ~self.begins[at]
            at, seed, origin = at[on], seed[on], origin[on]
        return edges, noise

    def spelled(self, ways: np.ndarray) -> np.ndarray:
        """The pieces of a path."""
        return self.all_spelled([ways])[0]

    def all_spelled(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of paths, one after the other, and the n + 1 bounds of theirs."""
        ids = self.lattice.piece[np.concatenate([np.zeros(0, np.int64), *paths])]
        ends = np.cumsum([0] + [len(ways) for ways in paths])
        some = np.flatnonzero(ids < 0)
        if not len(some):
            return ids, ends
        own = {int(i): self.model.fallback(chr(-1 - i)) for i in np.unique(ids[some])}
        count = np.ones(len(ids), np.int64)
        count[some] = [len(own[i]) for i in ids[some].tolist()]
        out = np.repeat(ids, count)
        out[out < 0] = [p for i in ids[some].tolist() for p in own[i]]
        return out, np.concatenate([[0], np.cumsum(count)])[ends]


class Search:
    """The paths of one text that are out, and what they leave."""

    def __init__(self, steps: Steps, text: int, key: int, value: float):
        self.steps, self.key = steps, key
        self.starts = steps.starts[steps.words[text] : steps.words[text + 1]]
        self.start, self.end = (int(steps.starts[steps.words[t]]) for t in (text, text + 1))
        self.out: list[tuple[np.ndarray, float, float]] = []
        self.places: list[np.ndarray] = []  # where the steps of a path begin
        self.fringe: list[np.ndarray] = []  # for each step of a path the free Gumbel draw of what it leaves out
        self.before: list[np.ndarray] = []  # log-probability of the path before each step
        self.taken: list[dict[int, list[int]]] = []  # edges already out at a step
        self.later: list[dict[int, float]] = []  # values of what is left at steps that paths have branched off from
        self.value, self.edge = value, -np.inf
        self.prefix = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1)
        self.open = self.starts

    def add(self, fresh: np.ndarray, edges: np.ndarray, logp: np.ndarray, rest: np.ndarray, noise: np.ndarray) -> None:
        """Put out the path of the prefix and the edges walked from `open` (places, edges, their values and draws); its maximum is `value`."""
        places, ways, sums = self.prefix
        n, ways = len(places), np.concatenate([ways, edges])
        sums = np.concatenate([sums[:-1], np.cumsum(np.concatenate([sums[-1:], logp]))])
        free = np.full(len(ways), -np.inf)
        free[n:] = sums[n:-1] + rest + noise
        self.out.append((ways, float(sums[-1]), self.value))
        self.places.append(np.concatenate([places, fresh]))
        self.fringe.append(free)
        self.before.append(sums)
        self.taken.append({})
        self.later.append({})

    def next_best(self) -> tuple[float, int, int]:
        """Value, path and step of the best subtree that no path has entered."""
        found = [(v, p, i) for p, left in enumerate(self.later) for i, v in left.items()]
        for p, free in enumerate(self.fringe):
            at = int(free.argmax())
            found.append((truncated(self.out[p][2], float(free[at])), p, at))
        return max(found)

    def branch(self, k: int, choice: float, noise: float) -> bool:
        """Enter the best subtree by the draws given; False, with the threshold kept, when k paths are out or none is left."""
        value, path, at = self.next_best()
        if len(self.out) == k or value == -np.inf:
            self.edge = value
            return False
        lattice, ways, place = self.steps.lattice, self.out[path][0], int(self.places[path][at])
        node = int(self.steps.node[place])
        first = int(lattice.first[node])
        gone = self.taken[path].setdefault(at, [int(ways[at]) - first])
        logp = lattice.logp[first : int(lattice.first[node + 1])].copy()
        logp[gone] = -np.inf
        p = np.exp(logp - logp.max())
        way = min(int(np.searchsorted(np.cumsum(p), choice * p.sum(), "right")), int(np.flatnonzero(p)[-1]))
        gone.append(way)
        before = self.before[path][: at + 1]
        sums = np.append(before, before[-1] + lattice.logp[first + way])
        logp[way] = -np.inf
        self.fringe[path][at] = -np.inf
        self.later[path][at] = truncated(value, before[-1] + float(np.logaddexp.reduce(logp)) + noise) if np.isfinite(logp).any() else -np.inf
        self.value, self.prefix = value, (self.places[path][: at + 1], np.append(ways[:at], first + way), sums)
        to = place + int(lattice.span[first + way])
        after = self.starts[np.searchsorted(self.starts, place, "right") :]
        self.open = after if self.steps.begins[to] else np.append(after, to)
        return True


def sample_texts(steps: Steps, keys: list[int], k: int) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """For each text up to k distinct paths in falling order of their perturbed value, and the value of the next one (-inf if none).

    A path is (ways, log p, perturbed value).
    """
    every = [Search(steps, i, key, value) for i, (key, value) in enumerate(zip(keys, gumbel(uniforms(keys, 0)[0]).tolist(), strict=True))]
    for s in every:
        if not len(s.starts) and k > 0:
            s.out.append((np.zeros(0, np.int64), 0.0, s.value))
    live = [s for s in every if len(s.starts) and k > 0]
    lattice, paths = steps.lattice, 0
    while live:
        n = [len(s.open) for s in live]
        seeds = tn.mix(np.array([draw_seed(s.key, 2 * paths + 1) for s in live], U64))
        edges, noise = steps.walk(np.concatenate([s.open for s in live]), np.repeat(seeds, n), np.repeat([s.start for s in live], n))
        places = np.flatnonzero(edges >= 0)
        ways, noise = edges[places], gumbel(noise[places])
        met = places, ways, lattice.logp[ways], lattice.rest[ways], noise
        for s, a, b in zip(live, *(np.searchsorted(places, [getattr(s, x) for s in live]).tolist() for x in ("start", "end")), strict=True):
            s.add(*(x[a:b] for x in met))
        paths += 1
        choice, noise = uniforms([s.key for s in live], 2 * paths)
        live = [s for s, c, g in zip(live, choice.tolist(), gumbel(noise).tolist(), strict=True) if s.branch(k, c, g)]
    return [(s.out, s.edge) for s in every]


def sample_paths(steps: Steps, key: int, k: int) -> tuple[list[tuple[np.ndarray, float, float]], float]:
    """sample_texts for a single text."""
    return sample_texts(steps, [key], k)[0]


SAMPLE_SQL = "struct<ids: array<int>, log_p: double, perturbed: double, inclusion: double>"


def _encode(path: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part, texts in tn.slices(batch, limit=WALK_BYTES):
                keys = part.column(part.schema.get_field_index("doc_id"))
                model.lattice.trim()
                steps = Steps.at(model, *model.cut(texts.to_pylist()))
                every, ends = model.lattice.encodings(steps.records, steps.words)
                drawn = sample_texts(steps, [(key or 0) & (1 << 64) - 1 for key in keys.to_pylist()], k)
                spelled, bounds = steps.all_spelled([ways for found, _ in drawn for ways, _, _ in found])
                scores = [(log_p, value, 1.0 if edge == -np.inf else float(-np.expm1(-np.exp(min(log_p - edge, 50.0))))) for found, edge in drawn for _, log_p, value in found]
                count = np.cumsum([0] + [len(found) for found, _ in drawn])
                table_of = np.array(scores, np.float64).reshape(-1, 3)
                lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
                samples = pa.StructArray.from_arrays([lists(bounds, pa.array(spelled)), *map(pa.array, table_of.T)], names=["ids", "log_p", "perturbed", "inclusion"])
                yield pa.RecordBatch.from_arrays([keys, lists(ends, pa.array(every)), lists(count, samples)], names=["doc_id", "ids", "samples"])

    return run


def encode(docs: DataFrame, path: str, k: int = 2) -> DataFrame:
    """doc_id, ids (the model's own encoding), samples (k distinct sampled segmentations, most perturbed first)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_encode(path, k), f"doc_id bigint, ids array<int>, samples array<{SAMPLE_SQL}>")


def _decode(path: str, columns: dict[str, str], carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = []
                for column in columns:
                    lists = part.column(part.schema.get_field_index(column))
                    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                    found = model.decode_all(lists.flatten().to_numpy(), bounds)
                    texts.append(pa.array([t if known else None for t, known in zip(found, lists.is_valid().to_pylist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in carried] + texts, names=[*carried, *columns.values()])

    return run


def decode(encoded: DataFrame, path: str, columns: dict[str, str] | None = None, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carried` columns and, for each entry of `columns` (ids to decoded), the text that its ids spell; null ids give null."""
    columns = columns or {"ids": "decoded"}
    kept = ", ".join([f"{c} {t}" for c, t in encoded.select(*carried).dtypes] + [f"{c} string" for c in columns.values()])
    return encoded.select(*dict.fromkeys([*carried, *columns])).mapInArrow(_decode(path, columns, list(carried)), kept)


def _digest(path: str, k: int):
    encoded = _encode(path, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What `encode` and `decode` give for each document and each of its samples, told without the ids and texts themselves."""
        model = pieces(path)
        for batch in encoded(batches):
            ids, samples = batch.column("ids"), batch.column("samples")
            flat = samples.flatten()
            drawn = flat.field("ids")
            bounds = lambda lists: lists.offsets.to_numpy().astype(np.int64)
            texts = model.decode_all(ids.flatten().to_numpy(), bounds(ids))
            row = np.repeat(np.arange(len(batch)), np.diff(samples.offsets.to_numpy()))
            agree = np.ones(len(batch), bool)
            agree[[i for i, t in zip(row.tolist(), model.decode_all(drawn.flatten().to_numpy(), bounds(drawn)), strict=True) if t != texts[i]]] = False
            shape = pa.StructArray.from_arrays([drawn.value_lengths(), flat.field("log_p"), flat.field("inclusion")], names=["n", "log_p", "inclusion"])
            sha = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
            per_sample = [pa.ListArray.from_arrays(samples.offsets, values) for values in (shape, flat.field("perturbed"), ids_sha256(drawn))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids.value_lengths(), sha, pa.array(agree), per_sample[0], ids_sha256(ids), *per_sample[1:]], names=["doc_id", "n_pieces", "text_sha256", "samples_agree", "samples", "ids_sha256", "perturbed", "samples_sha256"])

    return run


def ids_sha256(lists: pa.ListArray) -> pa.Array:
    """The SHA-256 of each list's ids as little-endian unsigned 32-bit integers."""
    raw, cut = lists.flatten().to_numpy().astype("<u4").tobytes(), (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string())


def codec_digest(docs: DataFrame, path: str, k: int = 2) -> DataFrame:
    """For every document: pieces, whether decoding its ids and each of its samples gives one text, that text's SHA-256, the
    samples' sizes, log-probabilities and inclusion scores (6 digits), the SHA-256 of its ids, and the samples' perturbed
    values (6 digits) and the SHA-256 of theirs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shape = "array<struct<n: int, log_p: double, inclusion: double>>"
    out = docs.mapInArrow(_digest(path, k), f"doc_id bigint, n_pieces int, text_sha256 string, samples_agree boolean, samples {shape}, ids_sha256 string, perturbed array<double>, samples_sha256 array<string>")
    rounded = F.transform("samples", lambda s: F.struct(s["n"].alias("n"), F.round(s["log_p"], 6).alias("log_p"), F.round(s["inclusion"], 6).alias("inclusion")))
    return out.withColumns({"samples": rounded, "perturbed": F.transform("perturbed", lambda x: F.round(x, 6))})
