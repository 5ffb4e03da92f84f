"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model is compiled into three machines: the normaliser (a transducer of rewrite rules, longest
match first, given as pairs or as a model's precompiled character map, then the escape of spaces), the lexicon (every piece, and a path of
byte pieces for a character that no piece spells), and, for a byte-pair model, an acceptor of
piece pairs. A text's encoding is the path of least weight, in the tropical
semiring, through their composition with it. Unigram pieces weigh minus their score.
In a byte-pair model pieces weigh nothing and a pair weighs infinity unless merging
the two pieces' characters gives back just these two; one path of finite weight is
left, the merge order's own result. Arcs of the pair acceptor are made when first met.

Two neighbouring characters that stand together in no piece are a cut: no arc spans
it, so the shortest path of a text is the concatenation of those of its cuts.
"""

from __future__ import annotations

import itertools
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from selfsim.llm.common import gather, pieces_of, small_batches, texts_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A model file of more bytes is not shipped to executors.
MOST_MODEL_BYTES = 64 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Rewriter:
    """The normaliser's transducer: at each place the longest source that stands there is rewritten, any other character is copied.

    Its arcs are a trie of UTF-8 bytes: of given rules, or the double array of a precompiled character map (a
    32-bit size, the units, then the targets, each ended by a zero byte).
    """

    def __init__(self, rules: dict[str, str], blob: bytes = b"") -> None:
        self.trie: dict = {}
        for source, target in rules.items():
            node = self.trie
            for c in source.encode():
                node = node.setdefault(c, {})
            node[-1] = target.encode()
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units, self.targets = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
        self.known: dict[str, str] = {}

    def __bool__(self) -> bool:
        return bool(self.trie or self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes of the longest source at a place, its target); 0 where there is none. Given rules come first."""
        best, node = (0, b""), self.trie
        for k in range(at, len(data)):
            node = node.get(data[k])
            if node is None:
                break
            if -1 in node:
                best = k + 1 - at, node[-1]
        if best[0] or not self.units:
            return best
        units, place = self.units, 0
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        place ^= offset(units[0])
        for k in range(at, len(data)):
            place ^= data[k]
            unit = units[place] if place < len(units) else 0
            if unit & 0x800000FF != data[k]:
                break
            place ^= offset(unit)
            if unit >> 8 & 1:
                start = units[place] & 0x7FFFFFFF
                best = k + 1 - at, self.targets[start : self.targets.index(0, start)]
        return best

    def rewrite(self, text: str) -> str:
        """The output of the text's only path. Words are rewritten apart where no source has a space within, and remembered."""
        return " ".join(map(self.word, text.split(" "))) if " " not in self.inner() else self.whole(text)

    def inner(self) -> str:
        """A space if a given rule's source has one within a longer source."""
        if not hasattr(self, "_inner"):
            self._inner = " " if any(c == 32 and len(n) > (-1 in n) for c, n in self.trie.items() if c >= 0) or self._spaced(self.trie) else ""
        return self._inner

    def _spaced(self, node: dict, depth: int = 0) -> bool:
        return any(c >= 0 and (depth and c == 32 or self._spaced(n, depth + 1)) for c, n in node.items())

    def word(self, text: str) -> str:
        if text not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            out = self.whole(text)
            if len(text) > 64:
                return out
            self.known[text] = out
        return self.known[text]

    def whole(self, text: str) -> str:
        data, out, at = text.encode(), [], 0
        while at < len(data):
            n, target = self.longest(data, at)
            if not n:
                n = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                target = data[at : at + n]
            out.append(target)
            at += n
        return b"".join(out).decode("utf-8", "replace")


class Tokenizer:
    """A compiled model. rules: rewrite rules of the normaliser, source to target, besides those of the model file."""

    def __init__(self, model: bytes, rules: dict[str, str] | None = None, cache: int = 200_000) -> None:
        if len(model) > MOST_MODEL_BYTES:
            raise ValueError(f"a model has {MOST_MODEL_BYTES} bytes at most")
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.prefix, self.squeeze, charmap = False, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                x = dict(_fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, bytes(4)))[0], x.get(3, NORMAL)))
            elif number == 2:
                x = dict(_fields(value))
                self.bpe = x.get(3, 1) == 2
                if x.get(3, 1) > 2 or x.get(24):
                    raise ValueError("unigram and byte-pair models with spaces before words are read, no others")
            elif number == 3:
                x = dict(_fields(value))
                charmap = x.get(2, b"")
                self.prefix, self.squeeze = bool(x.get(3, 1)), bool(x.get(4, 1))
        self.rewriter = Rewriter(dict(rules or {}), charmap)
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        normal = [x[1] for x in self.pieces if x[2] == NORMAL]
        user = [p for p, _, kind in self.pieces if kind == USER]
        # a user's piece costs about as much as its characters would at the best score there is
        self.weight = {p: -self.pieces[i][1] for p, i in self.ids.items()} | {p: 0.1 - len(p.encode()) * max(normal, default=0.0) for p in user}
        self.users = re.compile("|".join(map(re.escape, sorted(user, key=len, reverse=True)))) if user else None
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.least = -min(normal, default=0.0) + 10.0
        self.longest = max(map(len, self.ids), default=1)
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.ends = {p[k:] for p in self.ids for k in range(len(p))}
        self.spaced = not any(b[1] == MARK and b[0] != MARK for b in self.pairs)
        self.surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNUSED) else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        self.split: dict[str, tuple[str, str]] = {}
        self.dead: set[str] = set()
        self.odd: set[str] = set()
        self.joined: dict[tuple[str, str], bool] = {}
        if self.bpe:
            self.compile_pairs()
        # pieces that no merge gives stand in the lexicon only as single characters' way out
        self.usable = {p: w for p, w in self.weight.items() if p not in self.dead}
        self.most, self.words, self.parts = cache, {}, {}

    def normalise(self, text: str) -> str:
        """The text after the normaliser's rules, before spaces are escaped. A user's pieces are not rewritten."""
        if self.rewriter:
            if self.users is None:
                text = self.rewriter.rewrite(text)
            else:
                plain, own = self.users.split(text), self.users.findall(text)
                text = "".join(x for pair in zip(map(self.rewriter.rewrite, plain), [*own, ""], strict=True) for x in pair)
        return " ".join(x for x in text.split(" ") if x) if self.squeeze else text

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def merges(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """What merging the text's characters gives, best score and leftmost first, and the last pair merged."""
        s, last = list(text), ("", "")
        while True:
            best = min(((self.weight[x + y], k) for k, (x, y) in enumerate(zip(s, s[1:], strict=False)) if x + y in self.weight), default=None)
            if best is None:
                return s, last
            last = s[best[1]], s[best[1] + 1]
            s[best[1] : best[1] + 2] = ["".join(last)]

    def compile_pairs(self) -> None:
        """Keeps the pieces that merging can give, with their last pair; odd are those with a part, at any depth, that scores no better."""
        for p in [*self.ids]:
            if len(p) > 1:
                made, last = self.merges(p)
                if made != [p]:
                    self.dead.add(p)
                else:
                    self.split[p] = last
        for p in sorted(self.split, key=len):
            if any(x in self.odd or self.weight[x] >= self.weight[p] for x in self.split[p] if len(x) > 1):
                self.odd.add(p)

    def compatible(self, a: str, b: str) -> bool:
        """An arc of the pair acceptor: merging the characters of a + b gives a, b.

        The merges along the border are undone from the last one on; a pair across the
        border that would have come before an undone merge makes the arc infinite.
        """
        if a in self.odd or b in self.odd:
            return self.merges(a + b)[0] == [a, b]
        limit, strict = math.inf, False
        while True:
            w = self.weight.get(a + b)
            if w is not None and (w < limit or w == limit and not strict):
                return False
            ra, rb = self.weight[a] if a in self.split else -1e300, self.weight[b] if b in self.split else -1e300
            if ra == rb == -1e300:
                return True
            if rb >= ra:
                limit, strict, b = rb, False, self.split[b][0]
            else:
                limit, strict, a = ra, True, self.split[a][1]

    def shortest(self, texts: list[str]) -> Iterator[list[int]]:
        """Piece ids of the least-weight path over each escaped text without cuts.

        In sorted order a text goes on from the weights of the prefix that it shares with the one before.
        """
        usable, ends, bpe, joined, least, longest, ids = self.usable, self.ends, self.bpe, self.joined, self.least, self.longest, self.ids
        n = max(map(len, texts), default=0) + 1
        cost, back, last, before = [0.0] * n, [0] * n, [""] * n, ""
        for text in texts:
            j = 0
            for x, y in zip(text, before, strict=False):
                if x != y:
                    break
                j += 1
            before, size = text, len(text)
            while j < size:
                j += 1
                best, i, low = math.inf, j, j - longest if j > longest else 0
                while i > low:
                    i -= 1
                    piece = text[i:j]
                    if piece not in ends:
                        break
                    w = usable.get(piece)
                    if w is None:
                        continue
                    if bpe:
                        # an arc of the lexicon goes on only if the pair acceptor has one for it and the piece before
                        if i and (a := last[i]):
                            fits = joined.get((a, piece))
                            if fits is None:
                                fits = joined[a, piece] = self.compatible(a, piece)
                            if not fits:
                                continue
                        w = cost[i]
                    else:
                        w += cost[i]
                    if w < best:
                        best, back[j], last[j] = w, i, piece
                        if bpe and w < least:
                            break
                if cost[j - 1] + least < best and text[j - 1] not in usable:
                    best, back[j], last[j] = cost[j - 1] + least, j - 1, ""
                cost[j] = best
            out, k = [], size
            while k:
                out.append(last[k] or text[k - 1])
                k = back[k]
            out.reverse()
            try:
                yield [ids[p] for p in out]
            except KeyError:
                yield [x for p in out for x in ([ids[p]] if p in ids else self.fallback(p))]
        if len(joined) > self.most:
            joined.clear()

    def cuts(self, text: str) -> list[str]:
        """An escaped text in parts, cut where no piece spans two characters."""
        pairs = self.pairs
        at = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in pairs]
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)] if at else [text]

    def escaped(self, texts: list[str]) -> list[list[int]]:
        """Piece ids of escaped texts: those not met lately are cut, and their new parts solved in sorted order."""
        fresh = {t: self.cuts(t) for t in texts if t not in self.words}
        new = sorted({p for parts in fresh.values() for p in parts if p not in self.parts})
        solved = dict(zip(new, self.shortest(new), strict=True))
        known = self.parts
        piece_ids = lambda p: solved.get(p) or known[p]
        made = {t: piece_ids(parts[0]) if len(parts) == 1 else [x for p in parts for x in piece_ids(p)] for t, parts in fresh.items()}
        out = [made.get(t) or self.words[t] for t in texts]
        for store, fill in ((self.words, made), (self.parts, solved)):
            if len(store) + len(fill) > self.most:
                store.clear()
            store.update((k, v) for k, v in itertools.islice(fill.items(), self.most) if len(k) <= 64)
        return out

    def encode(self, text: str) -> list[int]:
        """Piece ids of a text; none for an empty one."""
        text = self.normalise(text)
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if self.bpe and self.users is not None:
            # a user's piece is a symbol of its own, that no merge reaches across
            ids, at = [], 0
            for m in self.users.finditer(text):
                ids += [*self._encode(text[at : m.start()]), self.ids[m[0]]]
                at = m.end()
            ids += self._encode(text[at:])
        else:
            ids = self._encode(text)
        return ids if self.bytes else [x for k, x in enumerate(ids) if not k or x != self.unknown or ids[k - 1] != x]

    def _encode(self, text: str) -> list[int]:
        """Piece ids of an escaped text; without byte pieces, one unknown for each character that no piece spells."""
        if not self.spaced or not text:
            return self.escaped([text])[0] if text else []
        parts, at = [], 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k] == MARK and text[k - 1] != MARK:
                parts.append(text[at:k])
                at = k
        return [x for ids in self.escaped(parts) for x in ids]

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; bytes that are not UTF-8 become U+FFFD."""
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of an array of texts: each distinct space-separated word is looked up once. Null: none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.rewriter or self.users is not None or not self.bytes or self.squeeze or not self.prefix or not self.spaced:
            rows = [self.encode(t) for t in texts.to_pylist()]
            return np.cumsum([0, *map(len, rows)]), np.array([x for r in rows for x in r], np.int32)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        empty = np.concatenate([[0], np.cumsum(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes])]) if len(codes) else np.zeros(1, np.int64)
        own = self.escaped([MARK + w for w in words])
        bounds = np.cumsum([0, *map(len, own)])
        flat = np.fromiter(itertools.chain.from_iterable(own), np.int32, int(bounds[-1]))
        odd = np.flatnonzero(empty[offsets[1:]] > empty[offsets[:-1]])
        at, ends = gather(bounds, codes)
        out, lens = flat[at], np.diff(ends[offsets])
        if not len(odd):
            return ends[offsets], out
        parts, texts = np.split(out, np.cumsum(lens)[:-1]), texts.take(pa.array(odd)).to_pylist()
        for k, t in zip(odd.tolist(), texts, strict=True):
            parts[k] = np.array(self.encode(t), np.int32)
        return np.cumsum([0, *map(len, parts)]), np.concatenate(parts)


_COMPILED: dict[int, Tokenizer] = {}


def compiled(model: bytes, rules: tuple[tuple[str, str], ...] = ()) -> Tokenizer:
    """The tokenizer of a model, compiled once in a worker."""
    key = hash((model, rules))
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Tokenizer(model, dict(rules))
    return _COMPILED[key]


def encode(docs: DataFrame, model: bytes, rules: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row of docs.

    round_trip: decoding the ids gives back the normalised text (the escape character itself reads as a space). A null text has no
    tokens and a true round_trip, as an empty one. Repeated rows stay; other columns are not read.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(shipped.value, rules)
        for batch in batches:
            for part in pieces_of(batch, "text", 6_000_000):
                offsets, ids = fst.encode_batch(part.column("text"))
                values, bounds = ids.tolist(), offsets.tolist()
                same = [fst.decode(values[a:b]) == fst.normalise(t or "").replace(MARK, " ") for t, a, b in zip(part.column("text").to_pylist(), bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text, empty ones an empty text. Repeated rows and null ids of documents stay; other columns are not read."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(shipped.value)
        for batch in batches:
            texts = [None if ids is None else fst.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
