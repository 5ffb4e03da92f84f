"""Benchmark decontamination by latent semantic retrieval.

Texts are read as words (lower case, outer punctuation off) and kept as codes in the
shared folder: a word of the benchmark has a code of its own, any other word one of
BUCKETS by its hash, so that the vocabulary is that of all texts and its size is bounded.
A randomised singular value decomposition of the TF-IDF matrix of all passages of PASSAGE
words takes two distributed passes: one counts in how many passages each bucket occurs, one
multiplies the matrix's Gram form by a random test matrix (one-pass Nystrom form).

A word's latent vector is its row of right singular vectors scaled to length one, without
the LEADING directions, which tell languages and topics apart rather than passages; a
window's is the sum of its words' vectors by inverse document frequency. Items are
compared by cosine with windows of about their own length at every quarter of it. A
candidate must have SHARED of the item's weight in words, and is then
checked by the longest common subsequence with the item over every window of twice the item's
words around it, and by whether it has the item's answer.

A benchmark of any size is taken in parts that fit a broadcast; the decomposition is
computed once.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selfsim.llm.common import SPACE, cut, pieces_of, ragged, small_batches, texts_of

PASSAGE = 32
BUCKETS = 8192
RANK, LEADING, SPARE = 48, 24, 8
#: Buckets in a larger share of all passages are left out of the decomposition; their directions are random.
COMMON = 0.1
#: Words of the windows that items are compared with, and of a block; an item goes by the least size that holds it, a longer one by stretches of the largest.
SIZES, BLOCK = (16, 20, 24, 32, 40, 48, 64, 80, 96, 128), 4
#: Least cosine of a candidate window.
COSINE = 0.35
#: Share of an item's weight that a candidate window must have, read off a filter of FILTER hashed terms for each item.
SHARED, FILTER = 0.4, 2048
#: A region is a copy with this share of the item's words in order, or a paraphrase with the second share and the answer.
COPIED, PARAPHRASED, ANSWERED = 0.8, 0.6, 0.8
ANSWER_WORDS = 6
#: Items and bytes of the part of a benchmark that is broadcast at once; a benchmark of more is taken in several.
MOST_ITEMS, MOST_BYTES = 8192, 16 << 20
#: Bytes of codes for each task of the decomposition, so that its matrices stay small beside the texts.
TASK_BYTES = 32 << 20
FAN = 64
EDGES = string.punctuation + "“”‘’«»¿¡…–—"


def word_list(text: str | None) -> list[str]:
    """Lower-case words (ASCII letters lowered) without outer punctuation; words of punctuation alone are none."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for x in re.split(SPACE, low) for w in [x.strip(EDGES)] if w]


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % BUCKETS


@dataclass
class Benchmark:
    """Items as arrays of term ids; terms are the words of all items."""

    ids: list[int]
    terms: dict[str, int]
    items: list[np.ndarray]
    answers: list[list[int]]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Benchmark:
        terms: dict[str, int] = {}
        out = cls([], terms, [], [])
        for r in sorted(set(rows)):
            words = word_list(r[1])
            if words:
                own = [terms.setdefault(w, len(terms)) for w in words]
                out.ids.append(r[0])
                out.items.append(np.array(own))
                out.answers.append(answer_of(own, r[1]))
        return out

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if len(self.terms) + BUCKETS < 65536 else "<i4")

    def buckets(self) -> np.ndarray:
        """The bucket of each code."""
        return np.concatenate([np.array([bucket(w) for w in self.terms], np.int64), np.arange(BUCKETS)])


def parts_of(benchmark: DataFrame, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> Iterator[Benchmark]:
    """The benchmark's items, dealt by hash to parts within the bounds; a part is one item at least."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    many = 1
    while True:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(many))
        sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).where(F.col("n") > 1).agg(F.max("n"), F.max("size")).first()
        if (sizes[0] or 0) <= most_items and (sizes[1] or 0) <= most_bytes:
            break
        many *= 2
    for k in range(many):
        own = Benchmark.of([(r.item_id, r.text) for r in rows.where(part == k).collect()])
        if own.items:
            yield own


def answer_of(own: list[int], text: str) -> list[int]:
    """The item's answer: the words of its last non-empty line, ANSWER_WORDS of them at least where it has so many."""
    lines = [x for x in map(word_list, text.split("\n")) if x]
    return own[-max(ANSWER_WORDS, len(lines[-1])) :]


def common_length(masks: dict[int, int], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence of words and an item of m words given as position masks (bit-parallel)."""
    full = v = (1 << m) - 1
    for t in words:
        mask = masks.get(t)
        if mask:
            u = v & mask
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, t in enumerate(words):
        out[t] = out.get(t, 0) | 1 << k
    return out


def coded(texts: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, codes) of texts: a benchmark word's place in names, else their number plus the word's bucket; one of punctuation alone isn't there."""
    offsets, words, codes = ragged(texts, lower=True)
    if not len(codes):
        return offsets, codes
    words = pc.utf8_trim(words, EDGES)
    own = pc.fill_null(pc.index_in(words, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    other = np.flatnonzero(own < 0)
    spelt = words.take(pa.array(other)).cast(pa.large_binary()).to_pylist()
    own[other] = len(names) + np.fromiter(map(xxhash.xxh32_intdigest, spelt), np.int64, len(other)) % BUCKETS
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[codes]
    ids = own[codes]
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        ids = ids[full]
    return offsets, ids


def passages(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each word, text of each passage) for consecutive passages of size words."""
    n = np.diff(offsets)
    many = -(-n // size)
    first = np.cumsum(many) - many
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
    return np.repeat(first, n) + at // size, np.repeat(np.arange(len(n)), many)


def counted(offsets: np.ndarray, ids: np.ndarray, terms: int, size: int) -> tuple[np.ndarray, int]:
    """(the number of passages that each term occurs in, the number of passages)."""
    of, owner = passages(offsets, size)
    keys = np.sort(of * terms + ids)
    return np.bincount(keys[runs(keys)] % terms, minlength=terms), len(owner)


def runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each row of places the sum of the table's rows there."""
    out, one = table[rows[:, 0]], np.empty((len(rows), table.shape[1]), table.dtype)
    for k in range(1, rows.shape[1]):
        out += np.take(table, rows[:, k], 0, out=one, mode="clip")
    return out


def scatter(out: np.ndarray, term: np.ndarray, at: np.ndarray, rows: np.ndarray, often: int = 48) -> None:
    """Adds rows[at] to out[term], terms repeated: frequent ones by a product of counts, the others in rounds without repeats."""
    order = np.argsort(term, kind="stable")
    term, at = term[order], at[order]
    first = runs(term)
    size = np.diff(np.r_[first, len(term)])
    many = np.flatnonzero(size > often)
    if len(many):
        place = np.repeat(np.arange(len(many)), size[many]) * len(rows)
        place += at[np.repeat(size > often, size)]
        out[term[first[many]]] += np.bincount(place, minlength=len(many) * len(rows)).reshape(len(many), -1).astype(np.float32) @ rows
    first, size = first[size <= often], size[size <= often]
    for k in range(int(size.max(initial=0))):
        some = first[size > k] + k
        out[term[some]] += rows[at[some]]


def gram(offsets: np.ndarray, ids: np.ndarray, right: np.ndarray, out: np.ndarray, most: int = 2048) -> None:
    """Adds to out, for each word of each passage of PASSAGE words, the sum of the rows of right that the passage's words have;
    the last row of right is zero and stands for a word left out."""
    of, owner = passages(offsets, PASSAGE)
    none = len(right) - 1
    words = np.full((len(owner), PASSAGE), none)
    words[of, np.arange(len(ids)) - runs(of)[of] if len(of) else of] = ids
    for k in range(0, len(words), most):
        own = words[k : k + most]
        rows, flat = summed(right, own), own.ravel()
        full = np.flatnonzero(flat != none)
        scatter(out, flat[full], full // PASSAGE, rows)


def totals(parts: DataFrame, tasks: int, rows: int, columns: int) -> np.ndarray:
    """The sum of the tasks' matrices, given as rows (block, slot, m binary), added FAN at a time."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m, np.float32).astype(np.float64) for m in group.column("m").to_pylist())
        return pa.table({"block": group.column("block")[:1], "slot": pa.array([group.column("slot")[0].as_py() // FAN]), "m": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while True:
        parts = parts.groupBy("block", F.expr(f"slot div {FAN}").alias("k")).applyInArrow(add, "block long, slot long, m binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    found = {r.block: np.frombuffer(r.m, np.float32) for r in parts.collect()}
    return np.concatenate([found[k] for k in sorted(found)]).reshape(-1, columns) if found else np.zeros((rows, columns), np.float32)


def code(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """(doc_id, words): each text's codes as little-endian integers, cut into the shared folder."""
    names, kind = docs.sparkSession.sparkContext.broadcast(list(bench.terms)), bench.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names.value, pa.large_string())
        for batch in batches:
            for part in pieces_of(batch, "text", 6_000_000):
                offsets, ids = coded(part.column("text"), known)
                bounds = pa.py_buffer((offsets * kind.itemsize).astype(np.int64).tobytes())
                words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, bounds, pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), words.cast(pa.binary())], ["doc_id", "words"])

    return cut(docs.mapInArrow(run, "doc_id long, words binary"))


def read(words: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, codes) of coded texts."""
    offsets = np.cumsum(np.r_[0, pc.binary_length(words).to_numpy().astype(np.int64) // kind.itemsize])
    return offsets, np.frombuffer(b"".join(words.to_pylist()), kind).astype(np.int64)


def fold(texts: DataFrame, kind: np.dtype, rows: int, columns: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all coded texts of a (rows, columns) matrix that work adds to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((rows, columns), np.float32), False
        for batch in batches:
            for part in pieces_of(batch, "words"):
                any_row = True
                work(total, *read(part.column("words"), kind))
        step = max(1, (256 << 10) // (4 * columns))
        if any_row:
            for k in range(0, rows, step):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total[k : k + step].tobytes()], pa.binary())], ["block", "slot", "m"])

    return totals(texts.mapInArrow(run, "block long, slot long, m binary"), texts.rdd.getNumPartitions(), rows, columns)


def decompose(texts: DataFrame, bench: Benchmark, rank: int = RANK, leading: int = LEADING, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(idf, latent) of the buckets: latent (BUCKETS, at most rank) has rows of length one, from the right singular
    vectors of the TF-IDF matrix of all passages of the coded texts; buckets outside the matrix have random directions."""
    spark, kind = texts.sparkSession, bench.kind
    size = texts.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    if texts.rdd.getNumPartitions() > tasks:
        texts = texts.coalesce(tasks)
    width = leading + rank + SPARE
    test = np.random.default_rng(seed).standard_normal((BUCKETS, width)).astype(np.float32)
    to = spark.sparkContext.broadcast(bench.buckets())

    def frequencies(total: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        occurs, many = counted(offsets, to.value[ids], BUCKETS, PASSAGE)
        total[:-1, 0] += occurs
        total[-1, 0] += many

    found = fold(texts, kind, BUCKETS + 1, 1, frequencies).astype(np.float64)[:, 0]
    idf = (np.log((1 + found[-1]) / (1 + found[:-1])) + 0.05).astype(np.float32)
    weight = np.where(found[:-1] <= max(COMMON * found[-1], 10), idf, 0).astype(np.float32)
    # the row of a bucket that is left out is the last one, which is zero
    place = np.append(np.where(weight > 0, np.arange(BUCKETS), BUCKETS), BUCKETS)
    taken = spark.sparkContext.broadcast((place, np.concatenate([test * weight[:, None], np.zeros((1, width), np.float32)])))

    def product(total: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        place, right = taken.value
        gram(offsets, place[to.value[ids]], right, total)

    y = fold(texts, kind, BUCKETS, width, product).astype(np.float64) * weight[:, None]
    values, vectors = np.linalg.eigh((test.T @ y + y.T @ test) / 2)
    good = values > max(values.max(initial=0), 1e-9) * 1e-9
    v, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    v = v[:, s > s.max(initial=0) * 1e-6]
    first = min(leading, v.shape[1] // 2)
    latent = v[:, first : first + rank] if v.shape[1] else test[:, :rank].astype(np.float64)
    none = np.sqrt((latent * latent).sum(1)) < 1e-9
    latent[none] = test[none, : latent.shape[1]]
    return idf, (latent / np.maximum(np.sqrt((latent * latent).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def step_of(size: int) -> int:
    """Words between the starts of windows: a quarter of the size, in whole blocks."""
    return max(BLOCK, size // 4 // BLOCK * BLOCK)


class Search:
    """A part of the benchmark, ready to be looked for in coded texts."""

    def __init__(self, bench: Benchmark, idf: np.ndarray, latent: np.ndarray) -> None:
        of = bench.buckets()
        # the last code stands for no word
        self.vectors = np.concatenate([latent[of] * idf[of][:, None], np.zeros((1, latent.shape[1]), np.float32)])
        self.weight = np.append(idf[of], np.float32(0))
        self.weight[len(bench.terms) :] = 0
        self.item_ids, self.sizes = bench.ids, np.array([len(x) for x in bench.items])
        self.masks = [masks_of(x.tolist()) for x in bench.items]
        self.answers = [(masks_of(a), len(a)) for a in bench.answers]
        self.asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        asked: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, words in enumerate(bench.items):
            m = len(words)
            if m <= SIZES[-1]:
                asked.setdefault(next(s for s in SIZES if s >= m), []).append((k, words))
            else:
                asked.setdefault(SIZES[-1], []).extend((k, words[a : a + SIZES[-1]]) for a in [*range(0, m - SIZES[-1], SIZES[-1]), m - SIZES[-1]])
        for size, own in asked.items():
            has = np.zeros((len(own), FILTER), bool)
            for q, (_, words) in enumerate(own):
                has[q, words % FILTER] = True
            v = np.array([self.vectors[words].sum(0) for _, words in own])
            v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
            least = np.array([SHARED * self.weight[words].sum() for _, words in own], np.float32)
            self.asked[size] = np.ascontiguousarray(v.T), np.array([k for k, _ in own]), has, least

    def candidates(self, offsets: np.ndarray, ids: np.ndarray, most: int = 8192) -> np.ndarray:
        """(text, item, first word in the text, end) columns of the regions around candidate windows, sorted.

        Blocks are summed most at a time, with as many more as the longest window has, so that a text of any length needs as much memory as another.
        """
        n = np.diff(offsets)
        longest = max(self.asked, default=BLOCK) // BLOCK
        blocks = -(-n // BLOCK)
        # empty blocks between the texts, so that no window reaches from one into the next
        wide = blocks + np.maximum(longest // 2, longest - blocks)
        base = np.cumsum(wide) - wide
        total = int(wide.sum()) + longest
        words = np.full((total, BLOCK), len(self.vectors) - 1)
        at = np.arange(len(ids)) - np.repeat(offsets[:-1], n)
        words[np.repeat(base, n) + at // BLOCK, at % BLOCK] = ids
        text = np.append(np.repeat(np.arange(len(n)), wide), np.zeros(longest, np.int64))
        place = np.arange(total) - base[text] if len(n) else np.zeros(total, np.int64)
        left = blocks[text] - place if len(n) else np.zeros(total, np.int64)
        left[total - longest :] = 0
        out = [np.zeros((4, 0), np.int64)]
        for lo in range(0, total - longest, most):
            own = words[lo : min(total, lo + most + longest)]
            many = len(own) - longest
            sums = {1: summed(self.vectors, own)}
            while 2 * max(sums) <= longest:
                k = max(sums)
                sums[2 * k] = sums[k][:-k] + sums[k][k:]
            known = np.append(np.float32(0), np.cumsum(self.weight[own].sum(1), dtype=np.float64))
            for size, (asked, item_of, has, least) in self.asked.items():
                wide = size // BLOCK
                some = (left[lo : lo + many] > 0) & (place[lo : lo + many] % (step_of(size) // BLOCK) == 0)
                some &= (place[lo : lo + many] == 0) | (left[lo : lo + many] > wide // 2)
                # no item's share can be in a window whose benchmark words weigh less
                some &= known[wide : wide + many] - known[:many] >= least.min() - 1e-3
                starts, step = np.flatnonzero(some), max(1, (1 << 21) // len(item_of))
                for k in range(0, len(starts), step):
                    out.append(self._alike(starts[k : k + step], lo, size, sums, words, text, place))
        return np.unique(np.concatenate(out, 1), axis=1)

    def _alike(self, starts: np.ndarray, lo: int, size: int, sums: dict[int, np.ndarray], words: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The regions of the windows of size words at the given blocks, counted from block lo, that have an item's cosine and share."""
        asked, item_of, has, least = self.asked[size]
        wide, at = size // BLOCK, 0
        own = np.zeros((len(starts), asked.shape[0]), np.float32)
        for k in sorted(sums, reverse=True):
            if wide - at >= k:
                own += sums[k][starts + at]
                at += k
        norm = np.sqrt(np.einsum("ij,ij->i", own, own))
        i, j = np.nonzero(own @ asked >= np.maximum(COSINE * norm, 1e-6)[:, None])
        good = [np.zeros(0, np.int64)]
        for k in range(0, len(i), 8192):
            here = words[(lo + starts[i[k : k + 8192]])[:, None] + np.arange(wide)].reshape(-1, size)
            shared = np.where(has[j[k : k + 8192, None], here % FILTER], self.weight[here], 0).sum(1)
            good.append(k + np.flatnonzero(shared >= least[j[k : k + 8192]] * 0.999))
        good = np.concatenate(good)
        block, item = lo + starts[i[good]], item_of[j[good]]
        first, m = place[block] * BLOCK, self.sizes[item]
        return np.stack([text[block], item, np.maximum(0, first - 2 * m), first + size + 2 * m])

    def checked(self, words: np.ndarray, item: int, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int] | None:
        """(words in common order, answer's words) of the best window of 2 m words of the regions that passes, if any."""
        m, own, best = int(self.sizes[item]), self.masks[item], None
        hi = np.maximum.accumulate(hi)
        first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
        for start, end in zip(lo[first], hi[np.append(first[1:], len(hi)) - 1], strict=True):
            region = words[start:end].tolist()
            at = [k for k, t in enumerate(region) if t in own]
            if len(at) < PARAPHRASED * m:
                continue
            b = 0
            # every window of 2 m words: one that starts at no word of the item has no more of them than the next that does
            for a in range(len(at)):
                while b < len(at) and at[b] < at[a] + 2 * m:
                    b += 1
                if b - a < max(PARAPHRASED * m, best[0] if best else 0):
                    continue
                span = [region[k] for k in at[a:b]]
                lcs = common_length(own, m, span)
                if lcs >= PARAPHRASED * m:
                    there = common_length(*self.answers[item], span)
                    if lcs >= COPIED * m or there >= ANSWERED * self.answers[item][1]:
                        best = max(best or (0, 0), (lcs, there))
        return best

    def found(self, offsets: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, words in common order, answer's words) of each text and item that it has a copy of."""
        hits, out = self.candidates(offsets, ids), []
        if hits.shape[1]:
            starts = np.flatnonzero(np.r_[True, (hits[:2, 1:] != hits[:2, :-1]).any(0)])
            for s, e in zip(starts, np.append(starts[1:], hits.shape[1]), strict=True):
                text, item = int(hits[0, s]), int(hits[1, s])
                best = self.checked(ids[offsets[text] : offsets[text + 1]], item, hits[2, s:e], hits[3, s:e])
                if best:
                    out.append((text, item, *best))
        return out


def searches(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Benchmark, Search, DataFrame]]:
    """Each part of the benchmark with its search and the coded texts."""
    found = None
    for bench in parts_of(benchmark):
        texts = code(docs, bench)
        found = found or decompose(texts, bench)
        yield bench, Search(bench, *found), texts


SCHEMA = "doc_id long, item_id long, lcs_words long, item_words long, answer_words long, answer_found long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs_words, item_words, answer_words, answer_found), a row for each text and benchmark item that it has a copy or paraphrase of.

    Every text is read whole. Null and empty texts match nothing, nor do items
    without a word; repeated rows of docs give repeated rows; repeated items count once. An empty benchmark
    or an empty table gives no rows. Other columns are not read.
    """
    spark, docs = docs.sparkSession, texts_of(docs)
    small_batches(spark)
    out = None
    for bench, search, texts in searches(docs, benchmark):
        some = texts.mapInArrow(_finder(spark, bench, search), SCHEMA)
        out = some if out is None else out.union(some)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _finder(spark: SparkSession, bench: Benchmark, search: Search) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shipped, kind = spark.sparkContext.broadcast(search), bench.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for part in pieces_of(batch, "words", 2_000_000):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[t], own.item_ids[k], lcs, int(own.sizes[k]), own.answers[k][1], there) for t, k, lcs, there in own.found(*read(part.column("words"), kind))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, ["doc_id", "item_id", "lcs_words", "item_words", "answer_words", "answer_found"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose own text has a copy or paraphrase of an item; all columns stay as they are.

    The verdict is computed beside each row, so that null and repeated ids don't matter and nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema, text, out = docs.schema, docs.columns.index("text"), docs
    for bench, search, _ in searches(texts_of(docs), benchmark):
        shipped, names = spark.sparkContext.broadcast(search), spark.sparkContext.broadcast(list(bench.terms))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, names=names) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            known = pa.array(names.value, pa.large_string())
            for batch in batches:
                good, at = np.ones(batch.num_rows, bool), 0
                for part in pieces_of(pa.RecordBatch.from_arrays([batch.column(text)], ["text"]), "text", 6_000_000):
                    for hit in shipped.value.found(*coded(part.column("text"), known)):
                        good[at + hit[0]] = False
                    at += part.num_rows
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(run, schema)
    return out
