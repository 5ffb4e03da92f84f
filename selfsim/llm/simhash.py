"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints.

A fingerprint is the majority vote of the XXH64 hashes of a text's word shingles.
Distinct fingerprints are dealt to the leaves of vantage-point trees whose vantage
points come from a bounded sample. The bits are split into blocks with a tree for each: of
two fingerprints within the radius r, some one of b blocks differs in r // b bits at most, so that
in its tree a fingerprint need only visit the leaves that the triangle inequality cannot
rule out for r // b. With r + 1 blocks that is one leaf a tree, and the rows dealt are
r + 1 for each fingerprint however deep the trees; one tree over all bits (blocks = 1)
would deal about 1.55 times as many with each level, as random fingerprints lie close to 32 bits apart.
Within a leaf a further tree over all bits prunes by the whole radius, and the leaf returns
a spanning forest of its links, not all pairs. Components are then joined by
label propagation with pointer jumping.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selfsim.llm.common import cut, pieces_of, small_batches, stored, texts_of

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text; 0 for null and for texts without a word.

    Ties (a bit set in exactly half the shingles) give 0; repeated shingles count each time.
    """
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    joined, n = b" ".join(w), len(w)
    if n <= words:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    b = h.view(np.uint8).reshape(-1, 8)
    if len(b) < 400:
        counts = np.unpackbits(b, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(b[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def digest_of(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, fp), with digest also the text's: fp is the fingerprint's 64 bits as a signed long. One row for each row of docs."""
    small_batches(docs.sparkSession)
    rows = texts_of(docs, key, text)
    rows, more = (rows.withColumn("digest", digest_of("text")), ["digest"]) if digest else (rows, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                fp = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), *map(part.column, more)], ["doc_id", "fp", *more])

    return rows.mapInArrow(run, "doc_id long, fp long" + (", digest binary" if digest else ""))


@dataclass
class Router:
    """A binary vantage-point tree in heap order: node i has the children 2i + 1 (d <= mu) and 2i + 2."""

    points: np.ndarray
    mu: np.ndarray
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> Router:
        """Median splits of a sample of fingerprints (uint64); of some candidates the one with the widest spread becomes the vantage point."""
        points, mu = np.zeros(2**depth - 1, np.uint64), np.zeros(2**depth - 1, np.int64)
        members = {0: np.sort(sample)}
        for i in range(2**depth - 1):
            own = members.pop(i, np.zeros(0, np.uint64))
            if len(own):
                tries = own[:: max(1, len(own) // 8)][:8]
                d = np.bitwise_count(own[None, :] ^ tries[:, None]).astype(np.int64)
                k = int(np.argmax(d.std(axis=1)))
                points[i], mu[i] = tries[k], int(np.median(d[k]))
                members[2 * i + 1], members[2 * i + 2] = own[d[k] <= mu[i]], own[d[k] > mu[i]]
        return cls(points, mu, depth)

    def route(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) of the home leaf of each fingerprint and of each later leaf that may hold one within the radius."""
        row, node, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(fp[row] ^ self.points[node]).astype(np.int64)
            near, mu = d <= self.mu[node], self.mu[node]
            left, right = d - radius <= mu, d + radius > mu
            row = np.concatenate([row[left], row[right]])
            home = np.concatenate([(home & near)[left], (home & ~near)[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        leaf = node - (2**self.depth - 1)
        own = np.zeros(len(fp), np.int64)
        own[row[home]] = leaf[home]
        keep = leaf >= own[row]
        return row[keep], leaf[keep], home[keep]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs (a, b) of rows; a label is the smallest row of its class."""
    a, b = labels[a], labels[b]
    while len(a):
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        labels, a, b = parent[labels], parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    return labels


def leaf_labels(fp: np.ndarray, home: np.ndarray, radius: int, block: int = 1 << 20, least: int = 192) -> np.ndarray:
    """Classes under links of at most radius bits with one end at home: for each row the smallest row of its class.

    Rows that are known to be of one class aren't compared with each other, so that a dense
    group of near copies costs little more than finding that it is one.
    """
    labels, pairs, waiting = np.arange(len(fp)), [], 0
    stack = [(np.flatnonzero(home), np.arange(len(fp)))]
    while stack:
        own, ask = stack.pop()
        if len(own) and (labels[own] == labels[own[0]]).all():
            ask = ask[labels[ask] != labels[own[0]]]
        if not len(own) or not len(ask):
            continue
        if len(own) > least:
            v = fp[own[len(own) // 2]]
            d = np.bitwise_count(fp[own] ^ v).astype(np.int64)
            mu = int(np.median(d))
            if (d > mu).any():
                q = np.bitwise_count(fp[ask] ^ v).astype(np.int64)
                stack += [(own[d <= mu], ask[q - radius <= mu]), (own[d > mu], ask[q + radius > mu])]
                continue
        step = max(1, block // len(own))
        for k in range(0, len(ask), step):
            some = ask[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[own][None, :]) <= radius)
            different = labels[some[i]] != labels[own[j]]
            pairs.append((some[i[different]], own[j[different]]))
            waiting += int(different.sum())
            if waiting > max(1024, len(fp) // 8):
                labels, pairs, waiting = join_labels(labels, *map(np.concatenate, zip(*pairs, strict=True))), [], 0
    return join_labels(labels, *map(np.concatenate, zip(*pairs, strict=True))) if pairs else labels


def masks_of(blocks: int) -> list[np.uint64]:
    """The bits of each block of a 64-bit fingerprint."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    return [np.uint64((1 << hi) - (1 << lo)) for lo, hi in zip(ends, ends[1:], strict=False)]


def run_labels(fp: np.ndarray, block: np.ndarray, radius: int, small: int = 16) -> np.ndarray:
    """Classes under links of at most radius bits between fingerprints that agree in block, by which they are sorted."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    run, labels = np.repeat(np.arange(len(first)), size), np.arange(n)
    for k in range(1, min(small, n)):
        i = np.flatnonzero((run[k:] == run[:-k]) & (size[run[k:]] <= small))
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= radius]
        labels = join_labels(labels, i, i + k)
    for at, many in zip(first[size > small].tolist(), size[size > small].tolist(), strict=True):
        labels[at : at + many] = at + leaf_labels(fp[at : at + many], np.ones(many, bool), radius)
    return labels


def links(nodes: DataFrame, radius: int = 3, leaf_rows: int = 8192, sample_rows: int = 65536, least_depth: int = 2, most_depth: int = 14, blocks: int | None = None) -> DataFrame:
    """(a, b): spanning links between the fingerprints of nodes (fp, distinct) that are within the radius of each other.

    Every pair within the radius is compared in some leaf, so connected components over
    the result equal those over all pairs. The driver gets sample_rows fingerprints at most, and trees of 2^most_depth leaves at most.
    """
    blocks = radius + 1 if blocks is None else blocks
    masks, reach = masks_of(blocks), radius // blocks
    n = nodes.count()
    sample = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = min(most_depth, max(least_depth, math.ceil(math.log2(max(1, n) / leaf_rows))))
    shipped = nodes.sparkSession.sparkContext.broadcast([Router.fit(sample & m, depth) for m in masks])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for k in range(0, len(fp), 4096):
                some = fp[k : k + 4096]
                for tree, router in enumerate(shipped.value):
                    row, leaf, home = router.route(some.view(np.uint64) & masks[tree], reach)
                    for s in range(0, len(row), 65536):
                        at = slice(s, s + 65536)
                        yield pa.RecordBatch.from_arrays([pa.array(leaf[at] * blocks + tree), pa.array(some[row[at]]), pa.array(home[at])], ["leaf", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        fp, home = group.column("fp").to_numpy().view(np.uint64), group.column("home").to_numpy()
        block = fp & masks[group.column("leaf")[0].as_py() % blocks]
        order = np.lexsort((fp, block))
        fp, home, block = fp[order], home[order], block[order]
        labels = leaf_labels(fp, home, radius) if reach else run_labels(fp, block, radius)
        linked, ids = labels != np.arange(len(labels)), fp.view(np.int64)
        return pa.table({"a": ids[linked], "b": ids[labels[linked]]})

    dealt = nodes.select("fp").mapInArrow(deal, "leaf long, fp long, home boolean")
    return dealt.groupBy("leaf").applyInArrow(search, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, label): for each end of an edge (a, b) the smallest node that it is connected to.

    Rounds of neighbour minima and pointer jumping, each cut by a checkpoint, until none changes.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        told = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label").union(labels)
        least = told.groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(least.join(up, "label", "left").select("node", F.least("label", "next").alias("label")))
        old = labels.withColumnRenamed("label", "old")
        changed = new.join(old, "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def classes_of(fp: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, class): each distinct fingerprint of fp with the smallest one that it reaches over links of at most radius bits."""
    nodes = cut(fp.select("fp").distinct())
    labels = components(links(nodes, radius))
    return nodes.join(labels, nodes.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("class"))


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    component_id is the smallest doc_id that the row reaches over links of at most
    radius differing bits. Null and word-less texts have fingerprint zero, which
    links as any other. A row with a null doc_id is kept, links others as any row does, and has their
    component_id; only where no row of a class has an id is it null. Repeated rows stay. Other columns are not read.
    """
    fp = cut(fingerprints(docs, words, key, text))
    classes = cut(classes_of(fp, radius))
    least = fp.groupBy("fp").agg(F.min("doc_id").alias("id")).join(classes, "fp")
    named = classes.join(least.groupBy("class").agg(F.min("id").alias("component_id")), "class").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """docs without near-duplicates: of each class one row stays, that with the smallest doc_id (null last), among these the smallest digest of its text.

    A row that is repeated with its id and text stays once. What goes is told by (id, digest); rows are shuffled once to meet it.
    """
    both = [F.col("doc_id").cast("long").alias("_id"), digest_of("text").alias("_digest")]
    fp = cut(fingerprints(docs, words, digest=True))
    rows = cut(fp.join(classes_of(fp, radius), "fp").groupBy("class", "doc_id", "digest").agg(F.count("*").alias("n")))
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("x"))
    told = rows.join(first, "class").select("doc_id", "digest", "n", (F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & F.col("digest").eqNullSafe(F.col("x.digest"))).alias("stays"))
    told = stored(told.where("not stays or n > 1"))
    same = F.col("_id").eqNullSafe(F.col("doc_id_")) & F.col("_digest").eqNullSafe(F.col("digest_"))
    # one shuffle of the rows at any size: what goes is as many rows as the copies, too many to broadcast in a large corpus
    keys = lambda df: df.select(F.col("doc_id").alias("doc_id_"), F.col("digest").alias("digest_")).hint("shuffle_hash")
    some = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *both).join(keys(told.where("not stays")), same, "left_anti")
    if not told.where("stays").isEmpty():
        again = keys(told.where("stays"))
        some = some.join(again, same, "left_anti").unionByName(some.join(again, same, "left_semi").dropDuplicates(["_id", "_digest"]))
    return some.select("_row.*")
