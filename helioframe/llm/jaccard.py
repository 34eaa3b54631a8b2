"""Exact join of documents whose sets of word shingles have a Jaccard similarity of at least 4/5.

The Jaccard distance is a metric, and this is a metric-space join: regions around pivots, boundary documents
kept in a region by the triangle inequality, regions joined recursively.

First level. The pivots are single shingles. A document's distance to {s} is 1 - 1/n if it holds s and 1 if
not, so its nearest pivots are its own shingles; ties follow one global order, the shingles that many documents
share last, then the hash. Two sets of n and m shingles that are near share at least 4 (n + m) / 9, hence one
of the first n - ceil(4 n / 5) + 1 of each: every document is replicated into that many regions and no other.
The first shingle that two near sets have in common lies, in the smaller set, among its first n / 9 + 1: what
follows could not suffice otherwise. A region where no set holds the pivot that early is dropped, and so are the
later holders that could only be near sets smaller than every early one. Of regions with the same sets the first in
the order is kept.

Most shingles are in one document only. Which ones are in several is counted first; a bitmap of these (``MEETING_WORDS``
words, whatever the size of the input) keeps most others from being shuffled with their documents.

Small regions (up to ``LEAF`` sets) are joined directly: pairs whose sizes and places of the pivot allow it are
compared, first by signatures. A signature says for each of ``SIGNATURE`` bits whether an odd number of shingles falls
on it; where two differ in k bits, at least k shingles are in one set alone, and near sets have at most (n + m) / 9 of
these. What passes is compared exactly. Larger regions are split around a document, the member that holds the fewest rare shingles before
the region's own: in a group of near copies it lies in the middle. With the exact distances d(x, p) of all members to
the pivot p, members within 1/5 are linked to it and take its label; a region whose members all have one label is
done; of the most frequent label only members stay for which |d(x, p) - d(y, p)| <= 1/5 for some y outside (the
triangle window). The pivot leaves, the next one is a member with another label, and so on until the region is small
or done. A group of near copies takes one or two rounds with one comparison per member, however large it is. What
``ROUNDS`` pivots leave is divided anew: the sets that are left get single-shingle pivots of their own, in the order of the
exact number of sets left that hold a shingle, whatever its place. What all of them share comes last, so pages of one
template that differ by more than 1/5 meet nowhere. Pairs in these regions are compared like those of small ones, but
for pairs that the links found so far connect; Spark splits a region that is large then.

Equal sets are one node throughout, known by a 64-bit fingerprint of the set (two of 10^8 different sets agree
with probability 3 in 10^4).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.components import components
from helioframe.llm.text import MULTIPLIERS, Texts, mix, ready, slices
from helioframe.session import merged, persist_table

SHINGLE = 5
FREQUENT = 32              # sets that share a shingle from which it counts as frequent
FREQUENT_LIMIT = 1 << 20   # most frequent shingles moved to the end of the order: 8 MB sent to each task
REACH = 1.5                # how far beyond its first shingles a document is looked at for frequent ones
MEETING_WORDS = 1 << 20    # 64-bit words of the bitmap of shared shingles: 8 MB sent to each task; false hits cost work only
SIGNATURE = 1024           # bits
LEAF = 32
ROUNDS = 3                 # pivots a large region is split around before its rest is divided anew


def first_count(n: int) -> int:
    """How many of the first of n shingles meet every near set."""
    return n - (4 * n + 4) // 5 + 1


def sets_of(run: Texts) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; the words of a shorter text as one; none without words."""
    words = run.words(lower=True)
    hashes, _, text = run.windows(words, SHINGLE)
    borders = np.searchsorted(text, np.arange(run.n + 1))
    out = []
    for k in range(run.n):
        n = int(run.n_words[k])
        if n >= SHINGLE:
            out.append(np.unique(hashes[borders[k]:borders[k + 1]].view(np.int64)))
        elif n:
            own = words[run.word_borders[k]:run.word_borders[k + 1]]
            total = (own * MULTIPLIERS[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([total], dtype=np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out


def fingerprint(shingles: np.ndarray) -> int:
    scattered = mix(shingles.view(np.uint64))
    total = np.array([scattered.sum(dtype=np.uint64) ^ np.uint64(len(shingles))], dtype=np.uint64)
    return int(mix(total).view(np.int64)[0])


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of shingles falls on it, as 64-bit words."""
    odd = np.bincount((shingles.view(np.uint64) >> np.uint64(40)).astype(np.int64) % SIGNATURE, minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, node."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for run in slices(batch.column(1)) for s in sets_of(run)]
            nodes = pa.array([fingerprint(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), nodes], names=["doc_id", "n_shingles", "node"])

    rows = _texts(docs, key, text)
    return rows.mapInArrow(step, "doc_id bigint, n_shingles bigint, node bigint")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("_text"))


def frequent_shingles(shingles: DataFrame) -> np.ndarray:
    """The most frequent of the values ``h``, at most ``FREQUENT_LIMIT``, the rarest first.

    Any list gives the same links; a longer one makes smaller regions.
    """
    counts = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FREQUENT)
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT_LIMIT).toArrow()
    h, n = top["h"].to_numpy(), top["n"].to_numpy()
    return h[np.lexsort((h, n))]


def first_shingles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """h of the first shingles of every document, ``REACH`` times as many as meet every near set."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch.column(1)):
                heads = [s[:int(REACH * first_count(len(s)))] for s in sets_of(run) if len(s)]
                if heads:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads))], names=["h"])

    return _texts(docs, key, text).mapInArrow(step, "h bigint")


class Order:
    """The global order of shingles: those outside the list ``frequent`` by hash, then the list."""

    def __init__(self, frequent: np.ndarray):
        self.place = np.argsort(frequent)
        self.known = frequent[self.place]

    def __call__(self, found: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return found
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        often = self.known[at] == found
        return np.concatenate([found[~often], found[often][np.argsort(self.place[at[often]])]])


HEADS = "node bigint, n bigint, heads array<bigint>, signature array<bigint>"


def _heads(nodes: list[int], sets: list[np.ndarray], order: Order) -> pa.RecordBatch:
    heads = [order(s)[:first_count(len(s))] for s in sets]
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(heads)))
    marks = np.concatenate([signature(s) for s in sets])
    words = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (SIGNATURE // 64), pa.int32()), pa.array(marks))
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists, words], names=["node", "n", "heads", "signature"])


def postings(docs: DataFrame, frequent: np.ndarray, key: str, text: str) -> DataFrame:
    """node, n, heads (the first shingles of the set in the global order), signature."""
    order = Order(frequent)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sets = [], []
            for run in slices(batch.column(1)):
                for found in sets_of(run):
                    if not len(found):
                        continue
                    node = fingerprint(found)
                    if node in seen:        # a copy of a set this task has given already
                        continue
                    seen.add(node)
                    if len(seen) > 200_000:
                        seen = set()
                    nodes.append(node)
                    sets.append(found)
            if nodes:
                yield _heads(nodes, sets, order)

    return _texts(docs, key, text).mapInArrow(step, HEADS)


def divided_anew(sets: DataFrame) -> DataFrame:
    """As ``postings`` of the sets given, in the order of how many of these sets hold a shingle."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(found.as_buffer(), dtype=np.int64))], names=["h"])

    order = Order(frequent_shingles(sets.select("shingles").mapInArrow(explode, "h bigint")))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [np.frombuffer(s.as_buffer(), dtype=np.int64) for s in batch.column(1)]
                yield _heads(batch.column(0).to_pylist(), found, order)

    return sets.select("node", "shingles").mapInArrow(step, HEADS)


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """``MEETING_WORDS`` words with a bit set for each value of the column ``h``."""
    word = F.expr(f"(h >> 6) & {MEETING_WORDS - 1}").alias("word")
    found = hashes.groupBy(word).agg(F.expr("bit_or(1L << int(h & 63))").alias("bits")).toArrow()
    bitmap = np.zeros(MEETING_WORDS, dtype=np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bitmap


def hits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each value is set: always for those the bitmap was made of, and for few others."""
    return (bitmap[(h >> 6) & (MEETING_WORDS - 1)] >> (h & 63) & 1).astype(bool)


def meeting(heads: DataFrame, shared: DataFrame) -> DataFrame:
    """h, node, n, at of the first shingles that are in the table ``shared``, and of few others."""
    bitmap = bitmap_of(shared)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = batch.column(2).flatten().to_numpy(), pa.compute.list_value_length(batch.column(2)).to_numpy()
            kept = np.flatnonzero(hits(bitmap, h))
            row = np.repeat(np.arange(len(counts)), counts)[kept]
            at = kept - (np.cumsum(counts) - counts)[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[kept]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at, pa.int64())],
                names=["h", "node", "n", "at"])

    return heads.select("node", "n", "heads").mapInArrow(step, "h bigint, node bigint, n bigint, at bigint")


def shared_regions(heads: DataFrame) -> DataFrame:
    """h, node, n, at (place of h in the set's order) and size of the regions where near sets can meet first."""
    rows = heads.select(F.posexplode("heads").alias("at", "h"), "node", "n")
    early = F.when(9 * F.col("at") <= F.col("n"), F.col("n"))
    both = rows.groupBy("h").agg(F.count(F.lit(1)).alias("holders"), F.min(early).alias("least"))
    both = both.filter("holders > 1 and least is not null").select("h", "least")
    both = persist_table(both, "shared")
    kept = meeting(heads, both).join(both, "h").filter("9 * at <= n or 5 * n - 9 * at >= 4 * least")
    kept = persist_table(kept.select("h", "node", "n", "at").distinct(), "regions")
    # the same sets in the same order of pivots: the region with the smaller places comes first
    alike = kept.groupBy("h").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.sum("at").alias("place")).filter("size > 1")
    one = alike.groupBy("size", "x", "y").agg(F.min_by("h", F.struct("place", "h")).alias("h")).select("h", "size")
    return kept.join(one, "h")


def sets_for(docs: DataFrame, needed: DataFrame, owners: DataFrame, key: str, text: str) -> DataFrame:
    """node, n, shingles of the nodes needed, from one document each."""
    wanted = persist_table(owners.join(needed, "node"), "wanted")
    rows = _texts(docs, key, text)
    ids = wanted.select(F.col("owner").alias("_owner")).distinct()
    rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_owner")), "left_semi")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for run in slices(batch.column(1)) for s in sets_of(run) if len(s)]
            if found:
                yield pa.RecordBatch.from_arrays([
                    pa.array([fingerprint(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()),
                    pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "n", "shingles"])

    every = rows.mapInArrow(step, "node bigint, n bigint, shingles binary")
    return every.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``shared``, n and m to pairs a, b: shingles in common and the sizes. Only sets that are asked for move."""
    left = sets.select(F.col("node").alias("a"), "n", F.col("shingles").alias("left"))
    right = sets.join(pairs.select(F.col("b").alias("node")), "node", "left_semi").select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("shingles").alias("right"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n", "m", "left", "right")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), dtype=np.int64), np.frombuffer(y.as_buffer(), dtype=np.int64), assume_unique=True))
                for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(shared, pa.int64())], names=["a", "b", "n", "m", "shared"])

    return rows.mapInArrow(step, "a bigint, b bigint, n bigint, m bigint, shared bigint")


NEAR = "9 * shared >= 4 * (n + m)"
#: 1/5 with room for rounding: a wider window only keeps more
TAU = 0.2 + 1e-9


def region_pairs(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """a < b of different labels that can be near and have their first common shingle here: what follows it in both sets
    has to suffice, and their signatures must not rule it out. The signatures go with the sets into the region, so that
    pairs they rule out are never rows.
    """
    marks = heads.select("node", "signature").join(rows.select("node"), "node", "left_semi").dropDuplicates(["node"])
    reach = F.expr("5 * n - 9 * at")      # 4 times the largest size of a near set
    marked = rows.select("h", "node", "n", reach.alias("reach"), "label").join(marks, "node")
    x = marked.select("h", F.col("node").alias("a"), F.col("n").alias("x_n"), F.col("reach").alias("x_reach"), F.col("label").alias("x_label"), F.col("signature").alias("x"))
    y = marked.select("h", F.col("node").alias("b"), F.col("n").alias("y_n"), F.col("reach").alias("y_reach"), F.col("label").alias("y_label"), F.col("signature").alias("y"))
    apart = " + ".join(f"bit_count(x[{k}] ^ y[{k}])" for k in range(SIGNATURE // 64))
    fits = f"a < b and x_label <> y_label and 4 * y_n <= x_reach and 4 * x_n <= y_reach and 9 * ({apart}) <= x_n + y_n"
    return x.join(y, "h").filter(fits).select("a", "b").distinct()


def with_labels(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """h, node, n, at, label: the component of the node so far, or itself."""
    named = rows.select("h", "node", "n", "at").join(linked, "node", "left")
    return named.withColumn("label", F.coalesce("label", "node"))


def join_large_regions(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Edges found around pivots, the rows of regions that have become small, and those still large after ``ROUNDS`` pivots."""
    active = persist_table(rows.select("h", "node", "n", "at").withColumns({"label": F.col("node"), "outside": F.lit(True)}), "large-regions")
    edges: DataFrame | None = None
    small: DataFrame | None = None
    turn = 0
    while True:
        if turn:
            sizes = active.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
            sized = persist_table(active.join(merged(sizes), "h"), "left-regions")
            part = sized.filter(F.col("size") <= LEAF).select("h", "node", "n", "at", "label")
            small = part if small is None else small.union(part)
            active = sized.filter(F.col("size") > LEAF).drop("size")
        if active.isEmpty():
            return edges, small, None
        if turn == ROUNDS:
            return edges, small, active
        turn += 1
        pivots = active.filter("outside").groupBy("h").agg(F.min_by("node", F.struct("at", "node")).alias("pivot"))
        met = persist_table(active.drop("outside").join(merged(pivots), "h").filter("node <> pivot"), "pivoted-regions")
        pairs = persist_table(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
        measured = persist_table(distances(pairs, sets), "distances")
        found = measured.filter(NEAR).select("a", "b")
        edges = found if edges is None else edges.union(found)
        d = measured.select(
            F.col("a").alias("node"), F.col("b").alias("pivot"), F.expr(NEAR).alias("near"),
            (1 - F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("d"))
        # equal labels mean linked, directly or through a pivot that has left
        rest = met.join(d, ["node", "pivot"]).withColumn("label", F.when(F.col("near"), F.col("pivot")).otherwise(F.col("label")))
        rest = persist_table(rest.select("h", "node", "n", "at", "label", "d"), "measured-regions")
        by_label = rest.groupBy("h", "label").agg(F.count(F.lit(1)).alias("members"), F.min("d").alias("low"), F.max("d").alias("high"),
            F.min("n").alias("least"), F.max(F.expr("5 * n - 9 * at")).alias("reach"))
        largest = by_label.groupBy("h").agg(F.max_by("label", "members").alias("main"))
        window = by_label.join(largest, "h").filter(F.col("label") != F.col("main")).groupBy("h", "main").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("reach").alias("reach"))
        kept = rest.join(window, "h").withColumn("outside", F.col("label") != F.col("main"))
        fits = F.expr("4 * n <= reach and 4 * least <= 5 * n - 9 * at") & F.col("d").between(F.col("low") - TAU, F.col("high") + TAU)
        kept = kept.filter(F.col("outside") | fits)
        active = persist_table(kept.select("h", "node", "n", "at", "label", "outside"), "large-regions")


def classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (doc_id, n_shingles, node), stored, and per node its smallest doc_id (``owner``) and component."""
    ready(docs.sparkSession)
    prints = persist_table(fingerprints(docs, key, text), "fingerprints")
    heads = persist_table(postings(docs, frequent_shingles(first_shingles(docs, key, text)), key, text), "heads")
    regions = persist_table(shared_regions(heads), "sized-regions")
    small, large = regions.filter(F.col("size") <= LEAF), regions.filter(F.col("size") > LEAF)
    pairs = persist_table(region_pairs(small.withColumn("label", F.col("node")), heads), "pairs-met")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    owners = prints.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("owner"))
    sets = persist_table(sets_for(docs, nodes, owners, key, text), "sets")
    edges, left, still = join_large_regions(large, sets)
    found = distances(pairs, sets).filter(NEAR).select("a", "b")
    linked = components(found if edges is None else edges.union(found))
    if left is not None:
        # what links already connect, in whatever region, need not be compared again
        linked = persist_table(linked, "linked")
        met = region_pairs(persist_table(with_labels(left, linked), "small-regions"), heads)
        if still is not None:
            rest = sets.join(still.select("node").distinct(), "node", "left_semi")
            anew = persist_table(divided_anew(rest), "heads-anew")
            again = persist_table(with_labels(shared_regions(anew), linked), "regions-anew")
            met = met.union(region_pairs(again, anew)).distinct()
        more = persist_table(met, "pairs-left-met")
        found = distances(more, sets).filter(NEAR).select("a", "b")
        linked = components(linked.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found))
    return prints, owners.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of every row.

    Null, empty and blank texts have no shingle and no link. Rows with equal ids are rows of their own; a null id
    is passed over in the minimum, and a component of null ids has a null id. Very long texts are sets like others.
    Other columns are not read; an empty table gives no rows.
    """
    prints, own = classes(docs, key, text)
    smallest = own.groupBy("label").agg(F.min("owner").alias("component_id"))
    named = own.join(smallest, "label").select("node", "component_id")
    rows = prints.join(named, "node", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, one of each component: that with the smallest id.

    Of several rows with this id and an equal set one stays; rows without a shingle all stay. What goes is a table of
    ids and fingerprints; the documents are joined to it once.
    """
    prints, own = classes(docs, key, text)
    own = persist_table(own, "classes")
    chosen = own.groupBy("label").agg(F.min(F.struct(F.col("owner").isNull().alias("last"), "owner", "node"))["node"].alias("chosen"))
    staying = own.join(chosen, F.col("node") == F.col("chosen"), "left_semi").select(F.col("node").alias("_node"), "owner")
    rows = prints.filter("n_shingles > 0").groupBy("doc_id", "node").count()
    stays = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    asked = rows.join(staying, stays, "left").withColumn("goes", F.col("_node").isNull()).filter("goes or count > 1")
    asked = persist_table(asked.select("doc_id", "node", "goes"), "gone-or-repeated")
    gone = asked.filter("goes").select(F.col("doc_id").alias("_gone_id"), F.col("node").alias("_gone"))
    repeated = asked.filter("not goes").select(F.col("doc_id").alias("_twice_id"), F.col("node").alias("_twice"))

    # few documents share an id with one that goes or is there twice: only these are read for their sets and joined
    bitmap = bitmap_of(asked.select(F.xxhash64("doc_id").alias("h")))
    names = [f"_d_{c}" for c in docs.columns]
    place = docs.columns.index(text)
    plain = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    hashed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.xxhash64(F.col(f"`{key}`").cast("bigint")).alias("_id_hash"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~hits(bitmap, batch.column(len(names)).to_numpy())))
            yield pa.RecordBatch.from_arrays(rest.columns[:-1], names=names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(hits(bitmap, batch.column(len(names)).to_numpy())))
            found = [s for run in slices(rest.column(place).cast(pa.binary())) for s in sets_of(run)]
            nodes = pa.array([fingerprint(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*rest.columns[:-1], nodes], names=[*names, "_node"])

    marked = hashed.mapInArrow(step, f"{plain}, _node bigint")
    kept = marked.join(gone, F.col(f"_d_{key}").cast("bigint").eqNullSafe(F.col("_gone_id")) & (F.col("_node") == F.col("_gone")), "left_anti")
    if not repeated.isEmpty():
        same = F.col(f"_d_{key}").cast("bigint").eqNullSafe(F.col("_twice_id")) & (F.col("_node") == F.col("_twice"))
        once = kept.join(repeated, same, "left_semi").dropDuplicates([f"_d_{key}", "_node"])
        kept = kept.join(repeated, same, "left_anti").union(once)
    kept = kept.drop("_node").union(hashed.mapInArrow(others, plain))
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
