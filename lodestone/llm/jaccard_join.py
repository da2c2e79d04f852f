"""Exact similarity join of documents by the Jaccard distance of their word shingles, in metric space.

The distance 1 - |x & y| / |x | y| is a metric, and two documents link when it is
at most 0.1. Documents with equal sets are one node. Almost all pairs of texts are
at distance 1, or nearly, from each other, so regions around pivots picked
anywhere would each hold everything. Pivots are picked where texts can be close:

1. Rings around the empty set: the size of a set is its distance from the empty
   set in symmetric difference, so by the triangle inequality partners have sizes
   in one ring or the next, and each document stands in two rings.
2. In a ring at most k elements differ between partners. The elements are dealt by
   hash into m > k segments, so partners have m - k equal segments at least. Nodes
   with an equal segment meet, and the least of them is their pivot: a region is a
   pivot and all nodes that meet it, and every pair that can link is in a region.
3. Regions are narrowed by parity sketches: bit j is the parity of the elements that hash
   to j, so sketches differ in no more bits than sets do in elements. Nodes that this
   bound leaves connected stay together, under the least of them.
4. In a region each node's distance from the pivot is computed. Nodes within 0.1
   are linked. Others are compared where the windows of the triangle inequality
   (distances from the pivot that differ by 0.1 at most) leave a link possible.
   Regions beyond a bound are cut into blocks, and split by further pivots, round by
   round, until each node outside the largest component has been a pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import written

#: Words in a shingle.
WORDS = 3
#: Two sets link when num * |x & y| >= den * |x | y|.
NUM, DEN = 100, 90
#: A region up to these many nodes and shingles is joined in one task; larger ones are cut into blocks of as many nodes.
REGION_NODES, REGION_SHINGLES = 256, 1_000_000
#: Words of 64 bits in the least parity sketch, and nodes and bytes of a block when a region is narrowed by sketches.
LEAST_SKETCH, NARROW_NODES, NARROW_BYTES = 8, 8192, 32 << 20
#: Pivots of the first round in a large region; each round takes eight times as many.
FIRST_PIVOTS = 256
#: Rows (a long and two ids) that may be broadcast; beyond it texts are fetched by a shuffle.
BROADCAST_ROWS = 500_000


def strong_size(num: int, den: int) -> int:
    """Elements below which a segment is weak: weak ones are used only by documents that have too few others."""
    return 3 if 10 * (num - den) <= num else 2


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and where each begins.

    A text of fewer words is one shingle; a text without words has none.
    """
    raw = ts.LOWER[raw]
    starts, stops, first = ts.words(raw, offsets, ts.SPACED_WORD)
    hashes = ts.span_hashes(ts.prefix_hashes(raw), starts, stops)
    owner = ts.owners(first)
    n = len(offsets) - 1
    grams = ts.gram_hashes(hashes, n_words)
    whole = owner[: len(grams)] == owner[len(hashes) - len(grams) :]
    keys, of = [grams[whole]], [owner[: len(grams)][whole]]
    size = np.diff(first)
    for few in range(1, n_words):
        at = first[:-1][size == few]
        if len(at):
            keys.append(ts.mix(ts.gram_hashes(hashes, few)[at] + np.uint64(few)))
            of.append(owner[at])
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    keys, of = keys[new], of[new]
    return keys, np.searchsorted(of, np.arange(n + 1))


def nodes_of(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; equal sets have equal names, the empty set has 0."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ts.mix(keys ^ np.uint64(0x5851F42D4C957F2D)))))
    total = ts.mix((sums[first[1:]] - sums[first[:-1]]) ^ ts.mix(np.diff(first).astype(np.uint64)))
    total[np.diff(first) == 0] = 0
    return total


def sketches(keys: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: a power of two of bits, one for each element at least.

    Halves of a sketch, one xor the other, are the sketch of half the size.
    """
    size = np.diff(first)
    n_words = np.maximum(LEAST_SKETCH, 1 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(n_words)))
    of = np.repeat(np.arange(len(size)), size)
    spread = ts.mix(keys ^ np.uint64(0x632BE59BD9B4E019))
    words = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(words, base[of] + ((spread >> np.uint64(6)).astype(np.int64) & (n_words[of] - 1)), np.uint64(1) << (spread & np.uint64(63)))
    return [words[a:b].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)]


class Rings:
    """Bounds of the rings: a partner of a set in ring j is in ring j - 1, j or j + 1."""

    def __init__(self, num: int = NUM, den: int = DEN) -> None:
        self.num, self.den, self.bounds = num, den, [1]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while len(sizes) and self.bounds[-1] <= sizes.max() * self.num // self.den + 2:
            self.bounds.append(self.bounds[-1] * self.num // self.den + 1)
        return np.searchsorted(np.array(self.bounds), sizes, side="right") - 1

    def apart(self, ring: int) -> int:
        """Most elements in which linked sets differ, of ring - 1 both, or of ring - 1 and ring."""
        below = self.bounds[ring] - 1
        above = self.bounds[ring + 1] - 1
        return (below + above) * (self.num - self.den) // (self.num + self.den)


def segments(keys: np.ndarray, first: np.ndarray, rings: Rings) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of segments, and the set of each."""
    sizes = np.diff(first)
    ring, strong = rings.of(sizes), strong_size(rings.num, rings.den)
    signs, of = [], []
    set_of = np.repeat(np.arange(len(sizes)), sizes)
    spread = ts.mix(keys ^ np.uint64(0x2545F4914F6CDD1D))
    value = ts.mix(keys + np.uint64(0x9E3779B97F4A7C15))
    for step in (0, 1):
        label = ring + step
        apart = np.array([rings.apart(j) if j else 0 for j in range(int(label.max(initial=0)) + 1)])[label]
        m = apart + 2 + apart // (12 if strong == 3 else 4)
        base = np.concatenate(([0], np.cumsum(m)))
        slot = base[set_of] + ((spread >> np.uint64(32)) * m[set_of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(slot, minlength=base[-1])
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, value)
        owner = np.repeat(np.arange(len(sizes)), m)
        place = np.arange(base[-1]) - base[owner]
        weak = count < strong
        few = np.bincount(owner, weak, minlength=len(sizes)) >= (m - apart)
        use = (~weak | few[owner]) & (sizes[owner] > 0) & (label[owner] > 0)
        sign = ts.mix(total + ts.mix((label[owner].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64)))
        signs.append(sign[use])
        of.append(owner[use])
    return np.concatenate(signs), np.concatenate(of)


_LINKS = "a long, b long"


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _sign_task(n_words: int, num: int, den: int):
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, seen = Rings(num, den), set()
        for piece in ts.pieces(batches):
            raw, offsets = ts.flat(piece.column("text"))
            keys, first = shingle_sets(raw, offsets, n_words)
            nodes = nodes_of(keys, first)
            sign, of = segments(keys, first, rings)
            # copies within a task need their signatures once
            fresh = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], bool)
            if len(seen) > 1 << 20:
                seen.clear()
            sign, of = sign[fresh[of]], of[fresh[of]]
            order = np.argsort(of, kind="stable")
            at = np.searchsorted(of[order], np.arange(len(nodes) + 1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sign[order].view(np.int64)))
            sketch = pa.array(sketches(keys, first), pa.binary())
            # a text that no id leads back to stays with its row
            named = pc.is_valid(piece.column("doc_id")).to_numpy(zero_copy_only=False)
            kept = piece.column("text").take(pa.array(np.arange(piece.num_rows), mask=named))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_id"), pa.array(nodes.view(np.int64)), pa.array(np.diff(first)), sketch, lists, kept], names=["doc_id", "text_id", "node", "n_shingles", "sketch", "signs", "kept"])

    return signs


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sign, node) in order: (pivot, node) for each signature of two nodes or more, the least node being the pivot."""
    last_sign = pivot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sign, node = (batch.column(c).to_numpy() for c in ("sign", "node"))
        new = np.ones(len(sign), bool)
        new[1:] = sign[1:] != sign[:-1]
        new[0] = last_sign is None or sign[0] != last_sign
        at = np.flatnonzero(new)
        lead = np.empty(len(sign), np.int64)
        if len(at):
            lead[: at[0]] = pivot if pivot is not None else 0
            lead[at[0] :] = np.repeat(node[at], np.diff(np.concatenate((at, [len(sign)]))))
        else:
            lead[:] = pivot
        met = lead != node
        pairs = np.unique(np.stack((lead[met], node[met])), axis=1)
        last_sign, pivot = sign[-1], lead[-1]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["pivot", "node"])


def _narrow_task(num: int, den: int):
    """From (region, node, n, sketch) of two blocks of a region: (a, b) that connect what may still link."""

    def narrow(key, table):
        node, one = np.unique(table.column("node").to_numpy(), return_index=True)
        size = table.column("n").to_numpy()[one]
        full = [np.frombuffer(x, np.uint64) for x in table.column("sketch").take(pa.array(one)).to_pylist()]
        least = min(map(len, full))
        words = np.stack([np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in full])
        part, links = np.arange(len(node)), []
        for i in range(len(node) - 1):
            most = (size[i] + size[i + 1 :]) * (num - den) // (num + den)
            near = i + 1 + np.flatnonzero(np.bitwise_count(words[i + 1 :] ^ words[i]).sum(1) <= most)
            for j in near[part[near] != part[i]]:
                if part[j] != part[i]:
                    links.append((int(node[i]), int(node[j])))
                    part[part == part[j]] = part[i]
        return _links(links)

    return narrow


def _narrowed(placed: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, node) from (pivot, node, n, sketch): what sketches leave connected, under the least node.

    A region of more than ``NARROW_NODES`` or ``NARROW_BYTES`` is compared block by block, each pair of blocks in a group of its own.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / NARROW_NODES, F.sum(F.octet_length("sketch")) / NARROW_BYTES))
    sizes = placed.groupBy(F.col("pivot").alias("p")).agg(blocks.cast("int").alias("blocks"))
    rows = placed.join(sizes, F.col("pivot") == F.col("p")).drop("p").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("pivot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "n", "sketch")
    links = rows.groupBy("pivot", "low", "high").applyInArrow(_narrow_task(num, den), _LINKS).distinct()
    return components(links).select(F.col("component").alias("pivot"), "node")


class _Sets:
    """The sets of a region as codes, for distances from one set to all."""

    def __init__(self, table: pa.Table, n_words: int) -> None:
        texts = table.column("text").combine_chunks()
        raw, offsets = ts.flat(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        keys, first = shingle_sets(raw, offsets, n_words)
        nodes = nodes_of(keys, first).view(np.int64)
        # a doc_id may stand over several texts: only the one that has this set is meant, and once
        right = np.flatnonzero((nodes == table.column("node").to_numpy()) & (np.diff(first) > 0))
        _, one = np.unique(nodes[right], return_index=True)
        self.rows = right[np.sort(one)]
        self.node, self.size = nodes[self.rows], np.diff(first)[self.rows]
        order = np.concatenate([np.arange(first[r], first[r + 1]) for r in self.rows]) if len(self.rows) else np.zeros(0, int)
        vocabulary, self.codes = np.unique(keys[order], return_inverse=True)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.mark = np.zeros(len(vocabulary), bool)

    def common(self, i: int) -> np.ndarray:
        """Sizes of the intersections of set i with all."""
        own = self.codes[self.first[i] : self.first[i + 1]]
        self.mark[own] = True
        out = np.add.reduceat(self.mark[self.codes].astype(np.int64), self.first[:-1])
        self.mark[own] = False
        return out


def _forest(sets: _Sets, center: int, pivots: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what the pivots link, by union and find; pairs that windows exclude are not compared."""
    n = len(sets.node)
    parent = np.arange(n)
    both = sets.common(center)
    apart = 1 - both / (sets.size[center] + sets.size - both)
    window = (num - den) / num + 1e-9
    links = []
    for i in [center, *[int(p) for p in pivots if p != center]]:
        root = parent[i]
        possible = (parent != root) & (np.abs(apart - apart[i]) <= window)
        if not possible.any():
            continue
        both = sets.common(i) if i != center else both
        linked = possible & (num * both >= den * (sets.size[i] + sets.size - both))
        for j in np.flatnonzero(linked):
            if parent[j] != parent[i]:
                links.append((int(sets.node[i]), int(sets.node[j])))
                parent[parent == parent[j]] = parent[i]
    return links


def _region_task(n_words: int, num: int, den: int):
    def region(key, table):
        sets = _Sets(table, n_words)
        center = np.flatnonzero(sets.node == key[0].as_py())
        return _links(_forest(sets, int(center[0]), np.arange(len(sets.node)), num, den) if len(center) else [])

    return region


def _block_task(n_words: int, num: int, den: int):
    def block(key, table):
        sets = _Sets(table, n_words)
        center = np.flatnonzero(sets.node == key[0].as_py())
        chosen = table.column("chosen").to_numpy(zero_copy_only=False).astype(bool)
        picked = np.unique(table.column("node").to_numpy()[chosen])
        return _links(_forest(sets, int(center[0]), np.flatnonzero(np.isin(sets.node, picked)), num, den) if len(center) else [])

    return block


#: Rows of a table of ids that go to one file at least.
FILE_ROWS = 250_000


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of all nodes of the links (a, b): the least node reachable, by large and small stars in turn."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        # stars are left when no node is above one edge and below another, or above two
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        ends = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        n, bad = ends.agg(F.coalesce(F.sum("above"), F.lit(0)), F.count_if((F.col("above") > 1) | ((F.col("above") > 0) & (F.col("below") > 0)))).first()
        if not bad:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), "stars", 8 + n // FILE_ROWS)
    raise RuntimeError(f"components still changed after {most_rounds} rounds")


def _large_regions(big: DataFrame, links: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """Links of regions (region, node, n, text) beyond the bound, round by round; ``links`` are those known already.

    Blocks of members and chunks of pivots are bounded in nodes and in shingles.
    """
    spark = big.sparkSession
    ids = big.select("region", "node", "n").distinct()
    blocks = ids.groupBy("region").agg(F.ceil(F.greatest(F.count(F.lit(1)) / REGION_NODES, F.sum("n") / REGION_SHINGLES)).cast("int").alias("blocks"))
    spent = spark.createDataFrame([], "region long, node long")
    found, take = spark.createDataFrame([], _LINKS), FIRST_PIVOTS
    first = True
    while True:
        if first:
            rest = ids
        else:
            known = components(links.unionByName(found))
            of = ids.join(known, "node", "left").select("region", "node", "n", F.coalesce("component", "node").alias("component"))
            largest = of.groupBy("region", "component").count().groupBy("region").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
            rest = of.join(largest, "region").where("component <> largest").select("region", "node", "n")
        rest = rest.join(spent, ["region", "node"], "left_anti")
        turn = Window.partitionBy("region").orderBy(F.col("node") != F.col("region"), F.xxhash64("node"))
        before = F.sum("n").over(turn.rowsBetween(Window.unboundedPreceding, -1))
        ranked = rest.withColumns({"turn": F.row_number().over(turn), "before": F.coalesce(before, F.lit(0))}).where(F.col("turn") <= take)
        chosen = written(ranked.select("region", "node", F.floor(F.greatest((F.col("turn") - 1) / REGION_NODES, F.col("before") / REGION_SHINGLES)).alias("chunk")), "pivots")
        if chosen.isEmpty():
            return found
        # each block of members meets each chunk of pivots, and the centre, to which distances make the windows
        chunks = chosen.select("region", "chunk").distinct()
        members = big.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks"))).join(chunks, "region").select("region", "block", "chunk", "node", "text", F.lit(False).alias("chosen"))
        texts = big.select("region", F.col("node").alias("n"), "text")
        centres = chunks.withColumn("node", F.col("region")).unionByName(chosen.select("region", "chunk", "node")).distinct().withColumnRenamed("node", "n")
        centres = centres.join(chosen.select("region", "chunk", F.col("node").alias("n"), F.lit(True).alias("chosen")), ["region", "chunk", "n"], "left")
        pivots = centres.join(texts, ["region", "n"]).join(blocks, "region").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pivots = pivots.select("region", "block", "chunk", F.col("n").alias("node"), "text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
        new = members.withColumn("block", F.col("block").cast("int")).unionByName(pivots).groupBy("region", "block", "chunk").applyInArrow(_block_task(n_words, num, den), _LINKS)
        found = written(found.unionByName(new), "links-found")
        spent = written(spent.unionByName(chosen.select("region", "node")), "spent")
        take, first = take * 8, False


def near_duplicates(docs: DataFrame, n_words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``, linked from similarity den / num on.

    component_id is the smallest doc_id that links lead to, the row's own
    included; a document without words (null and empty texts too) is linked with
    nothing. Equal sets are linked, whatever their texts. Repeated rows each get
    their row. Rows without doc_id are linked like others, and links lead through them; a null is never the smallest, and the
    component of rows that all lack one. Only doc_id and text are read.
    """
    return _grouped(docs, n_words, num, den).drop("text_id", "first_text")


def _grouped(docs: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """``near_duplicates`` with text_id, the hash of each row's text, and first_text, that of the text that stands for its component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    kind = "doc_id long, text_id long, node long, n_shingles long, sketch binary, signs array<long>, kept string"
    sets = written(signed.mapInArrow(_sign_task(n_words, num, den), kind).withColumn("row", F.monotonically_increasing_id()), "sets")
    signs = sets.select(F.explode("signs").alias("sign"), "node").repartition("sign").sortWithinPartitions("sign", "node")
    met = signs.mapInArrow(_meet, "pivot long, node long").distinct()
    met = written(met, "met")
    regions = met.unionByName(met.select("pivot", F.col("pivot").alias("node")).distinct())
    # a node stands for its row with the least id; rows without id come last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_id")).alias("least")
    nodes = sets.where("n_shingles > 0").groupBy("node").agg(least, F.first("n_shingles").alias("n")).select("node", "n", "least.doc_id", "least.row", "least.text_id")
    sketched = sets.select(F.col("row").alias("s"), "sketch")
    placed = regions.join(nodes.select("node", "n", "row"), "node").join(sketched, F.col("row") == F.col("s")).select("pivot", "node", "n", "sketch")
    members = written(_narrowed(placed, num, den).join(nodes, "node"), "members")
    sizes = members.groupBy("pivot").agg((F.count(F.lit(1)) > REGION_NODES).alias("many"), (F.sum("n") > REGION_SHINGLES).alias("heavy"), F.count(F.lit(1)).alias("size"))
    sizes = sizes.select(F.col("pivot").alias("region"), (F.col("many") | (F.col("heavy") & (F.col("size") > 2))).alias("large"))
    wanted = members.where("doc_id is not null").select(F.col("doc_id").alias("id"), "node").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    texts = docs.join(wanted, F.col("doc_id") == F.col("id")).select("node", "text")
    unnamed = members.where("doc_id is null").select(F.col("row").alias("r"), F.col("node").alias("m")).distinct()
    texts = texts.unionByName(sets.join(unnamed, F.col("row") == F.col("r")).select(F.col("m").alias("node"), F.col("kept").alias("text")))
    placed = members.select(F.col("pivot").alias("region"), "node", "n").join(sizes, "region")
    full = written(placed.join(texts, "node").select("region", "node", "n", "text", "large"), "regions")
    links = written(full.where("not large").drop("large", "n").groupBy("region").applyInArrow(_region_task(n_words, num, den), _LINKS), "links-small")
    big = full.where("large").drop("large")
    if not big.isEmpty():
        links = links.unionByName(_large_regions(big, links, n_words, num, den))
    found = components(links)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")).alias("first")
    named = found.join(nodes.select("node", "doc_id", "text_id"), "node").groupBy("component").agg(first).select("component", F.col("first.doc_id").alias("component_id"), F.col("first.text_id").alias("first_text"))
    of_node = nodes.select("node", "doc_id", "text_id").join(found.join(named, "component").select("node", "component_id", "first_text"), "node", "left")
    # a table of its own: the join then has an exchange on either side, and a node with very many copies can be split
    of_node = written(of_node.select(F.col("node").alias("n"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("first_text", "text_id").alias("first_text")), "of-node")
    return sets.join(of_node, F.col("node") == F.col("n"), "left").select("doc_id", "text_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "first_text")


def keep_first(docs: DataFrame, n_words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One document of each group of ``near_duplicates`` (the smallest doc_id), all columns kept.

    It is decided per row, known by doc_id and text: another text under the id of
    a row that goes stays. Rows that repeat the kept doc_id in its group all stay; so
    do rows without words. A row without id goes where its group has a row with one; of a group without any id, one text stays.
    """
    gone = _grouped(docs, n_words, num, den).where("doc_id <> component_id or (doc_id is null and (component_id is not null or text_id <> first_text))")
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("text_id").alias("__gone_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["__gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__gone_text"])
    return docs.join(gone, same, "left_anti")
