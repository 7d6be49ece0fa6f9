"""N-gram Jaccard join by a MinHash LSH forest, with exact verification (operator 10).

1. Each text becomes its set of word five-grams (64-bit hashes); texts with equal sets are one node, known by the set's hash.
2. Every node has a signature: ``trees`` labels of ``max_depth`` MinHash values of 16 bits. The forest is the table of all
   labels, range-partitioned and sorted by (tree, label, node): rows under one node of a tree's prefix trie stand next to each
   other, however many they are, and a range of any size is split over tasks. One pass over the sorted rows finds how
   long a prefix each row shares with the row before it, and links it to the first row of the stretch that shares as much. So a link
   a row and tree is enough to connect all that share a prefix, at every depth.
3. Matched prefixes start at ``max_depth`` and are shortened until the recall measured on the links of the shortest depth
   allowed reaches ``target_recall``: their similarities, estimated from whole signatures, give the probability that a pair
   shares a prefix of that depth in some tree; its mean has to reach the target in every band of similarity that the data have.
4. Components of the links of the depth found are candidate clusters; two nodes that share any such prefix are in one.
5. Within a cluster all pairs are verified exactly on the sets. Sets are made once a node. Clusters whose sets exceed
   ``block_grams`` hashes in all are dealt as pairs of blocks of that size, so a set is sent as often as its cluster has blocks. Only
   sums and a spanning forest leave a block: one row for each node, not for each pair.
6. Components of the verified links are the classes.

Defined results: words are runs of letters and digits in lower case; texts of one to four words have one gram of
all their words. Texts without words, null among them, are alone in their class without links. Copies and repeated rows are links of each
other and counted as such, but never expanded. class_id is the smallest non-null id of the class. n_links counts rows
of the table linked to the row: copies, and rows whose set has a similarity of at least the threshold. Equality at
the threshold is a link, decided in integers. Extra columns are not read; keep_one() returns them all, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolens.llm.common import fresh, materialise, release, remove

WORDS_A_GRAM = 5
THRESHOLD_PERCENT = 80
TREES = 20
MAX_DEPTH = 8
#: Prefixes are never shortened below this.
MIN_DEPTH = 4
TARGET_RECALL = 0.9995
#: Bands of similarity, in percent, in each of which the target has to be reached.
BAND_PERCENT = 5
#: Hashes of a block: what a task holds of one side of a pair of blocks, 8 bytes each.
BLOCK_GRAMS = 1 << 19
#: Sets whose pairs are counted at once.
TILE = 512
CACHE_WORDS = 150_000
WORD = re.compile(r"[^\W_]+")
_WORD_HASHES: dict[str, int] = {}


def grams(text: str | None, size: int = WORDS_A_GRAM) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORD_HASHES) > CACHE_WORDS:
        _WORD_HASHES.clear()
    for w in words:
        if w not in _WORD_HASHES:
            _WORD_HASHES[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    key = np.full(n, min(len(h), size), np.uint64)
    for i in range(min(len(h), size)):
        key = (key ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.unique(key)


class Forest:
    """Signatures: for each tree a label of max_depth MinHash values, 16 bits each, as big-endian bytes that sort as the values do."""

    def __init__(self, trees: int, max_depth: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, trees * max_depth, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, trees * max_depth, np.uint64)

    def signature(self, sets: np.ndarray) -> bytes:
        low = np.full(len(self.a), np.iinfo(np.uint64).max)
        for i in range(0, len(sets), 2048):
            x = sets[i : i + 2048]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            low = np.minimum(low, (self.a[:, None] * x + self.b[:, None]).min(axis=1))
        low = (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)  # the smallest values have like high bits
        return (low >> np.uint64(48)).astype(">u2").tobytes()


def _set_key(sets: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(sets.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, id_col: str, text_col: str, trees: int, max_depth: int) -> DataFrame:
    """doc_id, d0, d1 (the text's identity), node (null: no words), size of its set, signature."""

    @F.arrow_udf("struct<node:long,size:int,signature:binary>")
    def signed(texts: pa.Array) -> pa.Array:
        forest = Forest(trees, max_depth)
        sets = [grams(t.as_py()) for t in texts]
        nodes = pa.array([_set_key(s) if len(s) else None for s in sets], pa.int64())
        sizes = pa.array([len(s) for s in sets], pa.int32())
        labels = pa.array([forest.signature(s) if len(s) else None for s in sets], pa.binary())
        release()
        return pa.StructArray.from_arrays([nodes, sizes, labels], ["node", "size", "signature"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("d0"), F.xxhash64(F.lit(1), text).alias("d1"), signed(text).alias("s"))
    return rows.select("doc_id", "d0", "d1", "s.node", "s.size", "s.signature")


# The forest.

EDGE_SCHEMA = "a long, b long, depth int, part int, tree int, label binary"


class _Stretches:
    """Reads sorted rows and links each to the first row of the stretch with which it shares the longest prefix."""

    def __init__(self, max_depth: int, min_depth: int):
        self.max_depth, self.min_depth = max_depth, min_depth
        self.last: tuple[int, np.ndarray] | None = None  # tree and values of the row before
        self.heads = np.zeros(max_depth + 1, np.int64)  # by depth: the first node of the stretch that the last row is in

    def shared(self, trees: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each row, how many leading values it shares with the row before."""
        if self.last is not None:
            trees, values = np.append(self.last[0], trees), np.vstack([self.last[1], values])
        same = (values[1:] == values[:-1]) & (trees[1:] == trees[:-1])[:, None]
        depths = np.cumprod(same, axis=1).sum(axis=1)
        return depths if self.last is not None else np.append(0, depths)

    def links(self, trees: np.ndarray, values: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        depths = self.shared(trees, values)
        target = np.zeros(len(nodes), np.int64)
        for depth in range(self.min_depth, self.max_depth + 1):
            begins = np.where(depths < depth, np.arange(len(nodes)), -1)
            first = np.maximum.accumulate(begins)
            head = np.where(first >= 0, nodes[first], self.heads[depth])
            target = np.where(depths == depth, head, target)
            self.heads[depth] = head[-1]
        self.last = (int(trees[-1]), values[-1])
        linked = (depths >= self.min_depth) & (target != nodes)
        return nodes[linked], target[linked], depths[linked]


def _scan(batches: Iterator[pa.RecordBatch], max_depth: int, min_depth: int) -> Iterator[pa.RecordBatch]:
    """Links of one range of the forest (part null), then its first and its last row (part: the range)."""
    from pyspark import TaskContext

    part, stretches, ends = TaskContext.get().partitionId(), _Stretches(max_depth, min_depth), []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32()), ("part", pa.int32()), ("tree", pa.int32()), ("label", pa.binary())])
    for batch in batches:
        if not batch.num_rows:
            continue
        trees, labels, nodes = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
        values = np.frombuffer(b"".join(labels.to_pylist()), ">u2").reshape(len(nodes), max_depth)
        end = lambda i: (int(nodes[i]), int(trees[i]), labels[i].as_py())  # noqa: B023, E731
        ends = [ends[0] if ends else end(0), end(-1)]
        a, b, depths = stretches.links(trees, values, nodes)
        n = len(a)
        yield pa.record_batch([pa.array(a), pa.array(b), pa.array(depths, pa.int32()), *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary()))], schema=schema)
    if ends:
        rows = [(node, node, side, part, tree, label) for side, (node, tree, label) in enumerate(ends)]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _across(spark: SparkSession, ends: list, max_depth: int, min_depth: int) -> DataFrame:
    """Links between the last row of each range and the first of the next, from two rows a range."""
    at = {(r["part"], r["depth"]): r for r in ends}
    parts = sorted({part for part, _ in at})
    rows = []
    for p, q in zip(parts, parts[1:]):
        x, y = at[p, 1], at[q, 0]
        u, v = np.frombuffer(x["label"], ">u2"), np.frombuffer(y["label"], ">u2")
        depth = int(np.cumprod(u == v).sum()) if x["tree"] == y["tree"] else 0
        if depth >= min_depth and x["a"] != y["a"]:
            rows.append((x["a"], y["a"], depth))
    return spark.createDataFrame(rows, "a long, b long, depth int")


def forest_links(nodes: DataFrame, trees: int, max_depth: int, min_depth: int) -> DataFrame:
    """a, b, depth: links of the forest that share a prefix of min_depth values or more, with the longest prefix they share as neighbours."""
    width = 2 * max_depth
    labelled = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = labelled.select("tree", F.substring(F.col("signature"), F.col("tree") * width + 1, F.lit(width)).alias("label"), "node")
    order = ["tree", "label", "node"]
    scanned = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _scan(b, max_depth, min_depth), EDGE_SCHEMA)
    found = materialise(scanned, "forest")
    ends = found.where(F.col("part").isNotNull()).collect()  # two rows a range, whatever the data
    links = found.where(F.col("part").isNull()).select("a", "b", "depth").unionByName(_across(nodes.sparkSession, ends, max_depth, min_depth))
    return links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("depth").alias("depth"))


def met(similarity: float, depth: int, trees: int) -> float:
    """Probability that a pair shares a prefix of a depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def recall_by_band(links: DataFrame, nodes: DataFrame, percent: int, trees: int, max_depth: int, min_depth: int) -> dict[int, list[float]]:
    """For each depth from max_depth down to min_depth, the recall measured in each band of similarity that has links."""

    @F.arrow_udf("double")
    def agreement(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([float(np.mean(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16))) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())

    t, n = percent / 100, trees * max_depth
    error = 2 * math.sqrt(t * (1 - t) / n)  # what looks a little less similar may reach the threshold, and counts as if it just did
    one, two = nodes.select(F.col("node").alias("a"), F.col("signature").alias("s")), nodes.select(F.col("node").alias("b"), F.col("signature").alias("t"))
    alike = links.join(one, "a").join(two, "b").select(agreement("s", "t").alias("j")).where(F.col("j") >= t - error).select(F.greatest("j", F.lit(t)).alias("j"))
    depths = range(max_depth, min_depth - 1, -1)
    chance = [F.avg(1 - F.pow(1 - F.pow("j", F.lit(d)), F.lit(trees))).alias(f"d{d}") for d in depths]
    bands = alike.groupBy(F.floor((F.col("j") - t) * (100 / BAND_PERCENT) + 1e-9).alias("band")).agg(*chance).collect()  # a row for each band, so few
    return {d: [r[f"d{d}"] for r in bands] for d in depths}


def choose_depth(recall: dict[int, list[float]], target: float) -> int:
    """The longest prefix with the target recall in every band; the shortest allowed if none has."""
    return next((d for d in sorted(recall, reverse=True) if all(r >= target for r in recall[d])), min(recall))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node) for each node of edges (a, b), by alternating large and small stars."""

    def stars(pairs: DataFrame, small: bool) -> DataFrame:
        if small:  # smaller neighbours of each node
            near = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(low, "u")
        if small:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.where(F.col("a") != F.col("b")).distinct()

    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = materialise(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    before = state(now)
    while before[0]:
        after = materialise(stars(stars(now, small=False), small=True), "edges")
        reached = state(after)
        remove(now.sparkSession, now)
        now, done = after, reached == before
        before = reached
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


# Verification.


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by columns of grams. A gram that most sets hold is counted by those that lack it."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    by = np.argsort(column, kind="stable")
    row, counts = row[by], np.bincount(column)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    common = np.zeros((m, m), np.int64)
    lacking = np.zeros(m, np.int64)
    often = 0
    for c in np.flatnonzero(counts > 1):
        held = row[starts[c] : starts[c] + counts[c]]
        if 2 * len(held) > m:
            often += 1
            if len(held) == m:
                continue
            held = np.setdiff1d(np.arange(m), held, assume_unique=True)
            lacking[held] += 1
        common[np.ix_(held, held)] += 1
    return common + often - lacking[:, None] - lacking[None, :]


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of pairs with a Jaccard similarity of at least percent / 100."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m <= 4:
        common = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i):
                common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        common = common_counts(sets)
    found = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(found, False)
    return found


def _roots(found: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    root = np.arange(len(found))
    while True:
        low = np.where(found, root[None, :], len(found)).min(axis=1, initial=len(found))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Input, sorted by the first three: root, b1, b2, block, node, copies, set. A row for each node of a pair of blocks: node, links, first."""

    def finish(key: tuple, rows: dict[int, tuple]) -> pa.RecordBatch:
        by = sorted(rows, key=lambda n: (rows[n][0], len(rows[n][2]), n))  # sets of like sizes stand together
        sets = [rows[n][2] for n in by]
        block, copies, ids = np.array([rows[n][0] for n in by]), np.array([rows[n][1] for n in by]), np.array(by, np.int64)
        sizes = np.array([len(s) for s in sets])
        links, root = np.zeros(len(by), np.int64), np.arange(len(by))
        for i in range(0, len(by), TILE):
            for j in range(i, len(by), TILE):
                p, q = np.arange(i, min(i + TILE, len(by))), np.arange(j, min(j + TILE, len(by)))
                # Sizes too far apart, or blocks that another task compares: no pair of the tiles can count.
                if 100 * min(sizes[p].max(), sizes[q].max()) < percent * max(sizes[p].min(), sizes[q].min()) or key[1] != key[2] and block[p[0]] == block[q[-1]]:
                    continue
                at = p if i == j else np.concatenate([p, q])
                found = linked([sets[k] for k in at], percent)
                if i != j:
                    found[: len(p), : len(p)] = found[len(p) :, len(p) :] = False
                if key[1] != key[2]:
                    found &= block[at][:, None] != block[at][None, :]
                links[at] += found @ copies[at]
                _merge(root, at, found)
        ends = ids[_settled(root)]
        return pa.record_batch({"node": pa.array(ids), "links": pa.array(links), "first": pa.array(ends), "blocks": pa.array(np.full(len(ids), key[1] != key[2]))})

    now, rows = None, {}
    for batch in batches:
        *keys, blocks, nodes, copies, sets = [batch.column(i) for i in range(7)]
        for key, block, node, n, values in zip(zip(*(k.to_pylist() for k in keys)), blocks.to_pylist(), nodes.to_pylist(), copies.to_pylist(), sets):
            if key != now and rows:
                yield finish(now, rows)
                rows = {}
            now = key
            rows[node] = (block, n, values.values.to_numpy().view(np.uint64).copy())
    if rows:
        yield finish(now, rows)


def _settled(root: np.ndarray) -> np.ndarray:
    while (root[root] != root).any():
        root = root[root]
    return root


def _merge(root: np.ndarray, at: np.ndarray, found: np.ndarray) -> None:
    """Joins the components that a tile's links connect; root names an earlier row of the same component."""
    first = _roots(found)
    for i, f in enumerate(first.tolist()):
        if i != f:
            x, y = at[i], at[f]
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            root[max(x, y)] = min(x, y)


def _identity(text: Column, salt: int | None = None) -> Column:
    return F.xxhash64(text) if salt is None else F.xxhash64(F.lit(salt), text)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = THRESHOLD_PERCENT,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    min_depth: int = MIN_DEPTH,
    target_recall: float = TARGET_RECALL,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """A row for each row of docs: doc_id, d0, d1 (hashes of the text), class_id, n_links, keeper (d0, d1 and id of the one to stay; null without words)."""
    signed = materialise(signatures(docs, id_col, text_col, trees, max_depth), "signed")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "d0", "d1")
    some = signed.where(F.col("node").isNotNull())
    sets = some.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at"))
    # The signature is the node's, so copies are left out before anything is sorted.
    nodes = materialise(some.select("node", "size", "signature").groupBy("node").agg(F.first("size").alias("size"), F.first("signature").alias("signature")), "nodes")
    links = materialise(forest_links(nodes, trees, max_depth, min_depth), "links")
    depth = choose_depth(recall_by_band(links, nodes, percent, trees, max_depth, min_depth), target_recall)
    clusters = materialise(components(links.where(F.col("depth") >= depth).select("a", "b")), "clusters").join(nodes.select("node", "size"), "node")
    sized = clusters.groupBy("root").agg(F.ceil(F.sum("size") / block_grams).cast("int").alias("nb"))
    active = clusters.join(sized, "root").join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    where = active.select("node", "root", "nb", "block", "copies", F.col("at.doc_id").alias("__id"), F.col("at.d0").alias("d0"), F.col("at.d1").alias("d1"))

    @F.arrow_udf("array<long>")
    def set_of(texts: pa.Array) -> pa.Array:
        return pa.array([grams(t.as_py()).view(np.int64) for t in texts], pa.list_(pa.int64()))

    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("__doc_id"), text.alias("text"), _identity(text).alias("d0"), _identity(text, 1).alias("d1"))
    found = texts.join(where, (texts["d0"] == where["d0"]) & (texts["d1"] == where["d1"]) & texts["__doc_id"].eqNullSafe(where["__id"])).select("root", "nb", "block", "node", "copies", "text")
    made = found.dropDuplicates(["node"]).select("root", "nb", "block", "node", "copies", set_of("text").alias("set"))
    dealt = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("root", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", "copies", "set")
    grouped = dealt.repartition("root", "b1", "b2").sortWithinPartitions("root", "b1", "b2")
    verified = materialise(grouped.mapInArrow(lambda b: _verify(b, percent), "node long, links long, first long, blocks boolean"), "verified")
    # Clusters of one block have their classes already; those of several are joined over their blocks.
    many = verified.where("blocks").select("node").distinct()
    split = verified.join(many, "node", "left_semi").select(F.col("node").alias("a"), F.col("first").alias("b"))
    over_blocks = components(split)
    links_of = verified.groupBy("node").agg(F.sum("links").alias("links"), F.min("first").alias("first"))
    roots = links_of.join(over_blocks, "node", "left").select("node", "links", F.coalesce("root", "first").alias("class"))
    per_set = sets.join(roots, "node", "left").select("node", "at", F.coalesce("class", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_class = per_set.groupBy("class").agg(F.min("at").alias("keeper"))
    labels = per_set.join(per_class, "class").select("node", "n_links", "keeper")
    return signed.drop("signature", "size").join(labels, "node", "left").select(
        "doc_id", "d0", "d1", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "keeper"
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, all columns: of each class the row with the smallest id stays, once; rows without words all stay, but for repeated rows."""
    labels = near_duplicates(docs, **options)
    id_col, text = options.get("id_col", "doc_id"), F.col(f"`{options.get('text_col', 'text')}`")
    d0, d1, g, g0, g1 = (fresh(docs, x) for x in ("__d0", "__d1", "__g", "__g0", "__g1"))
    same = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.d0") == F.col("d0")) & (F.col("keeper.d1") == F.col("d1"))
    gone = labels.where(F.col("keeper").isNotNull() & ~same).select(F.col("doc_id").alias(g), F.col("d0").alias(g0), F.col("d1").alias(g1))
    keyed = docs.withColumns({d0: _identity(text), d1: _identity(text, 1)})
    kept = keyed.join(gone, (F.col(d0) == F.col(g0)) & (F.col(d1) == F.col(g1)) & F.col(f"`{id_col}`").eqNullSafe(F.col(g)), "left_anti")
    return kept.dropDuplicates([d0, d1, id_col]).drop(d0, d1)
