"""Near-duplicates by a chosen-path set similarity join.

A document is its set of word shingles, sketched by minwise values. In each of several independent trees a node
selects a few coordinates of the sketch, and its documents branch by their values there; similar documents share
most values and so share some path to a leaf. Small nodes are compared exhaustively, by sketches first; what remains
is confirmed on full sets. Nodes that don't shrink when they branch hold documents much alike: they are compared in
blocks which the same few leaders visit, and what these don't connect with the rest meets every block, so nothing is
capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import staged
from .words import LOWER, NOT_SPACE, Texts, groups, mix, per_text, ranges, window_hashes

#: Words of a shingle; least similarity in hundredths.
SHINGLE, PERCENT = 3, 85
#: Minwise values of a sketch; coordinates that each node selects; share of pairs at the least similarity that no tree may bring together: at 0.85 a tree misses 3 of 100, so 4 are grown, at 0.8 6 of 100, so 5.
SKETCH, BRANCHES, MISS = 64, 2, 1e-6
#: Documents of a node that is compared at once; share of its parent's documents in a node that no longer branches; levels.
LEAF, DENSE, DEPTH = 512, 0.5, 24
#: Documents and shingles of a block of a larger node; its documents that visit all blocks.
BLOCK, BLOCK_SHINGLES, LEADERS = 1024, 2_000_000, 32
#: Standard deviations of a sketch's estimate that are allowed for.
MARGIN = 5.0

_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, SKETCH, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


# --- sets


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted in each, one after the other; and where each text's begin (one more at the end)."""
    texts = Texts(column)
    words = texts.words(NOT_SPACE, LOWER)
    owner, hashes, counts = words.text_of(), words.hashes() if words.n else np.zeros(0, np.uint64), words.counts
    at = words.windows(size)
    keys, text = [window_hashes(hashes, at, size)], [owner[at]]
    for few in range(1, size):
        short = np.flatnonzero(counts == few)
        keys.append(mix(window_hashes(hashes, words.first[short], few) + np.uint64(few)))
        text.append(short)
    key, doc = np.concatenate(keys), np.concatenate(text)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, bool)
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(texts.n + 1))


def sketches(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH minwise values of each set; 0 for empty ones."""
    found = np.zeros((len(first) - 1, SKETCH), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for k in range(SKETCH):
            found[full, k] = (np.minimum.reduceat(keys * _FACTORS[k], first[full]) >> np.uint64(32)).astype(np.uint32)
    return found


def describe(size: int) -> Callable[[pa.Array], dict[str, pa.Array]]:
    def make(column: pa.Array) -> dict[str, pa.Array]:
        keys, first = shingle_sets(column, size)
        full = np.flatnonzero(np.diff(first))
        sums = np.zeros((2, len(first) - 1), np.uint64)
        if len(full):
            sums[0, full] = np.add.reduceat(mix(keys + np.uint64(1)), first[full])
            sums[1, full] = np.bitwise_xor.reduceat(mix(keys * np.uint64(3)), first[full])
        rows = sketches(keys, first)
        return {"n": pa.array(np.diff(first)), "f": pa.array(sums[0].view(np.int64)), "g": pa.array(sums[1].view(np.int64)), "sketch": pa.array([r.tobytes() for r in rows], pa.binary())}

    return make


def sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


# --- trees


def node_of(seed: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix((coordinate.astype(np.uint64) << np.uint64(32)) | value.astype(np.uint64))).view(np.int64)


def roots(trees: int, branches: int):
    """Children of the roots: each tree's root selects branches coordinates of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = sketch_rows(batch.column(1))
            for tree in range(trees):
                for k in range(branches):
                    c = (tree * branches + k) % SKETCH
                    node = node_of(np.full(len(table), tree + 1), np.full(len(table), c), table[:, c])
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(len(table), np.uint64(1 << c)).view(np.int64)), batch.column(0)], names=["node", "path", "cls"])

    return run


def children(branches: int):
    """Children of large nodes: coordinates are picked by a hash of the node, none twice on a path (path: a bit for each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, path, size = (batch.column(i).to_numpy() for i in range(3))
            table = sketch_rows(batch.column(4))
            picks = {}
            for v, p in set(zip(node.tolist(), path.tolist(), strict=True)):
                order = np.argsort(mix(np.full(SKETCH, v, np.int64).view(np.uint64) + np.arange(SKETCH, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
                picks[v] = [c for c in order if not (p >> int(c)) & 1][:branches]
            for k in range(branches):
                some = np.array([i for i, v in enumerate(node) if len(picks[v]) > k], np.int64)
                if len(some):
                    c = np.array([picks[v][k] for v in node[some]], np.int64)
                    bits = (path[some].view(np.uint64) | (np.uint64(1) << c.astype(np.uint64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(node_of(node[some].view(np.uint64), c, table[some, c])), pa.array(bits), pa.array(size[some]), batch.column(3).take(pa.array(some))], names=["node", "path", "parent", "cls"])

    return run


def leaves(classes: DataFrame, trees: int, branches: int, leaf: int, dense: float, depth: int) -> DataFrame:
    """(node, size, cls) of all nodes of two or more that are not branched further."""
    rows = classes.select("cls", "sketch").mapInArrow(roots(trees, branches), "node bigint, path bigint, cls bigint").withColumn("parent", F.lit(None).cast("bigint"))
    found = None
    for level in range(depth):
        rows = staged(rows, "level")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = staged(rows.join(sizes, "node"), "nodes")
        stop = (F.col("size") <= leaf) | F.coalesce(F.col("size") > dense * F.col("parent"), F.lit(False)) | F.lit(level == depth - 1)
        own = sized.where(stop).select("node", "size", "cls")
        found = own if found is None else found.unionByName(own)
        large = sized.where(~stop)
        if large.isEmpty():
            break
        rows = large.join(classes.select("cls", "sketch"), "cls").select("node", "path", "size", "cls", "sketch").mapInArrow(children(branches), "node bigint, path bigint, parent bigint, cls bigint")
    return found


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by its first column, cut anew so that no group is in two; small groups come together."""
    held: list[pa.RecordBatch] = []
    whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield whole([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column(0)[0].as_py() != keys[0]:
            yield whole(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield whole(held)


def stars(cls: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges (a, b) that connect the classes which pairs of places connect: each class with the smallest of its component.

    Groups with the same classes have the same smallest ones, so their edges are the same and count once.
    """
    parent = list(range(len(cls)))
    number = cls.tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(i), root(j)
        if x != y:
            low, high = (x, y) if number[x] < number[y] else (y, x)
            parent[high] = low
    some = np.unique(np.concatenate((a, b)))
    edges = np.array([(number[i], number[root(i)]) for i in some.tolist()], np.int64).reshape(-1, 2)
    edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])


def similar_places(table: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that agree in least coordinates or more, some that connect the same rows: each row is compared with all before it."""
    n = len(table)
    label = np.arange(n)
    for i in range(1, n):
        near = np.flatnonzero((table[:i] == table[i]).sum(1) >= least)
        if len(near):
            names, at = np.unique(label[near], return_index=True)
            yield np.full(len(names), i), near[at]
            label[:i][np.isin(label[:i], names)] = names[0]
            label[i] = names[0]


def compare_sketches(least: int):
    """Edges (a, b) between classes of a group whose sketches agree enough; as many as connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_group(batches):
            keys, cls, table = batch.column(0).to_numpy(), batch.column(1).to_numpy(), sketch_rows(batch.column(2))
            begins, sizes = groups(keys)
            a, b = [], []
            for n in np.unique(sizes[(sizes > 1) & (sizes <= 16)]):
                at = begins[sizes == n]
                for i in range(1, n):
                    for j in range(i):
                        near = at[(table[at + i] == table[at + j]).sum(1) >= least]
                        a.append(near + i)
                        b.append(near + j)
            for at, n in zip(begins[sizes > 16], sizes[sizes > 16], strict=True):
                for x, y in similar_places(table[at : at + n], least):
                    a.append(at + x)
                    b.append(at + y)
            if a and sum(map(len, a)):
                yield stars(cls, np.concatenate(a), np.concatenate(b))

    return run


# --- confirmation


def links_between(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links at percent or more between sets, as many as connect what all of them connect: from each set reached, those not yet reached."""
    sizes = np.array([len(s) for s in sets])
    found, waiting = [], np.arange(len(sets))
    while len(waiting) > 1:
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            u = queue.pop()
            may = waiting[(percent * np.maximum(sizes[waiting], sizes[u]) <= 100 * np.minimum(sizes[waiting], sizes[u]))]
            linked = []
            for lo in range(0, len(may), 256):
                part = may[lo : lo + 256]
                joined = np.concatenate([sets[k] for k in part])
                at = np.searchsorted(sets[u], joined)
                at[at == sizes[u]] = 0
                common = np.add.reduceat((sets[u][at] == joined).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[part])[:-1])))
                linked += part[100 * common >= percent * (sizes[part] + sizes[u] - common)].tolist()
            found += [(u, k) for k in linked]
            queue += linked
            waiting = waiting[~np.isin(waiting, linked)]
    return found


def confirm(shingle: int, percent: int):
    """Links (a, b) of each group, checked on the full sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_group(batches):
            keys, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sets: list[np.ndarray] = []
            for lo, hi in ranges(batch.column(2)):
                key, first = shingle_sets(batch.column(2).slice(lo, hi - lo), shingle)
                sets += [key[first[i] : first[i + 1]] for i in range(hi - lo)]
            a, b = [], []
            for at, n in zip(*groups(keys), strict=True):
                for i, j in links_between(sets[at : at + n], percent):
                    a.append(at + i)
                    b.append(at + j)
            if a:
                yield stars(cls, np.array(a, np.int64), np.array(b, np.int64))

    return run


def grouped(rows: DataFrame, run, out: str) -> DataFrame:
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, out)


def compared(members: DataFrame, payload: DataFrame, run, leaders: int = LEADERS) -> DataFrame:
    """Edges (a, b) by run that connect what all pairs of classes of one key connect. members: (key, cls, parts); payload: (cls, value).

    A key of one part is one group. The classes of a larger one are dealt to its parts, each of which the key's
    leaders, its smallest classes, visit. What is connected by then needs no comparison any more: of each key the largest component is left
    in its parts, and every class outside it meets all parts. So no pair of classes that are not connected yet goes
    without a comparison. A key of n classes of which r are outside its largest component makes n * r / block rows,
    and few more than n where most are like a leader or like one that is.
    """
    meet = lambda rows: grouped(rows.join(payload, "cls").select("grp", "cls", "value"), run, "a bigint, b bigint")
    large = members.where("parts > 1").withColumn("block", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("parts")))
    # the numbers of classes have nothing to do with what is in them
    nth = F.row_number().over(Window.partitionBy("key").orderBy("cls"))
    visits = large.withColumn("nth", nth).where(F.col("nth") <= leaders).withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rows = [
        members.where("parts = 1").select(F.xxhash64("key").alias("grp"), "cls"),
        large.select(F.xxhash64("key", "block").alias("grp"), "cls"),
        visits.where("at <> block").select(F.xxhash64("key", "at").alias("grp"), "cls"),
    ]
    edges = staged(meet(reduce(DataFrame.unionByName, rows)), "edges")
    if large.isEmpty():
        return edges
    parts = connected_components(edges)
    labelled = staged(large.join(parts, F.col("cls") == F.col("node"), "left").select("key", "cls", "parts", "block", F.coalesce("root", "cls").alias("root")), "labelled")
    each = labelled.groupBy("key", "parts", "root").agg(F.count(F.lit(1)).alias("n"))
    top = each.groupBy("key", "parts").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).where("top.n < n")
    top = top.select("key", F.col("top.root").alias("bulk"), F.greatest(F.lit(1), F.ceil(F.col("parts") * (F.col("n") - F.col("top.n")) / F.col("n"))).alias("turns"))
    left = staged(labelled.join(top, "key").withColumn("turn", F.when(F.col("root") != F.col("bulk"), F.pmod(F.xxhash64("cls", F.lit("turn")), F.col("turns")))), "left")
    if left.isEmpty():
        return edges
    group = F.xxhash64("key", F.col("turn"), F.col("block")).alias("grp")
    outside = left.where("turn is not null").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select(group, "cls")
    hosts = left.withColumn("own", F.col("turn")).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1))).where("own is null or own <> turn").select(group, "cls")
    return edges.unionByName(staged(meet(outside.unionByName(hosts)), "edges"))


def trees_for(percent: int, branches: int, miss: float = MISS) -> int:
    """Trees in which a pair at the least similarity shares no leaf in less than miss of cases: a path ends where none of a node's coordinates agrees."""
    lost = 0.0
    for _ in range(10_000):
        lost = (1 - percent / 100 * (1 - lost)) ** branches
    return max(1, int(np.ceil(np.log(miss) / np.log(lost)))) if 0 < lost < 1 else 1


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, trees: int | None = None, branches: int = BRANCHES, leaf: int = LEAF, dense: float = DENSE, depth: int = DEPTH, block: int = BLOCK, key: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (its own component_id) for each row of docs (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. Null texts and texts
    without words have no set and stand alone; texts of fewer words than a shingle are one shingle. Rows with equal
    sets are one class from the start, so copies of any number cost one comparison; of rows equal in id and set all
    are kept together or none. A row without an id stands alone and is kept. Links are confirmed on full sets; a
    link is missed only if no tree brings the pair together (see MISS; trees are as many as that takes unless they are
    given). An empty table gives an empty result;
    other columns are not read.

    key: columns of docs that tell rows of one id and unlike texts apart. They are in the result too, and component,
    which unlike component_id tells components of one smallest id apart; null for rows that stand alone.
    """
    docs = docs.select("doc_id", *key, "text")
    names = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in key)
    base = staged(per_text(docs, describe(shingle), f"doc_id bigint, {names}n bigint, f bigint, g bigint, sketch binary", ("doc_id", *key)), "sketches")
    named = base.where("n > 0 and doc_id is not null")
    one_of = F.min(F.struct("doc_id", *key)) if key else F.struct(F.min("doc_id").alias("doc_id"))
    classes = named.groupBy("f", "g", "n").agg(one_of.alias("one"), F.first("sketch").alias("sketch"))
    classes = staged(classes.select("f", "g", "n", F.col("one.doc_id").alias("rep"), *(F.col("one")[c].alias(f"rep_{c}") for c in key), "sketch").withColumn("cls", F.monotonically_increasing_id()), "classes")
    similar = percent / 100
    least = int(np.floor(SKETCH * similar - MARGIN * np.sqrt(SKETCH * similar * (1 - similar))))
    nodes = leaves(classes, trees or trees_for(percent, branches), branches, leaf, dense, depth).select(F.col("node").alias("key"), "cls", F.ceil(F.col("size") / block).alias("parts"))
    maybe = connected_components(compared(nodes, classes.select("cls", F.col("sketch").alias("value")), compare_sketches(least)))
    # classes that may be linked, with one text each, in groups that hold all their possible partners
    members = staged(maybe.join(classes, F.col("node") == F.col("cls")).select("root", "cls", "rep", *(f"rep_{c}" for c in key), "f", "n"), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    # members grow with the corpus, so that they are merged with the texts at any size and not broadcast at some
    texts = docs.where("text is not null").join(members.select("root", "cls", "rep", *(f"rep_{c}" for c in key), "f").hint("merge"), reduce(and_, (docs[c] == F.col(r) for c, r in (("doc_id", "rep"), *((c, f"rep_{c}") for c in key)))))
    # an id that several texts have may bring others than the class's own, where no key tells them apart
    one = per_text(texts, lambda c: {"own": describe(shingle)(c)["f"]}, "root bigint, cls bigint, f bigint, text string, own bigint", ("root", "cls", "f", "text")).where("own = f") if not key and _ids_repeat(named) else texts
    grouped_members = members.join(sizes, "root").select(F.col("root").alias("key"), "cls", "parts")
    linked = connected_components(compared(grouped_members, one.select("cls", F.col("text").alias("value")), confirm(shingle, percent)))
    ids = linked.join(classes.select("cls", "rep"), F.col("node") == F.col("cls")).select("cls", "root", "rep")
    least_id = ids.groupBy("root").agg(F.min("rep").alias("component"))
    component = ids.join(least_id, "root").select("cls", "component", "root")
    known = classes.join(component, "cls", "left").select("f", "g", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("root", "cls").alias("root"))
    found = base.select("doc_id", *key, "n", "f", "g").join(known, ["f", "g", "n"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    component_id = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    own = (*key, F.when(~alone, F.col("root")).alias("component")) if key else ()
    return found.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"), *own)


def _ids_repeat(named: DataFrame) -> bool:
    return not named.groupBy("doc_id").agg(F.count_distinct("f", "g").alias("k")).where("k > 1").isEmpty()
