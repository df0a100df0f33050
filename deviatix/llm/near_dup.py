"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union-sketch estimates, exact Jaccard.

Documents with equal shingle sets are one class, whose representative has the smallest id; all work on pairs is
between representatives. A sketch holds the ``K`` least shingle hashes of a set. An inverted list holds the documents
that retain one value.

The common values of two sets among the K least of their union are a sample of it without replacement. At the
threshold, fewer than ``least_common`` of them are common with a probability below 1e-14 (Hoeffding's bound for a pair;
a set of up to 0.8 K shingles, or whatever the threshold, is retained whole, and so are its partners: there the bound
is certain). Sets of k retained values, m of which are common, share one of the k - m + 1 rarest of either, by one order
of all lists (size, value). So a document enters the lists of its k - m + 1 rarest retained values alone, and a passage
that many unlike documents share makes no lists where it is less than half of them.

Links matter only as far as they join components, and groups of near copies can be large, so pairs are met in three
steps. Documents that overlap strongly with the first document of a list, or share a list that is still long, form
groups; each document's best overlap is estimated and verified: one pair a document. Groups with many documents still
apart are split by the rarest shingles of whole sets: pages that share most of a template, but less than the threshold,
part for good. Within a group all pairs of still different components are compared in blocks of bounded size, as matrix products: sketches first, then the whole sets of
those that sketches don't rule out. Pairs of different groups that share a list, which then is short, are estimated
from union sketches and verified one by one. So every pair that shares a list is decided, and the rows of pairs grow as
those of the lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sized_join_hint, written

#: Values that a sketch retains.
K = 96
#: Documents from which a list is long: they become one group.
LONG = 64
#: Probability below which a pair at the threshold may have fewer common retained values than counted on.
MISS = 1e-14
#: Ids (8 bytes each, counted) up to which they are broadcast to fetch their texts.
BROADCAST_IDS = 200_000
#: Shared lists from which an overlap is strong.
STRONG = 8
#: Documents of either side of a block, about.
BLOCK = 256


def least_common(percent: int) -> int:
    """Retained values that the sketches of two sets at the threshold have in common at least."""
    t = percent / 100
    bound = lambda x: math.exp(-K * ((x * math.log(x / t) if x else 0) + (1 - x) * math.log((1 - x) / (1 - t))))
    return max(m for m in range(int(t * K)) if m == 0 or bound(m / K) <= MISS)


def _mixed(x: np.ndarray) -> np.ndarray:
    m = np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * m
    x = (x ^ (x >> np.uint64(32))) * m
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, shingle: int, known: dict[bytes, int]) -> np.ndarray:
    """The set of hashed shingles (sorted, distinct, 64 bits) of a text: A-Z lower-cased, words between ASCII spaces.

    Fewer words than a shingle: all of them are one. ``known`` remembers words' hashes.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces alone
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > 300_000:
        known.clear()
    get, new = known.get, xxhash.xxh3_64_intdigest
    h = np.array([get(w) or known.setdefault(w, new(w)) for w in words], np.uint64)
    n = min(shingle, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mixed(out + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), hi, lo (128-bit hash of the set), sketch; a row per input row."""
    import hashlib

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            n, keys, parts = [], [], []
            for text in batch.column(1):
                s = shingle_hashes(text.as_py(), shingle, known)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                parts.append(s[:K].view(np.int64))
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            sketch = pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), sketch], names=["id", "n", "hi", "lo", "sketch"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "id long, n long, hi long, lo long, sketch array<long>")


def full_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str, ids: DataFrame, n_ids: int) -> DataFrame:
    """node, values: the whole shingle sets of the documents in ``ids``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):  # sets are larger than their texts
                part = batch.slice(a, 500)
                sets = [shingle_hashes(t.as_py(), shingle, known).view(np.int64) for t in part.column(1)]
                values = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=["node", "values"])

    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    own = own.join(sized_join_hint(ids, n_ids, BROADCAST_IDS), "node", "left_semi")
    return own.mapInArrow(run, "node long, values array<long>")


def rarest_lists(sets: DataFrame, values: str, common) -> DataFrame:
    """key, node: the lists of two documents or more, of each document's rarest values: so many that two documents with
    ``common`` of their ``values`` in common meet in one."""
    keys = sets.select(F.explode(values).alias("key"), "node", F.size(values).alias("k"), common.alias("common"))
    size = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    shared = keys.join(size.hint("merge"), "key")
    own = Window.partitionBy("node")  # a document's values
    # values that no other document has come first
    rank = F.col("k") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("size", "key"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= F.col("k") - F.col("common") + 1).select("key", "node")


def inverted_lists(reps: DataFrame, percent: int) -> DataFrame:
    """key, node: the lists of retained values."""
    whole = 100 * F.col("n") <= percent * K
    return rarest_lists(reps, "sketch", F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(least_common(percent)))


def several_components(members: DataFrame) -> DataFrame:
    """The members of groups with more than one component."""
    several = members.groupBy("grp").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where(F.col("c0") != F.col("c1")).select("grp")
    several = written(several, "several")
    return members.join(sized_join_hint(several, several.count(), BROADCAST_IDS), "grp", "left_semi")


def split_groups(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members of groups with many documents outside the largest component, in smaller groups: of documents that
    share a list of their rarest shingles, of the whole sets now. A document without such a list has no partner.

    Sets of n shingles at the threshold share ``percent`` of a hundred of n, so these lists miss nothing."""
    comps = members.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("m"))
    large = comps.groupBy("grp").agg((F.sum("m") - F.max("m")).alias("rest")).where(F.col("rest") > BLOCK).select("grp")
    large = written(large, "large-groups")
    if not (n := large.count()):
        return members
    large = sized_join_hint(large, n, BROADCAST_IDS)
    inside = written(members.join(large, "grp", "left_semi"), "large-members")
    whole = sets.join(inside.select("node").hint("merge"), "node", "left_semi")
    lists = written(rarest_lists(whole, "values", F.ceil(F.size("values") * percent / 100)), "whole-lists")
    hubs = lists.groupBy("key").agg(F.min("node").alias("a"))
    edges = lists.join(hubs.hint("merge"), "key").select("a", F.col("node").alias("b"))
    groups = connected_components(edges).select("node", F.col("comp").alias("grp"))
    return members.join(large, "grp", "left_anti").unionByName(inside.drop("grp").join(groups.hint("merge"), "node").select(*members.columns))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) of every node of ``edges`` (a, b), by alternating large and small
    stars: groupings and joins only; each round is written to the shared folder."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        old, edges = edges, written(small, "edges")
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == mark:
            break
        mark = now
    # stars: each node but the least one points to it
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def roots(parents: DataFrame) -> DataFrame:
    """node, root, for a forest of (node, parent) in which no parent has a greater id than its node: pointers jump."""
    now = old = written(parents.select("node", F.col("parent").alias("root")), "pointers")
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = written(now.join(up.hint("merge"), "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")), "pointers")
        moved = jumped.where("moved").limit(1).count()
        discard(old)
        if not moved:
            return jumped.select("node", "root")
        now, old = jumped.select("node", "root"), jumped


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches do not rule the threshold out."""
    one = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    est = pairs.hint("merge").join(one, "a").join(two.hint("merge"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    both = F.array_union("sa", "sb")
    shared = F.array_intersect("sa", "sb")
    # the union's sketch is the least values of both sketches; its share that both sets hold estimates the similarity
    union = F.slice(F.array_sort(F.transform(both, _unsigned_order)), 1, K)
    hit = F.size(F.array_intersect(union, F.transform(shared, _unsigned_order)))
    whole = F.greatest("na", "nb") <= K
    return est.where(F.when(whole, 100 * F.size(shared) >= percent * F.size(both)).otherwise(hit >= least_common(percent))).select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    exact = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("values").alias("va")), "a").join(sets.select(F.col("node").alias("b"), F.col("values").alias("vb")).hint("merge"), "b")
    common = F.size(F.array_intersect("va", "vb"))
    return exact.where(100 * common >= percent * (F.size("va") + F.size("vb") - common)).select("a", "b").distinct()


def intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices over some columns at a time."""
    size = np.array(list(map(len, sets)))
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (c, c + columns))
        dense = np.zeros((len(sets), columns), np.float32)
        dense[row[a:b], column[a:b] - c] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join different components within a group. ``members``: node, grp, comp, of groups with several.

    A group's largest component is known to hold together, so its documents meet only the others, and those each
    other, in blocks of about ``BLOCK`` documents a side. A block hands back links that join its components, no more
    than it has documents.
    """
    import pandas as pd

    n = members.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("m"))
    top = n.groupBy("grp").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("n_main"), (F.sum("m") - F.max("m")).alias("n_rest"))
    top = written(top, "group-sizes")
    pieces = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    placed = members.join(sized_join_hint(top, top.count(), BROADCAST_IDS), "grp").withColumns({"p_main": pieces("n_main"), "p_rest": pieces("n_rest"), "is_main": F.col("comp") == F.col("main")})
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("p_main")).otherwise(F.col("p_rest"))).cast("int")
    placed = placed.withColumn("own", own)
    to = lambda last, make: F.transform(F.sequence(F.lit(0), last - 1), make)
    as_rest = to(F.col("p_rest"), lambda k: F.struct(F.lit(0).alias("kind"), F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j")))
    to_main = to(F.col("p_main"), lambda k: F.struct(F.lit(1).alias("kind"), F.col("own").alias("i"), k.alias("j")))
    as_main = to(F.col("p_rest"), lambda k: F.struct(F.lit(1).alias("kind"), k.alias("i"), F.col("own").alias("j")))
    cells = placed.select("node", "grp", "comp", F.explode(F.when(F.col("is_main"), as_main).otherwise(F.concat(as_rest, to_main))).alias("cell"))
    filled = cells.hint("merge").join(sets, "node").select("grp", "cell.kind", "cell.i", "cell.j", "node", "comp", "values")

    least = least_common(percent)

    def links(block: pd.DataFrame) -> pd.DataFrame:
        nodes, comps = block["node"].to_numpy(), block["comp"].to_numpy()
        sets = list(block["values"])
        size = np.array(list(map(len, sets)))
        # sets are in the order of their hashes: their first values are their sketches
        common = intersections([x[:K] for x in sets])
        enough = np.where(100 * size <= percent * K, -(-size * percent // 100), least)
        maybe = (common >= np.minimum(enough[:, None], enough[None])) & (comps[:, None] != comps[None])
        some = np.flatnonzero(maybe.any(1))
        if not len(some):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        nodes, comps, size = nodes[some], comps[some], size[some]
        common = intersections([sets[k] for k in some])
        a, b = np.nonzero(np.triu(100 * common >= percent * (size[:, None] + size[None] - common), 1) & maybe[np.ix_(some, some)])
        up: dict = {}

        def find(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        kept = []
        for x, y in zip(a, b, strict=True):
            p, q = find(comps[x]), find(comps[y])
            if p != q:
                up[max(p, q)] = min(p, q)
                kept.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return filled.groupBy("grp", "kind", "i", "j").applyInPandas(links, "a long, b long")


def _unsigned_order(x):
    """Signed longs in the order of their unsigned values, in which sketches are cut."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id`` (the smallest id that links reach), ``kept``.

    Two documents are linked if 100 * |common shingles| >= ``percent`` * |all their shingles|; links are confirmed on
    whole sets. Documents without words have an empty set and are linked with nothing. Rows that share an id are one
    document that has each of their texts. A null id takes no part: no component, kept. Other columns are not read.
    ``percent``: 50 to 99.
    """
    if not 50 <= percent <= 99:
        raise ValueError("a threshold of 50 to 99 percent")
    drawn = written(sketches(docs, shingle, id_col, text_col), "sketches")
    some = drawn.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = written(some.groupBy("hi", "lo").agg(F.min("id").alias("node")), "classes")
    reps = some.select(F.col("id").alias("node"), "n", "hi", "lo", "sketch").join(classes.hint("merge"), ["hi", "lo", "node"]).dropDuplicates(["hi", "lo", "node"]).select("node", "n", "sketch")
    reps = written(reps, "reps")
    kept = written(inverted_lists(reps, percent), "kept-lists")
    hubs = kept.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where(F.col("size") > 1)
    lists = written(kept.join(hubs.hint("merge"), "key"), "lists")
    in_lists = written(reps.join(lists.select("node").distinct().hint("merge"), "node", "left_semi"), "list-sketches")
    overlaps = lists.where(F.col("node") != F.col("hub")).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("shared"), F.max("size").alias("size"))
    strong = written(overlaps.where((F.col("shared") >= STRONG) | (F.col("size") > LONG)), "strong")
    groups = written(connected_components(strong.select(F.col("hub").alias("a"), F.col("node").alias("b"))).select("node", F.col("comp").alias("grp")), "groups")
    best = strong.groupBy("node").agg(F.max(F.struct("shared", -F.col("hub"))).alias("m")).select("node", (-F.col("m.col2")).alias("parent"))
    grouped = lists.select("key", "node").join(groups.hint("merge"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    mixed = grouped.groupBy("key").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where(F.col("g0") != F.col("g1")).select("key")
    meet = written(grouped.join(mixed.hint("merge"), "key", "left_semi"), "meetings")
    other = meet.select("key", F.col("node").alias("b"), F.col("grp").alias("grp_b"))
    chance = meet.withColumnRenamed("node", "a").join(other.hint("merge"), "key").where((F.col("grp") != F.col("grp_b")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    near = best.select(F.col("parent").alias("a"), F.col("node").alias("b"))
    pairs = likely(near, in_lists, percent).withColumn("chance", F.lit(False)).unionByName(likely(chance, in_lists, percent).withColumn("chance", F.lit(True)))
    pairs = written(pairs, "likely")
    # whole sets of all that is compared: the groups, and what met by chance and may be similar
    ids = groups.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = written(ids, "compared")
    comps = sets = links = more = members = parted = None
    if n_ids := ids.count():
        sets = written(full_sets(docs, shingle, id_col, text_col, ids, n_ids), "sets")
        links = written(verified(pairs.where(~F.col("chance")), sets, percent), "near-links")
        first = roots(links.select(F.col("b").alias("node"), F.col("a").alias("parent")))
        members = groups.join(first.hint("merge"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        members = written(several_components(members), "members")
        parted = written(several_components(split_groups(members, sets, percent)), "members")
        more = written(block_links(parted, sets, percent).unionByName(verified(pairs.where("chance"), sets, percent)), "more-links")
        comps = first.withColumnRenamed("root", "comp")
        if more.limit(1).count():
            # components joined by further links: the same over components instead of documents
            root_of = first.select(F.col("node"), F.col("root"))
            a = more.join(root_of.withColumnsRenamed({"node": "a", "root": "ra"}).hint("merge"), "a", "left").join(root_of.withColumnsRenamed({"node": "b", "root": "rb"}).hint("merge"), "b", "left")
            top = connected_components(a.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
            every = comps.select("node", "comp").unionByName(top.select("node", F.col("node").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
            comps = every.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("least")).hint("merge"), "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"))
        comps = written(comps, "components")
    of_class = classes if comps is None else classes.join(comps.hint("merge"), "node", "left")
    of_class = of_class.select("hi", "lo", F.coalesce("comp", "node").alias("comp") if comps is not None else F.col("node").alias("comp"))
    of_class = written(of_class, "class-components")
    discard(classes, reps, kept, lists, in_lists, strong, groups, meet, pairs, ids, sets, links, more, members, parted, comps)
    # merge join: a class may hold a third of all documents, and Spark splits such partitions
    out = drawn.select("id", "n", "hi", "lo").join(of_class.hint("merge"), ["hi", "lo"], "left")
    found = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")))
    return out.select("id", F.col("n").alias("n_shingles"), found.alias("component_id"), (found.isNull() | (found == F.col("id"))).alias("kept"))
