"""Exact set-similarity self join on word shingles by vertical partitioning of the global shingle order.

The order is that of the shingles' 64-bit hashes, frequent ones last. It is cut into fragments, many enough for a
document's size class that two documents which link agree on at least one whole fragment (their differences are fewer
than the fragments). Fragments with equal content bring documents together; the verdict counts the overlap of each pair
in each of a few wide fragments separately and sums it per pair.

Documents with equal sets are one node from the start, named by the hash of the set. Inside a fragment's bucket nobody is
paired with everybody: each bucket has one leader, found as a grouped minimum, and each node is held against those few of
its leaders with which it shares most buckets. While buckets hold several components, the same is done with a few more
leaders of each, chosen by hash. These rounds only spare work; nodes of buckets that stay open go on to a search that
misses nothing: their shingles are ordered by rarity among them, and nodes meet on the shingles of their prefixes, which
in a group of near copies are the edits and not the common text; offsets and lengths drop most of these pairs. A few pairs
of each node are counted first, then all others that no component holds by now.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import PACKED, packed, shared_keys
from .common import broadcast_if_small, components, durable, fresh_names, is_small, release
from .tokens import distinct, frugal, lowered, mix, prefix_hash, shingles, span_hash, text_slices, words

#: Lower ends of the size classes grow by this factor.
CLASS_RATIO = 1.4
#: Wide fragments in which the overlap of a pair is counted.
WIDE = 8
#: Shingles that stand in many documents come last in the order: at most so many, each seen in so many documents of an
#: Arrow batch. Any choice of them gives the same links; it only spares meetings on common passages.
MOST_FREQUENT, SEEN_OFTEN = 100_000, 4

#: Leaders of an open bucket in a round, about; rounds at most; leaders that a node is held against in a round; pairs of a
#: node of the greater component that are counted before all others. None of them changes the components: what they leave
#: open is searched whole.
LEADERS, ROUNDS, NEAREST, EARLY = 8, 1, 6, 48
#: Keys of a block, about, and keys that a task packs at a time.
BLOCK, CHUNK = 1 << 20, 1 << 19

_U = np.uint64


def class_ends(limit: int = 1 << 40) -> np.ndarray:
    ends = [1]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, int(ends[-1] * CLASS_RATIO)))
    return np.array(ends, np.int64)


def fragments_of(ends: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Fragments of each size class, and how many of them may be empty.

    One more than sets may differ in, and as many as chance leaves empty in the smallest sets of the class.
    """
    differ = (ends[1:] - 1) * (den - num) // num
    spare = np.ones(len(differ))
    for _ in range(30):
        empty = (differ + 1 + spare) * np.exp(-ends[:-1] / (differ + 1 + spare))
        spare = np.minimum(np.ceil(empty + 3 * np.sqrt(empty) + 1), differ + 1)
    spare = np.where(differ == 0, 0, spare).astype(np.int64)
    return np.where(differ == 0, 1, differ + 1 + spare), spare


def fragment_keys(sh: np.ndarray, row: np.ndarray, sizes: np.ndarray, num: int, den: int, frequent: np.ndarray) -> list[np.ndarray]:
    """For each row the keys of its fragments; sh and row are sorted and distinct, frequent is sorted.

    Frequent shingles are left out first. Of two sets that link, at least one fragment more than may be empty is equal;
    so they meet on one with shingles in it, unless both have more empty ones. Those sets are cut once more, with
    their frequent shingles, and then told with their empty fragments if there are too many even so.
    """
    ends = class_ends()
    count, spare = fragments_of(ends, num, den)
    own = np.searchsorted(ends, sizes, "right") - 1
    keys: list[list[np.ndarray]] = [[] for _ in sizes]
    at = np.searchsorted(frequent, sh)
    common = np.zeros(len(sh), bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] == sh
    # a set also stands in the class below if a partner there can be large enough
    for cls, who in ((own, sizes > 0), (own - 1, (sizes > 0) & (own > 0) & (sizes * num < ends[own] * den))):
        cls = np.maximum(cls, 0)
        parts = count[cls].astype(np.uint64)
        for whole in (False, True):
            use = who[row] if whole else who[row] & ~common
            s, r = sh[use], row[use]
            full = np.zeros(len(sizes), np.int64)
            if len(s):
                frag = ((s >> _U(32)) * parts[r]) >> _U(32)
                begin = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (frag[1:] != frag[:-1])])
                total = np.add.reduceat(mix(s ^ _U(0x5851F42D4C957F2D)), begin)
                many = np.diff(np.r_[begin, len(s)]).astype(np.uint64)
                doc, part = r[begin], frag[begin]
                key = mix(mix(total + many) + part * _U(0x9E3779B97F4A7C15) + (2 * cls[doc] + whole).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
                cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                for lo, hi in zip(cut, np.r_[cut[1:], len(doc)], strict=True):
                    keys[doc[lo]].append(key[lo:hi])
                    full[doc[lo]] = hi - lo
                    if whole and count[cls[doc[lo]]] - (hi - lo) > spare[cls[doc[lo]]]:
                        gone = np.setdiff1d(np.arange(count[cls[doc[lo]]], dtype=np.uint64), part[lo:hi])
                        keys[doc[lo]].append(mix(gone * _U(0x9E3779B97F4A7C15) + _U((int(cls[doc[lo]]) + 1) * 0xA0761D6478BD642F % (1 << 64))))
            who = who & (count[cls] - full > spare[cls])
    return [np.concatenate(k) if k else np.zeros(0, np.uint64) for k in keys]


def _frequent(batches, n: int):
    """Shingles of many documents of the batch, and of how many."""
    for batch in frugal(batches):
        found = [sh for _, _, sh, _ in text_sets(batch.column(0), n)]
        sh, seen = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
        often = seen >= SEEN_OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(sh[often].view(np.int64)), pa.array(seen[often].astype(np.int64))], names=["sh", "seen"])


def text_sets(column: pa.Array, n: int):
    """(first row, sizes, shingle hashes, their rows) of slices of a text column."""
    for at, data, offsets in text_slices(column):
        low = lowered(data)
        start, end, row = words(low, offsets)
        sh, row = distinct(*shingles(span_hash(prefix_hash(low), start, end), row, n))
        yield at, np.bincount(row, minlength=len(offsets) - 1).astype(np.int64), sh, row


def _node(sizes: np.ndarray, sh: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hash of each row's set."""
    acc = np.zeros(len(sizes), np.uint64)
    np.add.at(acc, row, mix(sh + _U(0x8CB92BA72F3D8DD7)))
    return mix(acc + sizes.astype(np.uint64))


def _sets(batches, n: int):
    """d, t, doc_id, n_shingles and node of each row: columns d, t, doc_id, text."""
    for batch in frugal(batches):
        for at, sizes, sh, row in text_sets(batch.column(3), n):
            kept = [batch.column(i).slice(at, len(sizes)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes), pa.array(_node(sizes, sh, row).view(np.int64))], names=["d", "t", "doc_id", "n_shingles", "node"])


def _keyed(batches, n: int, num: int, den: int, frequent: np.ndarray):
    for batch in frugal(batches):
        for _, sizes, sh, row in text_sets(batch.column(0), n):
            some = sizes > 0
            keys = fragment_keys(sh, row, sizes, num, den, frequent)
            yield [k for k, s in zip(keys, some, strict=True) if s], _node(sizes, sh, row)[some], sizes[some]


def _wide(batches, n: int):
    for batch in frugal(batches):
        nodes = np.asarray(batch.column(0))
        for at, sizes, sh, row in text_sets(batch.column(1), n):
            part = (sh >> _U(61)).astype(np.int64) * WIDE // 8
            begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(sh) else np.zeros(0, int)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(sh)], pa.int32()), pa.array(sh.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at + row[begin]]), pa.array(sizes[row[begin]]), pa.array(part[begin].astype(np.int32)), lists], names=["node", "n", "part", "items"])


def _nearest(pairs: DataFrame, of: str, most: int) -> DataFrame:
    """Of pairs (a, b), one row for each key that brings them together, for each `of` the few with most keys in common."""
    often = pairs if "same" in pairs.columns else pairs.groupBy("a", "b").agg(F.count("*").alias("same"))
    place = F.row_number().over(Window.partitionBy(of).orderBy(F.desc("same"), F.xxhash64("a", "b"), "a", "b"))
    return often.withColumn("place", place).where(F.col("place") <= most).select("a", "b")


def _linked(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of nodes those that link: partial overlaps by fragment, summed."""
    pairs = durable(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if is_small(nodes):
        wide = wide.join(F.broadcast(nodes), "node", "left_semi")
    left = pairs.join(wide.select(F.col("node").alias("a"), F.col("n").alias("na"), "part", F.col("items").alias("ia")), "a")
    right = wide.select(F.col("node").alias("b"), F.col("n").alias("nb"), "part", F.col("items").alias("ib"))
    partial = left.join(right, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ia", "ib")).alias("same"))
    total = partial.groupBy("a", "b").agg(F.sum("same").alias("same"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return total.where(F.lit(den) * F.col("same") >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")


def _open_buckets(bucket: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the links, and the rows of buckets with several of them: key, node, n, comp, many (of the bucket)."""
    comp = durable(components(links), "components")
    grouped = bucket.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    several = grouped.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).where("lo < hi")
    return comp, durable(grouped.join(several.select("key", "many"), "key"), "open-buckets")


def _alike(num: int, den: int, n: str, m: str):
    return F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)


def _prefix_pairs(left: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes of different components, a row for each shingle of their rarity-ordered prefixes at fitting places."""
    nodes = durable(left.select("node", "comp", "n").distinct(), "open-nodes")
    rest = wide.join(broadcast_if_small(nodes), "node", "left_semi").select("node", F.explode("items").alias("sh"))
    often = rest.groupBy("sh").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one node only come first in the order and can meet nobody; they only take up places in it
    known = rest.join(often, "sh").join(nodes, "node").withColumn("single", F.col("n") - F.count("*").over(Window.partitionBy("node")))
    placed = known.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "sh")) + F.col("single"))
    prefix = durable(placed.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1).select("sh", "node", "comp", "n", "rank"), "prefixes")
    other = prefix.select("sh", *[F.col(c).alias(f"{c}2") for c in ("node", "comp", "n", "rank")])
    need = F.ceil((F.col("n") + F.col("n2")) * num / (num + den))
    fits = _alike(num, den, "n", "n2") & (1 + F.least(F.col("n") - F.col("rank"), F.col("n2") - F.col("rank2")) >= need)
    return prefix.join(other, "sh").where((F.col("comp") < F.col("comp2")) & fits).select(F.col("node").alias("a"), F.col("node2").alias("b"))


def jaccard_groups(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(d, t, doc_id, n_shingles, node of each row), and (node, group) of the nodes that link or have several rows.

    d and t name a row: its doc_id, the least long for null, and the hash of its text.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t"), F.col("doc_id").cast("long").alias("doc_id")]
    sizes = durable(docs.select(*key, "text").mapInArrow(lambda b: _sets(b, n), "d long, t long, doc_id long, n_shingles long, node long"), "sizes")
    seen = docs.select("text").mapInArrow(lambda b: _frequent(b, n), "sh long, seen long").groupBy("sh").agg(F.sum("seen").alias("seen"))
    frequent = np.sort(np.array([r[0] for r in seen.orderBy(F.desc("seen"), "sh").limit(MOST_FREQUENT).select("sh").collect()], np.int64).view(np.uint64))
    # keys of all sets, about: fragments and those of the class below, and a few for each small set
    total = sizes.agg(F.sum("n_shingles"), F.count("*")).first()
    blocks, chunk = 1 + int(((total[0] or 0) * 2.5 * (den - num) / num + 4 * total[1]) / BLOCK), CHUNK
    rows = docs.select("text").mapInArrow(lambda b: packed(_keyed(b, n, num, den, frequent), blocks, chunk), PACKED)
    shared = rows.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(lambda b: shared_keys(b, num, den), "key long, owner long, size int")
    bucket = durable(shared.select("key", F.col("owner").alias("node"), F.col("size").alias("n")), "buckets")
    classes = sizes.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("d", "t")).alias("p"), F.count("*").alias("rows"))
    involved = durable(classes.join(bucket.select("node").distinct(), "node", "left_semi").select("node", "p.*"), "involved")
    texts = docs.select(*key[:2], "text").join(broadcast_if_small(involved), ["d", "t"]).groupBy("node").agg(F.min("text").alias("text"))
    wide = durable(texts.mapInArrow(lambda b: _wide(b, n), "node long, n long, part int, items array<long>"), "wide")
    lead = bucket.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead")).select("key", F.col("lead.node").alias("b"), F.col("lead.n").alias("m"))
    first = bucket.join(lead, "key").where((F.col("node") != F.col("b")) & _alike(num, den, "n", "m"))
    links = durable(_linked(_nearest(first.select(F.col("node").alias("a"), "b"), "a", NEAREST), wide, num, den), "links")
    comp, left = _open_buckets(bucket, links)
    for k in range(ROUNDS):
        if left.isEmpty():
            break
        leads = left.where(F.pmod(F.xxhash64("node", F.lit(k)), F.greatest(F.lit(1), F.floor(F.col("many") / LEADERS))) == 0)
        leads = leads.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("other"))
        pairs = left.join(leads, "key").where((F.col("comp") != F.col("other")) & _alike(num, den, "n", "m")).select(F.col("node").alias("a"), "b")
        more = durable(_linked(_nearest(pairs, "a", NEAREST), wide, num, den), "links")
        if more.isEmpty():
            break
        links, spent = durable(links.union(more), "links"), [links, more, comp, left]
        comp, left = _open_buckets(bucket, links)
        release(*spent)
    if not left.isEmpty():
        pairs = durable(_prefix_pairs(left, wide, num, den).groupBy("a", "b").agg(F.count("*").alias("same")), "open-pairs")
        near = durable(_linked(_nearest(pairs, "b", EARLY), wide, num, den), "links")
        known = durable(components(links.union(near)), "components")
        own = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        other = known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
        rest = pairs.join(broadcast_if_small(own), "a", "left").join(broadcast_if_small(other), "b", "left").where(apart).select("a", "b")
        more = durable(_linked(rest, wide, num, den), "links")
        spent = [comp, pairs, near, more]
        comp = known
        if not more.isEmpty():
            comp = durable(components(links.union(near).union(more)), "components")
            spent.append(known)
        release(*spent)
    release(links, left, wide, bucket, involved)
    named = comp.select("node", F.col("component").alias("group"))
    alone = classes.where("rows > 1").select("node").join(named, "node", "left_anti").select("node", F.col("node").alias("group"))
    return sizes, durable(named.union(alone), "groups")


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when den * |intersection| >= num * |union| of their sets of n-word shingles (words are runs
    without ASCII white space, A-Z lowered; a text with fewer than n words is one shingle). component_id is the smallest
    doc_id that links reach. Null, empty and wordless texts have no shingles and link with nothing. Rows without doc_id
    link like all others and count for nobody's smallest id; rows that share a doc_id but not their text are nodes of
    their own; repeated rows come out as often as they came in. Other columns, whatever their names, are left out. A very
    long text is one set like any other, in memory by itself; an empty table gives no rows.
    """
    sizes, groups = jaccard_groups(docs, n, num, den)
    few = broadcast_if_small(groups)
    named = sizes.where("n_shingles > 0").join(few, "node")
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    few = broadcast_if_small(durable(groups.join(least, "group").select("node", "component_id", F.lit(True).alias("found")), "component-ids"))
    out = sizes.withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node"))).join(few, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component of jaccard_classes the row with the smallest doc_id, then hash of the text; all columns.

    Rows without doc_id stay only where their component has no row with one. Texts without words link with nothing and
    stay. Of rows alike in doc_id and text, one stays if they have words: the first by its columns as JSON.
    """
    sizes, groups = jaccard_groups(docs, n, num, den)
    rows = sizes.where("n_shingles > 0").join(broadcast_if_small(groups), "node").select("group", F.struct(F.col("doc_id").isNull().alias("none"), "d", "t").alias("p"))
    best = durable(rows.groupBy("group").agg(F.min("p").alias("best")), "kept")
    gone = durable(rows.join(broadcast_if_small(best), "group").where("p != best").select("p.d", "p.t").distinct(), "gone")
    twice = durable(rows.groupBy("p").agg(F.count("*").alias("n")).where("n > 1").select("p.d", "p.t"), "repeated")
    d, t, said = fresh_names(docs, "d", "t", "said")
    own = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(d), F.xxhash64("text").alias(t))
    left = own.join(broadcast_if_small(gone.toDF(d, t)), [d, t], "left_anti")
    again = broadcast_if_small(twice.toDF(d, t))
    once = left.join(again, [d, t], "left_semi").withColumn(said, F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])))
    once = once.groupBy(d, t).agg(F.min_by(F.struct(*docs.columns), said).alias("row")).select("row.*")
    return left.join(again, [d, t], "left_anti").select(*docs.columns).union(once.select(*docs.columns))
