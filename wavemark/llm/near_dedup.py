"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 64 symbols of 16 bits, one from each of 64 minimum hashes of a document's shingle
set. Two documents whose sets overlap by 0.85 differ in about 9.6 symbols; the join finds every pair
that differs in at most ``reach(85)`` = 23, and for other thresholds in as many as a true link, at
the threshold itself, exceeds at most once in a hundred thousand (MISSED; far less above it). By the
pigeonhole principle such a pair has, among 12 chunks of 5 or 6 symbols (one chunk for every two
errors), one with at most one error. Each document is therefore filed under every chunk with every
one symbol left out, 64 keys in all: a pair with one error or none in a chunk shares the key that
leaves out the wrong symbol.

Documents with equal sets are one node from the start. In a bucket of equal keys each node is first
compared with the smallest node: numbers of pairs linear in the bucket. Links confirmed on the full
sets merge nodes into components. What is then left are buckets that hold several components, which
boilerplate makes large without a link in them. Nodes that such buckets connect form a cluster, and
each is described by how its set differs from the cluster's core, the shingles that more than half
of the cluster has. Two sets differ exactly where these differences do, so

* nodes so near the core that they must be linked, whatever their differences have in common, are
  linked through the one nearest to it;
* any other link needs a certain number of shared differences, and therefore one among the rarest of
  each side: nodes meet by a prefix of their differences, rarest first, and the places in it rule out
  most pairs before they are made.

Differences that the same nodes of a cluster have, or just all the others, are one atom: two nodes
differ in all of it or agree. Texts from a template have few, heavy atoms, each held by a large part
of the cluster, and pairs by a shared difference alone would grow with the square of it. But a link
allows a bounded number of shingles to differ, hence at most ERRORS heavy atoms. These are dealt into
GROUPS groups; linked nodes agree in all but ERRORS groups, whichever they are, and nodes that share a
frequent difference meet only under what they have in all the other groups.

All bounds are exact, so no link that could join two components is left out, and boilerplate that
a whole cluster shares, however large, makes no pairs.

Keys that very many rows have are met in joins and partial aggregates alone, never gathered. Large
clusters are spread over tasks; where a bucket, or a node that many links lead to, is hot, adaptive
execution splits the joins' skewed partitions, which must not be switched off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import free_name
from .shingles import mix, shingle_sets
from .skew import hot_keys, left_join_spread
from .storage import written_table
from .tokens import text_slices

SYMBOLS = 64
#: The chance of a link of exactly the threshold's overlap to lie beyond the distance searched.
MISSED = 1e-5
#: Heavy atoms in which linked nodes may differ, and groups of them; a difference that more nodes of a
#: cluster have is frequent.
ERRORS, GROUPS, FREQUENT = 2, 5, 32
#: Below, some chunks have two symbols and their keys one, which many unrelated documents share.
LEAST_PERCENT = 62


def reach(percent: int) -> int:
    """The distance to search: two signatures whose sets overlap by ``percent`` in a hundred differ
    in more symbols with a chance of at most MISSED, by the binomial law."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    miss, beyond = 1 - percent / 100, 0.0
    for far in range(SYMBOLS, 0, -1):
        beyond += math.comb(SYMBOLS, far) * miss**far * (1 - miss) ** (SYMBOLS - far)
        if beyond > MISSED:
            return far
    return 0


def chunks_for(far: int) -> int:
    """So many chunks that ``far`` errors leave one with at most one."""
    return far // 2 + 1


def _signed(x: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(x).view(kind)


def signatures(rows: np.ndarray, sizes: np.ndarray, symbols: int = SYMBOLS, seed: int = 6) -> np.ndarray:
    """The b-bit signature of each non-empty set, as a matrix of 16-bit symbols."""
    rng = np.random.default_rng(seed)
    masks, factors = rng.integers(0, 1 << 63, symbols, np.uint64), rng.integers(0, 1 << 63, symbols, np.uint64) * np.uint64(2) + np.uint64(1)
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), symbols), np.uint16)
    for k in range(symbols if len(sizes) else 0):
        least = np.minimum.reduceat((rows ^ masks[k]) * factors[k], starts)
        out[:, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def describe(df: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_a`` and ``set_b`` (equal for equal sets) and ``signature``
    (null for the empty set) of each row of (doc_id, text)."""
    schema = T.StructType([df.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("signature", T.ArrayType(T.ShortType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                rows, sizes = shingle_sets(texts, width)
                full = sizes > 0
                starts = (np.cumsum(sizes) - sizes)[full]
                sums = np.zeros((2, b - a), np.uint64)
                if len(starts):
                    sums[0, full] = np.add.reduceat(rows, starts)
                    sums[1, full] = np.add.reduceat(mix(rows ^ np.uint64(0x2545F4914F6CDD1D)), starts)
                found = _signed(signatures(rows, sizes), np.int16)
                offsets = np.concatenate([[0], np.cumsum(full)]) * SYMBOLS
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.ravel()))
                lists = pa.ListArray.from_buffers(lists.type, b - a, [pa.array(full).buffers()[1], lists.buffers()[1]], children=[lists.values])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array(_signed(sums[0], np.int64)), pa.array(_signed(sums[1], np.int64)), lists], schema.names)

    return df.select("doc_id", "text").mapInArrow(run, schema)


def chunk_keys(signature: Column, chunks: int, symbols: int = SYMBOLS) -> Column:
    """The keys of a signature: each chunk with each one symbol left out."""
    bounds = [i * symbols // chunks for i in range(chunks + 1)]
    keys = [
        F.xxhash64(F.lit(left_out), *(signature[i] for i in range(a, b) if i != left_out))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True)
        for left_out in range(a, b)
    ]
    return F.array(*keys)


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def _beside(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``own`` (by ``node``) for both nodes, under names that
    end in _a and _b."""
    for side in "ba":
        pairs = pairs.join(own.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in own.columns if c != "node")), side)
    return pairs


def _promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are close enough by signature, and whose sizes allow a link."""
    both = _beside(pairs, nodes)
    sized = 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    return both.where(sized & (distance(F.col("signature_a"), F.col("signature_b")) <= reach(percent))).select("a", "b")


def _shingle_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The full shingle sets, ``node`` and ``hashes``, of the documents ``ids``."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                rows, sizes = shingle_sets(texts, width)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(rows, np.int64)))], schema.names)

    likely = docs.where(_may_be_among(ids, F.col("doc_id")))
    return likely.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, schema)


def _may_be_among(ids: DataFrame, doc_id: Column, bits: int = 23) -> Column:
    """False only for documents that are not among ``ids``: a bitmap of fixed size (one megabyte),
    so that the texts of few documents are not exchanged among those of all. With very many ids it
    lets all pass, and the join that follows decides alone."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = ids.select(place.alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    bitmap = np.zeros((1 << bits) // 64, np.int64)
    got = words.toArrow()  # one job, and at most a row for each word of the bitmap
    bitmap[got["word"].to_numpy()] = got["v"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))

    @F.pandas_udf("boolean")
    def among(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return among(F.pmod(F.xxhash64(doc_id), F.lit(1 << bits)))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full sets overlap enough."""
    both = _beside(pairs, sets)
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return both.where(100 * common >= percent * (F.size("hashes_a") + F.size("hashes_b") - common)).select("a", "b")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _mixed(shared: DataFrame, merged: DataFrame) -> DataFrame:
    """The members (key, node, component) of the buckets that hold several components."""
    member = shared.join(merged, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    spread = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return member.join(spread, "key", "left_semi")


def _clusters(mixed: DataFrame) -> DataFrame:
    """``node``, ``component`` and ``cluster`` of the members of buckets that hold several
    components: components that buckets connect are one cluster."""
    inside = mixed.select("key", "component").distinct()
    lowest = inside.groupBy("key").agg(F.min("component").alias("a"))
    edges = inside.join(lowest, "key").where("a < component").select("a", F.col("component").alias("b")).distinct()
    found = components(edges).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    return mixed.select("node", "component").distinct().join(found, "component")


def _large(members: DataFrame) -> DataFrame:
    """The clusters that hold a thousandth of all members or more: at most a thousand."""
    counts = members.groupBy("cluster").agg(F.count("*").alias("n"))
    return written_table(hot_keys(counts, "cluster", "n", members.count()), "large-clusters")


def _profiles(members: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """``members`` (node, cluster, hashes) with ``n`` (the set's size), ``differs`` (the shingles
    that the node, but not the core, or the core, but not the node, has) and ``slack``: what a link
    allows the node to differ, less what it differs, in hundredths. The slacks of two nodes add up
    to 0 or more just if their differences need nothing in common for a link.

    A core is smaller than twice the mean size of its cluster's sets."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n_nodes"))
    seen = members.select("cluster", F.explode("hashes").alias("h")).groupBy("cluster", "h").agg(F.count("*").alias("f"))
    wide = left_join_spread(seen.where("f > 1"), sizes, "cluster", large, F.col("h"), "inner").where("2 * f > n_nodes")  # a shingle of one node is no core's
    cores = written_table(wide.groupBy("cluster").agg(F.collect_list("h").alias("core")), "cores")
    placed = left_join_spread(members, cores, "cluster", large, F.col("node"))
    core = F.coalesce("core", F.array().cast("array<bigint>"))
    differs = F.concat(F.array_except("hashes", core), F.array_except(core, "hashes"))
    rows = placed.select("node", "cluster", F.size("hashes").cast("long").alias("n"), differs.alias("differs"))
    return written_table(rows.withColumn("slack", (100 - percent) * F.col("n") - (100 + percent) * F.size("differs")), "profiles")


def _near_core(profiles: DataFrame, large: DataFrame) -> DataFrame:
    """Links (a, b) of each cluster's node with the most slack with all that need nothing in common
    with it. Of two nodes whose slacks add up to 0 or more, both get this link."""
    flat = profiles.select("node", "cluster", "slack")
    best = flat.groupBy("cluster").agg(F.max(F.struct("slack", "node")).alias("c"))
    linked = left_join_spread(flat, best, "cluster", large, F.col("node"), "inner").where((F.col("node") != F.col("c.node")) & (F.col("slack") + F.col("c.slack") >= 0))
    return linked.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))


def _spared() -> list[int]:
    """The sets of groups that may differ, as bits."""
    return [sum(1 << g for g in groups) for groups in combinations(range(GROUPS), ERRORS)]


def _atoms(rows: DataFrame, open_nodes: DataFrame, large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the differences ``rows`` (node, component, cluster, h): ``key`` (cluster, h), ``f``, whether
    components ``share`` it, and ``atom``, equal for differences that the same nodes have; and the
    heavy atoms of each node, ``held``, a hash for each group of them (0 for none)."""
    member = F.xxhash64("node")
    clusters = open_nodes.groupBy("cluster").agg(F.bit_xor(member).alias("everyone"), F.max("n").alias("widest"))
    counts = rows.groupBy("cluster", "h").agg(F.count("*").alias("f"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(member).alias("atom"))
    joined = left_join_spread(counts, clusters, "cluster", large, F.col("h"), "inner")
    either = F.least("atom", F.col("atom").bitwiseXOR(F.col("everyone")))  # the same for an atom and what all others have
    known = written_table(joined.withColumn("either", either).withColumn("most", F.floor(2 * (100 - percent) * F.col("widest") / (100 + percent))), "differences")
    weights = known.groupBy("cluster", "either").agg(F.count("*").alias("weight"), F.first("most").alias("most"), F.array_distinct(F.collect_set("atom")).alias("atoms"))
    heavy = weights.where(F.col("weight") * (ERRORS + 1) > F.col("most")).select("cluster", F.explode("atoms").alias("atom"), "either")
    first = known.groupBy("cluster", "atom").agg(F.min("h").alias("h"))  # one difference stands for its atom
    marks = first.join(heavy, ["cluster", "atom"]).select(F.struct("cluster", "h").alias("key"), F.xxhash64("atom").alias("mark"), F.pmod("either", F.lit(GROUPS)).alias("group"))
    found = rows.select("node", F.struct("cluster", "h").alias("key")).join(marks, "key")
    held = found.groupBy("node").agg(F.array(*(F.coalesce(F.bit_xor(F.when(F.col("group") == g, F.col("mark"))), F.lit(0)) for g in range(GROUPS))).alias("held"))
    return known.select(F.struct("cluster", "h").alias("key"), "f", "atom", (F.col("low") < F.col("high")).alias("share")), held


def _prefix_pairs(open_nodes: DataFrame, percent: int, large: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, of ``open_nodes`` (node, component,
    cluster, n, slack, differs).

    A link needs ``common`` shared differences at least, which the slacks tell. In any order of
    differences, the first that two nodes share has fewer than ``n_differs - common + 1`` before it
    on each side. The order puts first what cannot be shared across components, then the rarest, and
    keeps atoms together, so that a node has a row for each atom of its prefix. The places also add
    up to no more than the link allows the two to differ, so one of them is in the short half of its
    node's prefix."""
    total, less = 100 + percent, 100 - percent
    rows = open_nodes.select("node", "component", "cluster", "n", "slack", F.size("differs").cast("long").alias("n_differs"), F.explode("differs").alias("h"))
    known, held = _atoms(rows, open_nodes, large, percent)
    ranked = rows.withColumn("key", F.struct("cluster", "h")).join(known, "key")
    order = Window.partitionBy("node").orderBy("share", "f", "atom", "h")
    ranked = ranked.withColumn("place", F.row_number().over(order) - 1).withColumn("begins", ~F.col("atom").eqNullSafe(F.lag("atom").over(order)))
    ranked = ranked.where(F.col("share") & F.col("begins") & (percent * F.col("place") <= less * F.col("n")))

    none = F.array(*[F.lit(0).cast("long")] * GROUPS)
    rest = lambda bits: reduce(lambda x, y: x.bitwiseXOR(y), (F.get("held", F.lit(g)) for g in range(GROUPS) if not bits >> g & 1))
    spared = _spared()
    every = F.array(*(F.struct(F.lit(j).alias("j"), rest(bits).alias("held_rest")) for j, bits in enumerate(spared)))
    alone = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("held_rest")))
    dealt = ranked.join(held, "node", "left").withColumn("held", F.coalesce("held", none)).withColumn("m", F.explode(F.when(F.col("f") > FREQUENT, every).otherwise(alone)))
    names = ("node", "component", "n", "slack", "n_differs", "place", "held")
    meets = written_table(dealt.select(F.struct("cluster", "atom", "m.j", "m.held_rest").alias("key"), F.col("m.j").alias("j"), *names), "prefixes")
    left, right = (meets.select("key", "j", *(F.col(c).alias(f"{c}_{side}") for c in names)) for side in "ab")
    right = right.drop("j").where(2 * percent * F.col("place_b") <= less * F.col("n_b"))
    common = F.floor((2 * total - 1 - F.col("slack_a") - F.col("slack_b")) / (2 * total))
    # A pair that agrees in more groups meets several times; it counts where it meets first.
    apart = reduce(lambda x, y: x + y, (F.when(F.get("held_a", F.lit(g)) != F.get("held_b", F.lit(g)), 1 << g).otherwise(0) for g in range(GROUPS)))
    firsts = F.array(*(F.lit(next((j for j, bits in enumerate(spared) if not mask & ~bits), -1)) for mask in range(1 << GROUPS)))
    found = left.join(right, "key").where(
        (F.col("component_a") != F.col("component_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (F.col("place_a") + common <= F.col("n_differs_a"))
        & (F.col("place_b") + common <= F.col("n_differs_b"))
        & ((F.col("j") < 0) | (F.get(firsts, apart) == F.col("j")))
    )
    return written_table(found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "candidates")


def _linked_by_differences(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked: two sets differ where their differences do."""
    both = _beside(pairs, profiles.select("node", "n", "differs"))
    apart = F.size("differs_a") + F.size("differs_b") - 2 * F.size(F.array_intersect("differs_a", "differs_b"))
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the edges (a, b). In a round
    each node hears its neighbours' labels, passes a lower one on to the node that its own label
    names, and takes the label of its label; a chain of n nodes takes about log n rounds."""
    both = written_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        own = labels.join(heard, "node").select("node", F.least("component", "least").alias("now"), F.col("component").alias("was"))
        named = own.where("now < was").select(F.col("was").alias("node"), "now", F.lit(None).cast("long").alias("was"))
        lower = own.union(named).groupBy("node").agg(F.min("now").alias("now"), F.max("was").alias("was"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("next"))
        after = written_table(lower.join(jump, "now", "left").select("node", F.least("now", "next").alias("component"), "was"), "labels")
        labels = after.select("node", "component")
        if after.where("component < was").isEmpty():
            return labels


def _first_labels(links: DataFrame) -> DataFrame:
    """``node`` and ``component``: the smallest node that one or two links of a star lead to. Equal
    labels mean one component; different ones may too, which costs a later look, but no link."""
    direct = written_table(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "labels")
    further = direct.select(F.col("node").alias("component"), F.col("component").alias("next"))
    return direct.join(further, "component", "left").select("node", F.coalesce("next", "component").alias("component"))


def near_duplicates(df: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    that links reach, its own included) and ``kept`` (its id is that smallest one).

    Documents are linked if their sets of ``width``-word shingles overlap by ``percent`` in a
    hundred: 100 * common >= percent * union. A link is found unless its signatures differ in more
    than ``reach(percent)`` symbols, a chance of at most MISSED for a link of exactly ``percent``;
    ``percent`` must be from LEAST_PERCENT to 100. A shorter text is one shingle; null texts and texts
    without words have the empty set, are linked with nothing and kept. Ids are integers; rows with
    one id count as one document. Rows with a null id follow the documents of the same set; they
    are never kept, unless their set is empty, and have a null component if no document with an id
    has their set. Other columns are not read. An empty table gives no rows.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    described = written_table(describe(docs, width), "described")
    classes = described.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = written_table(classes, "classes")
    nodes = classes.where("node is not null").select("node", "n_shingles", "signature")
    filed = nodes.select("node", F.explode(chunk_keys(F.col("signature"), chunks_for(reach(percent)))).alias("key"))
    spans = written_table(filed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low"), "spans")
    shared = written_table(filed.join(spans, "key"), "buckets")  # keys that nodes share

    # Each node against the smallest of its buckets.
    star = shared.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    star = written_table(_promising(star, nodes, percent), "candidates")
    sets = written_table(_shingle_sets(_ids(star), docs, width), "shingle-sets")
    links = written_table(_linked(star, sets, percent), "links")

    # What buckets of several components may still hold.
    mixed = written_table(_mixed(shared.select("key", "node"), _first_labels(links)), "mixed-buckets")
    clusters = written_table(_clusters(mixed), "clusters")
    others = clusters.join(sets.select("node"), "node", "left_anti").select(F.col("node").alias("doc_id"))
    sets = sets.union(written_table(_shingle_sets(others, docs, width), "shingle-sets"))
    large = _large(clusters)
    profiles = _profiles(written_table(clusters.select("node", "cluster").join(sets, "node"), "members"), large, percent)
    links = written_table(links.union(_near_core(profiles, large)), "links")
    merged = components(links)

    left = _mixed(mixed.select("key", "node"), merged).select("node", "component").distinct()
    pairs = _prefix_pairs(written_table(profiles.join(left, "node"), "open"), percent, large)
    joined = written_table(_linked_by_differences(pairs, profiles, percent), "links")
    if not joined.isEmpty():
        merged = components(links.union(joined))

    grouped = classes.join(merged, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("group"))
    found = described.select("doc_id", "n_shingles", "set_a", "set_b").join(grouped, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("group"))
    kept = (F.col("n_shingles") == 0) | F.coalesce(F.col("doc_id") == component, F.lit(False))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(df: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, each as it is, of which one stays in each group of near duplicates: that
    with the smallest id (nulls last), or one of those that share it. Every row is a document of
    its own here, so rows that repeat an id, or have none, are judged by their texts alone. Texts
    without words all stay. ``df`` is written once, with a number for each row."""
    number = free_name("row_number", df.columns)
    rows = written_table(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = written_table(near_duplicates(rows, width=width, percent=percent, id_col=number, text_col=text_col).where("n_shingles > 0"), "groups")
    ids = rows.select(F.col(f"`{number}`").alias("doc_id"), F.col(f"`{id_col}`").alias("own_id"))
    ranked = found.join(ids, "doc_id").select("doc_id", "component_id", F.struct(F.col("own_id").isNull(), "own_id", "doc_id").alias("order"))
    groups = ranked.groupBy("component_id").agg(F.min("order").alias("least"), F.count("*").alias("n")).where("n > 1")
    large = hot_keys(groups, "component_id", "n", rows.count())
    several = left_join_spread(ranked, groups.select("component_id", "least"), "component_id", large, F.col("doc_id"), "inner")
    gone = several.where("doc_id != least.doc_id").select(F.col("doc_id").alias(number))
    return rows.join(gone, number, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
