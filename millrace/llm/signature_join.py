"""Documents linked by the Jaccard similarity of their word shingles: an exact join with signature trees.

1. A document's set of shingles is hashed; documents with equal sets are one node, the smallest doc_id. A node's
   signature is a bitmap of 4 to 8 bits a shingle. What a set can share with another is at most its size less the
   bits that only it has, so two signatures bound the overlap of two sets; a bitmap is folded to a shorter one by OR.
2. Two sets that link share one of the first shingles of each, in any order that is the same for all: of n shingles, the
   first n - ceil(0.8 n) + 1. The order puts the shingles that are frequent anywhere last, so that the blocks of nodes with
   a shingle in common are small; it has no influence on the result.
   Pairs are only held against each other where the shingle stands so early in both that it can be the first they share.
3. In each block every node is held against the block's first one; those pairs that their signatures can't refuse are
   verified on the whole sets, and links are joined into components. So a large group of near copies takes about as
   many pairs as it has members.
4. Blocks that still hold several components go through a signature tree: the nodes of a block fall into classes by
   size and leaves by a hash, each with the OR of its members' bitmaps and its range of sizes; pairs of leaves, then of
   their halves down to single nodes, are dropped if their largest possible overlap is too small or all their nodes
   are of one component. What is left is verified, and the components are joined again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import BATCH_BYTES, FEW_BYTES, components, counted_join, dealt_join, dropped, mapped, raw_texts, slices, small_batches, small_join, written
from millrace.llm._text import Words, mixed, runs

#: Words of a shingle; two sets link if 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 80
#: A shingle is counted as frequent from so many nodes of a task on; of those, so many are put last.
FREQUENT, MOST_FREQUENT = 5, 1 << 16
#: Members of a leaf, about; bits of a tree's bitmaps, at least and at most; leaves of a shingle that are held against all of
#: its others in one place.
LEAF, TREE_BITS, MOST_BITS, TOGETHER = 256, 512, 16_384, 16


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's set: its runs of `size` words, or all its words if they are fewer."""
    words, out = Words(texts), []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        h = words.hash[a:b]
        out.append(np.unique(runs(h, min(size, len(h)) or 1)) if b > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> bytes:
    """A bitmap of 4 to 8 bits a shingle, TREE_BITS at least: by the low bits of the hashes, so halves fold."""
    m = max(TREE_BITS, 1 << (4 * len(s) - 1).bit_length() if len(s) else 0)
    bits = np.zeros(m, np.uint8)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap, as 64-bit words, folded to `size` words by OR."""
    return np.bitwise_or.reduce(bits.reshape(-1, size)) if len(bits) > size else bits


def tree_words(n: int) -> int:
    """The length of a bitmap in a tree, in 64-bit words: a bit or two for each shingle, within bounds."""
    return min(max(TREE_BITS, 1 << (n - 1).bit_length()), MOST_BITS) // 64


def most_overlap(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray) -> int:
    """The largest overlap that two signatures allow."""
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def links(overlap: int, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def first_shingles(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of which any linked set holds one: the first ones in the common order."""
    keep = len(s) - -(-percent * len(s) // 100) + 1
    if len(s) and len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        s = s[np.lexsort([s, np.where(frequent[at] == s, rank[at], 0)])]
    return s[:keep]


class _Seen:
    """Whether an equal set was met in this task; forgetful beyond a size, which only costs time."""

    def __init__(self) -> None:
        self.names: set[bytes] = set()

    def first(self, name: bytes) -> bool:
        if len(self.names) > 50_000:
            self.names.clear()
        known = name in self.names
        self.names.add(name)
        return not known


def _name(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([len(s), s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)[1:].tobytes()


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """A row per document (key, n, name, bits), and rows with a null name: a frequent shingle (key) and its count (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, gathered, held = _Seen(), [], 0

        def frequent() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(gathered), return_counts=True) if gathered else (np.zeros(0, np.uint64), np.zeros(0, int))
            value, count = value[count >= FREQUENT], count[count >= FREQUENT]
            none = pa.nulls(len(value), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int64)), none, none], names=["key", "n", "name", "bits"])

        for batch in (part for b in batches for part in slices(b, most=FEW_BYTES)):
            sets = shingle_sets(raw_texts(batch), size)
            names = [_name(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array([signature(s) for s in sets], pa.binary())], names=["key", "n", "name", "bits"])
            new = [s for s, name in zip(sets, names, strict=True) if seen.first(name)]
            gathered += new
            held += sum(map(len, new))
            if held > 1_000_000:
                yield frequent()
                gathered, held = [], 0
        yield frequent()

    return mapped(docs, run, "key long, n long, name binary, bits binary")


def _entries(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray, size: int, percent: int) -> DataFrame:
    """(shingle, doc_id, n, at) for the first shingles of each document and their places; of equal sets of a task but once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in (part for b in batches for part in slices(b, most=FEW_BYTES)):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, s in zip(ids, shingle_sets(raw_texts(batch), size), strict=True):
                if len(s) and seen.first(_name(s)):
                    rows.append((doc, len(s), first_shingles(s, frequent, rank, percent)))
            if rows:
                count = [len(x[2]) for x in rows]
                flat = np.concatenate([x[2] for x in rows]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat([x[0] for x in rows], count)), pa.array(np.repeat([x[1] for x in rows], count)), pa.array(np.concatenate([np.arange(c) for c in count]))], names=["shingle", "doc_id", "n", "at"])

    return mapped(docs, run, "shingle long, doc_id long, n long, at long")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a written table, whose signatures allow a link, with the largest overlap that they allow."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, b, m) for a, n_a, x, b, n_b, y in zip(*(batch.column(c).to_pylist() for c in ("a", "n_a", "bits_a", "b", "n_b", "bits_b")), strict=True) if links(m := most_overlap(n_a, np.frombuffer(x, np.uint64), n_b, np.frombuffer(y, np.uint64)), n_a, n_b, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], names=["a", "b", "most"])

    both = dealt_join(dealt_join(pairs, side("b"), "b", pairs), side("a"), "a", pairs)
    return mapped(both, run, "a long, b long, most long")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Pairs (a, b), a written table, of which the whole sets link."""

    def sets(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for b in batches for part in slices(b, most=FEW_BYTES)):
                own = pa.array([s.tobytes() for s in shingle_sets(raw_texts(batch), size)], pa.binary())
                keys = ["a", "b"] if key == "b" else ["a"]
                yield pa.RecordBatch.from_arrays([*(batch.column("doc_id" if k == key else k) for k in keys), own], names=[*keys, f"set_{key}"])

        return run

    # a pair goes to the text of b, and b's set to a's: no set is shuffled but once
    of_b = mapped(small_join(docs, pairs.withColumnRenamed("b", "doc_id"), ["doc_id"]), sets("b"), "a long, b long, set_b binary")
    hubs = written(pairs.select(F.col("a").alias("doc_id")).distinct(), f"{name}-hubs")
    of_a = mapped(small_join(docs, hubs, ["doc_id"]), sets("a"), "a long, set_a binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, x, b, y in zip(*(batch.column(c) for c in ("a", "set_a", "b", "set_b")), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    rows.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(2)], names=["a", "b"])

    out = written(mapped(dealt_join(of_b, of_a, "a", pairs), run, "a long, b long"), f"{name}-links")
    dropped(hubs)
    return out


class TreeNode:
    """Members of a leaf, by size: their range of sizes, the OR of their bitmaps, and their groups' range."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, group: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
        self.ids, self.n, self.group, self.at, self.bits = ids, n, group, at, bits
        self.any = np.bitwise_or.reduce(bits)
        # a set's shared shingles are at most the shared bits and those of its own that fell on one bit
        self.slack = int((n - np.bitwise_count(bits).sum(axis=1)).max())
        self.least, self.most = int(n.min()), int(n.max())
        self.groups = int(group.min()), int(group.max())

    def halves(self) -> list[TreeNode]:
        k = len(self.ids) // 2
        return [TreeNode(self.ids[p], self.n[p], self.group[p], self.at[p], self.bits[p]) for p in (slice(0, k), slice(k, None))]

    @staticmethod
    def can_link(a: TreeNode, b: TreeNode, percent: int) -> bool:
        if a.groups == b.groups and a.groups[0] == a.groups[1]:
            return False
        if 100 * min(a.most, b.most) < percent * max(a.least, b.least):
            return False
        shared = int(np.bitwise_count(a.any & b.any).sum())
        most = min(shared + min(a.slack, b.slack), a.most, b.most)
        return links(most, max(a.least, most), max(b.least, most), percent)

    @staticmethod
    def singles(a: TreeNode, b: TreeNode, percent: int) -> Iterator[tuple[int, int]]:
        """The pairs of a member of each that no bound refuses, at once."""
        x, y = (v.ravel() for v in np.meshgrid(np.arange(len(a.ids)), np.arange(len(b.ids)), indexing="ij"))
        total = percent * (a.n[x] + b.n[y])
        # if this is the first shingle that both hold, they share none before their places
        ok = (a.group[x] != b.group[y]) & ((100 + percent) * np.minimum(a.n[x] - a.at[x], b.n[y] - b.at[y]) >= total)
        if a is b:
            ok &= x < y
        x, y, total = x[ok], y[ok], total[ok]
        p, q = a.bits[x], b.bits[y]
        most = np.minimum(a.n[x] - np.bitwise_count(p & ~q).sum(axis=1), b.n[y] - np.bitwise_count(q & ~p).sum(axis=1))
        ok = (100 + percent) * most >= total
        p, q = a.ids[x[ok]], b.ids[y[ok]]
        yield from zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist(), strict=True)

    @staticmethod
    def pairs(a: TreeNode, b: TreeNode, percent: int) -> Iterator[tuple[int, int]]:
        """Dual traversal, down to some hundred pairs of members, which are held against each other at once."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if len(a.ids) * len(b.ids) <= 256:
                yield from TreeNode.singles(a, b, percent)
            elif not TreeNode.can_link(a, b, percent):
                continue
            elif a is b:
                x, y = a.halves()
                todo += [(x, x), (x, y), (y, y)]
            elif len(a.ids) >= len(b.ids):
                todo += [(x, b) for x in a.halves()]
            else:
                todo += [(a, x) for x in b.halves()]


def _tree_pairs(blocks: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """blocks (shingle, node, n, at, size, group): pairs of nodes of a block and different groups that may link."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [folded(np.frombuffer(x, np.uint64), tree_words(n)).tobytes() for x, n in zip(batch.column("bits").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.binary())], names=["node", "bits"])

    small = mapped(nodes.select("node", "n", "bits"), fold, "node long, bits binary")
    step = np.log(100 / percent) * 1.001 + 1e-9  # sets that can link are of the same class or of neighbouring ones
    placed = (
        blocks.join(small, "node")
        .withColumn("class", F.floor(F.ln("n") / F.lit(step)).cast("long"))
        .withColumn("leaf", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / LEAF)))
    )
    members = F.collect_set(F.struct("node", "n", "group", "at", "bits")).alias("members")
    # a block that is no larger than a leaf is a tree of its own
    alone = placed.where(F.col("size") <= LEAF).groupBy("shingle").agg(members).select(F.col("members").alias("members_a"), F.col("members").alias("members_b"), F.lit(True).alias("same"))
    leaves = written(placed.where(F.col("size") > LEAF).groupBy("shingle", "size", "class", "leaf").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), members), "join-leaves")
    # the leaves of larger ones are dealt over several partitions, each of which has all leaves that they are held against
    salts = F.greatest(F.lit(1), F.ceil(F.col("size") / (LEAF * TOGETHER)))
    side = lambda x, of: of.select("shingle", "salt", "kin", *(F.col(c).alias(f"{c}_{x}") for c in ("class", "leaf", "g0", "g1", "members")))
    a = side("a", leaves.withColumn("salt", F.pmod("leaf", salts)).withColumn("kin", F.explode(F.array(F.col("class"), F.col("class") + 1))))
    b = side("b", leaves.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).withColumn("kin", F.col("class")))
    two = a.join(b, ["shingle", "salt", "kin"]).where("(class_a < class_b or leaf_a <= leaf_b) and not (g0_a = g1_a and g0_b = g1_b and g0_a = g0_b)")
    two = two.select("members_a", "members_b", F.expr("class_a = class_b and leaf_a = leaf_b").alias("same"))

    def node(members: pa.Scalar, other: pa.Scalar) -> TreeNode:
        x = members.values
        ids, n, group, at = (x.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "group", "at"))
        size = min(len(b) // 8 for y in (x, other.values) for b in y.field("bits").to_pylist())
        bits = np.stack([folded(np.frombuffer(b, np.uint64), size) for b in x.field("bits").to_pylist()])
        order = np.lexsort([ids, n])
        return TreeNode(*(v[order] for v in (ids, n, group, at, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["a", "b"])
        for batch in batches:
            for x, y, same in zip(batch.column("members_a"), batch.column("members_b"), batch.column("same").to_pylist(), strict=True):
                left = node(x, y)
                for pair in TreeNode.pairs(left, left if same else node(y, x), percent):
                    found.add(pair)
                    if len(found) >= 100_000:
                        yield rows()
                        found = set()
        yield rows()

    return mapped(alone.unionByName(two), run, "a long, b long").distinct()


def _one_row(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with one row for each doc_id, of the text with the least hash, and the doc_ids that occur again, if there are any."""
    tag = F.xxhash64("text")
    again = written(docs.groupBy("doc_id").agg(F.min(tag).alias("__kept"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "join-again")
    if not again.limit(1).count():
        return docs, None
    both = counted_join(docs, again, ["doc_id"], "rows", "left")
    one = both.where((F.col("__kept") == tag)).dropDuplicates(["doc_id"]).unionByName(both.where("__kept is null"))
    return written(one.select("doc_id", "text"), "join-rows"), again.select("doc_id", "rows")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each row of docs its key, n_shingles (its set's size) and component (the smallest key reachable by links).

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09 to 0x0D; a set holds the distinct runs of `size`
    words, or the whole sequence of a text with fewer. Two rows link if 100 * intersection >= percent * union. A
    null or empty text, or one without words, has an empty set: it is linked with nothing, and is its own component. Rows
    with a null key are returned with a null component and link nothing; repeated rows of a key with one text are equal
    rows. Of a key with several texts the one with the least xxhash64 counts, and all rows of the key get its results.
    Texts are read whole; an empty table gives no rows; other columns play no part.
    """
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lost, every_row = docs.where("doc_id is null"), docs.where("doc_id is not null")
    docs, again = _one_row(every_row)
    profiles = written(_profiles(docs, size), "join-profiles")
    rows = profiles.where("name is not null").withColumnRenamed("key", "doc_id")
    top = profiles.where("name is null").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).collect()
    frequent = np.array([r.key for r in top], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, rank = frequent[order], np.array([r.n for r in top], np.int64)[order]

    known = written(rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "join-known")
    member = written(counted_join(rows.select("doc_id", "n", "name"), known, ["name"], "rows", "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")), "join-members")
    copies = written(member.where("n > 0 and node <> doc_id").select("doc_id", "node"), "join-copies")
    nodes = written(small_join(rows.where("n > 0"), copies, ["doc_id"], "left_anti").select(F.col("doc_id").alias("node"), "n", "bits"), "join-nodes")
    dropped(profiles, known)

    every = written(_entries(docs, frequent, rank, size, percent), "join-entries")
    entries = small_join(every, copies, ["doc_id"], "left").select("shingle", F.coalesce("node", "doc_id").alias("node"), "n", "at")
    count = F.count(F.lit(1))
    # most shingles are of one node: they go before anything but the nodes is known of the others
    shared = written(entries.groupBy("shingle").agg(F.min("node").alias("first"), F.max("node").alias("last"), count.alias("rows")).where("first < last").select("shingle", "first", "rows"), "join-shared")
    held = written(counted_join(entries, shared, ["shingle"], "rows"), "join-held")
    hubs = written(held.groupBy("shingle").agg(F.min(F.struct("node", "n", "at")).alias("hub"), count.alias("size"), count.alias("rows")), "join-shingles")
    blocks = written(counted_join(held.where("node <> first").select("shingle", "node", "n", "at"), hubs, ["shingle"], "rows"), "join-blocks")
    dropped(every, shared, held, hubs)

    # if this is the first shingle that both hold, they share none before their places
    fits = f"{100 + percent} * least(n - at, hub.n - hub.at) >= {percent} * (n + hub.n)"
    pairs = written(blocks.where(fits).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), "join-pairs")
    possible = written(_possible(pairs, nodes, percent), "join-possible")
    best = possible.groupBy("b").agg(F.max(F.struct("most", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    first = _verified(written(best, "join-best"), docs, size, percent, "join-first")

    def grouped(edges: DataFrame) -> DataFrame:
        found = components(edges)
        return written(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("group")), "join-groups")

    groups = grouped(first)
    open_ = written(small_join(blocks.select("shingle", "node", "n", "at", "size"), groups, ["node"]), "join-open")
    mixed_ = open_.groupBy("shingle").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.count(F.lit(1)).alias("rows")).where("g0 < g1").select("shingle", "rows")
    left = written(_tree_pairs(counted_join(open_, written(mixed_, "join-mixed"), ["shingle"], "rows"), nodes, percent), "join-tree")
    dropped(open_, blocks)
    rest = possible.select("a", "b").union(_possible(left, nodes, percent).select("a", "b")).distinct()
    for side in "ab":
        rest = small_join(rest, groups.withColumnRenamed("node", side).withColumnRenamed("group", f"group_{side}"), [side])
    rest = written(rest.where("group_a <> group_b").select("a", "b"), "join-rest")
    second = _verified(rest, docs, size, percent, "join-second")
    groups = grouped(first.union(second))
    out = member.join(groups, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("group", "doc_id").alias("component"))
    if again is not None:
        result = written(out.join(again, "doc_id"), "join-repeated")
        ids = every_row.select("doc_id")
        out = counted_join(ids, result, ["doc_id"], "rows").unionByName(small_join(out, again.select("doc_id"), ["doc_id"], "left_anti"))
    return out.unionByName(written(_profiles(lost, size), "join-lost").where("name is not null").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component")))
