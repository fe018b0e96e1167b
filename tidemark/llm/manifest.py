"""A Merkle manifest of a table: digests climb and sibling paths descend in Pregel-style supersteps over RDDs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise, scratch_dir

#: Levels of a tree that one superstep climbs or descends: a vertex is the subtree above 2 ** LEVELS nodes.
LEVELS = 10
#: Marks of the side on which a sibling stands; a lone node's path has an empty entry.
LEFT, RIGHT = b"<", b">"


def combined(run: Iterable[bytes]) -> bytes:
    """The digest of some digests, joined as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 (hex) of the fields: each its UTF-8 byte count, a colon and its text; a null is a hyphen."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def climb(nodes: list[bytes], whole: bool, levels: int) -> list[list[bytes]]:
    """The levels of a subtree, from the nodes upward: `levels` of them above the nodes or, if the subtree is a whole tree, as
    many as leave a single node."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        out.append([combined(out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def path_in(levels: list[list[bytes]], k: int) -> list[bytes]:
    """The siblings on the way from node k to the top, each after its side's mark; empty where there is none."""
    out = []
    for level in levels[:-1]:
        other = k ^ 1
        out.append((LEFT if other < k else RIGHT) + level[other] if other < len(level) else b"")
        k >>= 1
    return out


def fold(leaf: bytes, path: Iterable[bytes]) -> bytes:
    """The root that a leaf and the siblings on its path lead to."""
    for entry in path:
        leaf = combined([leaf] if not entry else [entry[1:], leaf] if entry[:1] == LEFT else [leaf, entry[1:]])
    return leaf


def _numbered(leaves: DataFrame) -> RDD:
    """((group, place in it), (is it the group's last, leaf, what goes along)), from columns (tree, key, leaf, more).

    Rows are sorted over the whole table by ranges, so a group with most of the rows spreads over partitions. The driver
    learns of each partition no more than its first and last group and how many rows they have there."""
    order = ["tree", "key", "leaf"]
    spark = leaves.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    rows = leaves.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint().rdd

    def ends(part: int, rows: Iterator) -> Iterator[tuple]:
        first = last = None
        total = in_first = in_last = 0
        for r in rows:
            if not total or r.tree != last:
                last, in_last = r.tree, 0
            if not total:
                first = r.tree
            in_first += r.tree == first
            in_last += 1
            total += 1
        if total:
            yield part, first, in_first, last, in_last

    before, follows, tree, n = {}, {}, None, 0
    known = sorted(rows.mapPartitionsWithIndex(ends).collect(), key=lambda e: e[0])
    for k, (part, first, in_first, last, in_last) in enumerate(known):
        before[part] = n if k and tree == first else 0
        follows[part] = k + 1 < len(known) and known[k + 1][1] == last
        n = before[part] + in_first if first == last else in_last
        tree = last

    def number(part: int, rows: Iterator) -> Iterator[tuple]:
        held, at = None, before.get(part, 0)
        for r in rows:
            if held is not None:
                yield (held.tree, at), (held.tree != r.tree, bytes(held.leaf), held.more)
                at = at + 1 if held.tree == r.tree else 0
            held = r
        if held is not None:
            yield (held.tree, at), (not follows[part], bytes(held.leaf), held.more)

    return rows.mapPartitionsWithIndex(number)


class Forest:
    """The trees of all groups, as one RDD of vertices for each superstep."""

    def __init__(self, leaves: DataFrame, levels: int):
        self.levels, self.steps = levels, []
        nodes, parts = _numbered(leaves), None
        while True:
            parts = nodes.getNumPartitions() if parts is None else max(1, parts >> levels)
            vertices = nodes.map(lambda x: ((x[0][0], x[0][1] >> levels), (x[0][1], *x[1]))).groupByKey(parts).mapValues(sorted)
            self.steps.append(vertices)
            rest = vertices.filter(lambda x: not _whole(x))
            if not rest.count():
                break
            # what a vertex has hashed is a child of the vertex above
            nodes = rest.map(lambda x: ((x[0][0], x[0][1]), (any(c[1] for c in x[1]), climb([c[2] for c in x[1]], False, levels)[-1][0], None)))

    def tops(self) -> RDD:
        """(group, top digest)"""
        ends = [v.filter(_whole).map(lambda x: (x[0][0], climb([c[2] for c in x[1]], True, 0)[-1][0])) for v in self.steps]
        return ends[0].context.union(ends)

    def descend(self, given: RDD) -> RDD:
        """(group, (leaf, what goes along, path to the last top, tops from the nearest on)) of every leaf.

        given: (group, (path, tops)) of each tree's own top. Each superstep hands vertices what holds above them; they add
        the siblings within and hand it on to their children."""
        levels = self.levels

        def hand_on(x: tuple) -> Iterator[tuple]:
            (tree, _), (children, (from_top, path, tops)) = x
            whole = _whole((x[0], children))
            if whole != from_top:
                return
            inside = climb([c[2] for c in children], whole, levels)
            tops = (inside[-1][0], *tops) if whole else tops
            for k, (place, _, digest, more) in enumerate(children):
                yield (tree, place), (digest, more, (*path_in(inside, k), *path), tops)

        starts = given.map(lambda x: ((x[0], 0), (True, *x[1])))
        told = None
        for vertices in reversed(self.steps):
            messages = starts if told is None else starts.union(told.mapValues(lambda x: (False, *x[2:])))
            told = vertices.join(messages, vertices.getNumPartitions()).flatMap(hand_on)
        return told.map(lambda x: (x[0][0], x[1]))


def _whole(vertex: tuple) -> bool:
    """Whether a vertex holds all nodes that its tree has on this level."""
    (_, at), children = vertex
    return at == 0 and children[-1][1]


def prove(
    docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "lang", received: dict[str, Column] | None = None, keep_path: bool = False, levels: int = LEVELS
) -> DataFrame:
    """Per row (id, leaf, subroot, root, proof_sha256, folded_root, verified), digests in lowercase hex.

    A leaf is the digest of the row's fields (see leaf_digest); per group leaves ascend by id, nulls first, and every two
    consecutive nodes (a last one alone) become their digest until one remains, the subroot; subroots by group, null first,
    likewise give the root. proof_sha256 is the digest of the siblings on the way from leaf to root. folded_root comes from
    these siblings and the row as `received`, columns in place of fields; verified tells whether it is the root.
    keep_path adds siblings: array of '<' or '>' (its side) and its digest, '' where there is none.

    Rows that repeat an id are leaves of their own, in the order of their digests. A single row is subroot and root with an
    empty proof. Other columns are ignored; an empty table gives no rows.

    A superstep climbs `levels` levels: the children of a vertex message it, it hashes when all are there and forwards to its
    own parent; then supersteps in reverse hand each vertex the path above it, down to the leaves. A vertex has at most
    2 ** levels children, whatever the groups' sizes."""
    spark = docs.sparkSession
    given = {f: F.col(f) for f in fields} | (received or {})
    leaves = materialise(
        docs.select(
            F.col(group_col).cast("string").alias("tree"),
            F.col(id_col).alias("key"),
            F.unhex(leaf_digest([F.col(f) for f in fields])).alias("leaf"),
            F.unhex(leaf_digest([given[f] for f in fields])).alias("more"),
        ).withColumn("more", F.struct("key", F.col("more").alias("shown"))),
        "leaves",
    )
    forest = Forest(leaves, levels)
    subroots = spark.createDataFrame(forest.tops().map(lambda x: (None, x[0], x[1], x[0])), "tree string, key string, leaf binary, more string")
    over = Forest(subroots, levels)
    tops = over.descend(spark.sparkContext.parallelize([(None, ((), ()))], 1)).map(lambda x: (x[1][1], x[1][2:]))

    def row(x: tuple) -> tuple:
        leaf, more, path, (subroot, root) = x[1]
        folded = fold(bytes(more.shown), path)
        out = (more.key, leaf.hex(), subroot.hex(), root.hex(), combined(e[1:] for e in path if e).hex(), folded.hex(), folded == root)
        return (*out, [e[:1].decode() + e[1:].hex() for e in path]) if keep_path else out

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(name, T.StringType())
    schema = schema.add("verified", T.BooleanType())
    return spark.createDataFrame(forest.descend(tops).map(row), schema.add("siblings", T.ArrayType(T.StringType())) if keep_path else schema, verifySchema=False)


def tampered_count(id_col: str, count_col: str, every: int) -> Column:
    """count_col, one more where `every` divides the crc32 of the id's decimal text; nulls stay."""
    return F.when(F.crc32(F.col(id_col).cast("string")) % every == 0, F.col(count_col) + 1).otherwise(F.col(count_col))

