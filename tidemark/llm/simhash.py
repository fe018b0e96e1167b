"""SimHash near-duplicates: fingerprints over word shingles, linked by covering locality-sensitive hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, materialise, typed_ids
from tidemark.llm.graph import connected_components

BITS = 64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included, as unsigned 64-bit integers.

    A-Z are lower-cased; words are runs without ASCII white space; fewer words than a shingle has make one shingle;
    no words: none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int, extra_seeds: int = 0, distinct: bool = False) -> list[int]:
    """SimHash of a text's shingle_hashes, as unsigned integers, one for each seed; zero for a text without words.

    Further fingerprints take the same values through a multiplicative mix. distinct: each different shingle counts
    once."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return [0] * (1 + extra_seeds)
    if distinct:
        hashes = np.unique(hashes)
    out = []
    for seed in range(1 + extra_seeds):
        if seed:
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        ones = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, extra_seeds: int = 0, distinct: bool = False) -> DataFrame:
    """(id_col, fp long), or with extra seeds (id_col, fp, fp1, ...): the signed form of each text's fingerprints."""
    names = ["fp", *(f"fp{k}" for k in range(1, 1 + extra_seeds))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.array([fingerprint(t, shingle, extra_seeds, distinct) for t in pdf["text"]], dtype=np.uint64).reshape(-1, len(names))
            yield pd.DataFrame({"id": pdf["id"]} | {c: found[:, k].view(np.int64) for k, c in enumerate(names)})

    out = docs.select(id_text(id_col), F.col(text_col).alias("text")).mapInPandas(run, "id string, " + ", ".join(f"{c} long" for c in names))
    return typed_ids(out, docs, id_col)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any set of at most `radius` bits lies outside one of them.

    Each bit has a nonzero vector of radius+1 coordinates over GF(2), dealt out in turn; the mask of a nonzero v keeps
    the bits whose vector has an odd inner product with v. The vectors of `radius` bits span at most `radius`
    dimensions, so some v is orthogonal to all of them."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << b for b in range(bits) if ((b % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _neighbours(fp: Column, varying: Column) -> Column:
    """fp itself and fp with one of the varying bits flipped."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.expr("1L") == F.call_function("shiftright", varying, i).bitwiseAND(F.lit(1)))
    return F.concat(F.array(fp), F.transform(bits, lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def link(fps: DataFrame) -> DataFrame:
    """Edges (seed, u, v) over distinct fingerprints (seed int, fp long) with the same connected components, within each
    seed, as all pairs that differ in at most 2 bits.

    Covering hashing finds the candidates: every such pair shares a bucket of some mask. Inside a bucket no pairs are
    listed, however full it is: two fingerprints are within 2 bits exactly if they share a point within 1 bit of both,
    and only bits that vary in the bucket can differ, so each member names its points, and each point links its members
    (65 at most) in a star. Rows grow with the members, not with their pairs."""
    masks = covering_masks(2)
    slots = fps.select("seed", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "key"))
    full = slots.groupBy("seed", "mask", "key").agg(F.count("*").alias("n"), F.expr("bit_or(fp) & ~bit_and(fp)").alias("varying"))
    # two members that vary in more than two bits are no link
    full = materialise(full.where("n > 2 or (n = 2 and bit_count(varying) <= 2)").select("seed", "mask", "key", "varying"), "buckets")
    points = (
        slots.join(full, ["seed", "mask", "key"])
        .groupBy("seed", "fp")
        .agg(F.expr("bit_or(varying)").alias("varying"))
        .select("seed", "fp", F.explode(_neighbours(F.col("fp"), F.col("varying"))).alias("point"))
    )
    points = materialise(points, "points")
    heads = points.groupBy("seed", "point").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = materialise(heads.select("seed", "point", "head"), "heads")
    return points.join(heads, ["seed", "point"]).where("fp <> head").select("seed", F.col("fp").alias("u"), F.col("head").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id that links reach from each row, where fingerprints link at 2 or
    fewer differing bits.

    Null and blank texts have fingerprint zero and link like any other. Equal fingerprints are one node, so exact
    copies cost nothing. Other columns of docs are ignored; repeated ids are kept as rows; an empty table gives no
    rows."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    parts = connected_components(link(nodes.select(F.lit(0).alias("seed"), "fp")).select("u", "v")).withColumnsRenamed({"node": "fp", "component": "part"})
    nodes = nodes.join(materialise(parts, "parts"), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    nodes = materialise(nodes, "nodes")
    roots = nodes.groupBy("part").agg(F.min("least").alias("component_id"))
    labels = materialise(nodes.join(materialise(roots, "roots"), "part").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: verified_groups lists all pairs that could be similar once there are at most this many for each member of a point.
LISTED = 1
#: Fingerprints by which verified_groups proposes links, beyond the first.
MORE_PRINTS = 1


def verified_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(id, component_id): groups of rows that links join; every two rows whose texts' distinct `shingle`-word shingles have
    a Jaccard similarity of `similarity` or more are linked, and no others.

    Texts with equal shingles are one node. SimHash fingerprints propose links first, see printed_links, and those that
    the shingles confirm join most copies. An exact way finds the rest, which fingerprints can miss: prefix filtering
    loses no pair, as whatever order all shingles are given, two similar sets share one among the first
    n - ceil(similarity * n) + 1 of each, and k among k - 1 more. By hash first, which leaves the nodes that share enough
    with any other; among those by frequency, so that common passages come last. Pairs are not listed where links
    already join them; see _all_links. Blank texts are equal to each other."""
    def least_common(n: int) -> int:
        return math.ceil(similarity * n - 1e-9)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            same, first, need, prints = [], [], [], []
            for t in pdf["text"]:
                found = np.unique(shingle_hashes(t, shingle))
                n = len(found)
                k = max(1, n // 10)
                same.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                first.append(found[: n - least_common(n) + k].view(np.int64))
                need.append(k)
                # of distinct words: a changed word moves a bit or two, where it changes `shingle` shingles
                prints.append(np.array(fingerprint(t, 1, MORE_PRINTS, distinct=True), dtype=np.uint64).view(np.int64))
            yield pd.DataFrame({"id": pdf["id"], "same": same, "need": need, "first": first, "prints": prints})

    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = known.select(id_text("id"), "text").mapInPandas(measure, "id string, same string, need int, first array<long>, prints array<long>")
    measured = materialise(typed_ids(found, known, "id"), "measured")
    nodes = measured.groupBy("same").agg(F.min("id").alias("least"), F.first("need").alias("need"), F.first("first").alias("first"), F.min_by("prints", "id").alias("prints"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("node", "need", F.explode("first").alias("h"))
    shared = materialise(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    asked = rows.join(shared, "h", "left_semi").groupBy("node").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    asked = materialise(nodes.join(asked.select("node"), "node", "left_semi").select(F.col("least").alias("id"), "same", "node", "prints"), "asked")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            out = []
            for node, same, t in zip(pdf["node"], pdf["same"], pdf["text"], strict=True):
                found = np.unique(shingle_hashes(t, shingle))
                # an id may stand on several texts
                if xxhash.xxh3_128_hexdigest(found.tobytes()) == same:
                    out.append((node, len(found), len(found) - least_common(len(found)) + 1, found.view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "n", "prefix", "shingles"])

    sets = materialise(known.join(asked.drop("prints"), "id").mapInPandas(gather, "node long, n int, prefix int, shingles array<long>"), "shingles")
    rows = sets.select("node", "n", "prefix", F.explode("shingles").alias("h"))
    counts = materialise(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    ranked = rows.join(counts, "h").groupBy("node", "n", "prefix").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("s"))
    # shingles of one node alone come first and can meet nobody
    ranked = ranked.withColumn("alone", F.col("n") - F.size("s")).where("prefix > alone")
    points = ranked.select("node", "n", "alone", F.posexplode(F.expr("slice(s, 1, prefix - alone)")).alias("at", "s"))
    points = materialise(points.select("node", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("s.h").alias("h")), "points")
    shingles = sets.select("node", "shingles")
    links = _all_links(points, shingles, similarity, near=printed_links(asked.select("node", "prints"), shingles, similarity))
    parts = materialise(connected_components(links).withColumnRenamed("component", "part"), "parts")
    joined = nodes.select("same", "least", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    joined = materialise(joined.select("same", "least", "part"), "joined")
    roots = materialise(joined.groupBy("part").agg(F.min("least").alias("component_id")), "roots")
    labels = materialise(joined.join(roots, "part").select("same", "component_id"), "labels")
    return measured.select("id", "same").join(labels, "same").select(F.col("id").alias(id_col), "component_id")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets (node, shingles) have a Jaccard similarity of `similarity` or more."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "proposed").join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("s_u", "s_v"))
    return materialise(both.where(common / (F.size("s_u") + F.size("s_v") - common) >= similarity).select("u", "v"), "links")


def printed_links(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Confirmed edges (u, v) of nodes (node, prints): those that any of their fingerprints links, see link.

    Nodes of one fingerprint are compared with the smallest, which stands for it towards others; so comparisons grow with
    the nodes, and a pair that the smallest doesn't confirm is left to the exact way."""
    mine = materialise(nodes.select("node", F.posexplode("prints").alias("seed", "fp")), "prints")
    heads = materialise(mine.groupBy("seed", "fp").agg(F.min("node").alias("head")), "print_heads")
    equal = mine.join(heads, ["seed", "fp"]).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    name = lambda c, h: heads.select("seed", F.col("fp").alias(c), F.col("head").alias(h))
    links = materialise(link(heads.select("seed", "fp")).distinct(), "print_links")
    near = links.join(name("u", "a"), ["seed", "u"]).join(name("v", "b"), ["seed", "v"]).where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return _confirmed(equal.union(near), sets, similarity)


#: Longs of a parity sketch; members of a point with which each of its members is compared in a round.
SKETCH, HEADS = 4, 8


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, sketch) of sets (node, shingles): SKETCH longs, each bit the parity of how many of the shingles fall on it.

    Two sets differ in no fewer shingles than their sketches do in bits."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.pmod(F.call_function("shiftright", F.col("h"), F.lit(6)), F.lit(SKETCH))
    parts = [F.bit_xor(F.when(word == w, one).otherwise(F.lit(0).cast("long"))).alias(f"b{w}") for w in range(SKETCH)]
    found = sets.select("node", F.explode("shingles").alias("h")).groupBy("node").agg(*parts)
    return found.select("node", F.struct(*[f"b{w}" for w in range(SKETCH)]).alias("sketch"))


def _all_links(points: DataFrame, sets: DataFrame, similarity: float, listed: int = LISTED, near: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) with the same connected components as all pairs of nodes that share a point and whose sets have a
    Jaccard similarity of `similarity` or more.

    points: (node, n, at, h): node's set of n has h at place `at` of its order; sets: (node, shingles); near: edges that are
    known already. Places, sizes and sketches tell of most pairs that they can't be similar, and such pairs make no rows.
    While those left are more than `listed` a member, the members of each point are compared with HEADS of them, others in
    every round, and those that links join are one part; how many are left is told by how many of the comparisons could be
    similar. When a round helps little or pairs are few, every pair of two parts that could be similar is compared; a point
    with many members is dealt in pairs of blocks. So no member's rejection stands for another's."""
    block = 500
    links, turn, before = near, 0, None
    members = points.withColumn("part", F.col("node"))
    sketches = materialise(_sketches(sets), "sketches")

    def joined(members: DataFrame) -> DataFrame:
        """members with the part that the links found so far give them."""
        parts = materialise(connected_components(links).withColumnRenamed("component", "new"), "parts")
        new = members.drop("part", "all").join(parts, "node", "left").withColumn("part", F.coalesce("new", "node")).drop("new")
        return materialise(new, "members")

    def could() -> Column:
        """Whether the pair (u_*, v_*) of two parts could be similar."""
        total = F.col("u_n") + F.col("v_n")
        differ = sum((F.bit_count(F.col(f"u_sketch.b{w}").bitwiseXOR(F.col(f"v_sketch.b{w}"))) for w in range(SKETCH)), F.lit(0))
        return (
            (F.col("u_part") != F.col("v_part"))
            & (F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-6)
            # no more than this point and all behind it can be common to both, if it is the first that is
            & (F.least(F.col("u_n") - F.col("u_at"), F.col("v_n") - F.col("v_at")) >= similarity / (1 + similarity) * total - 1e-6)
            & (differ <= (1 - similarity) / (1 + similarity) * total + 1e-6)
        )

    def sided(df: DataFrame, c: str) -> DataFrame:
        return df.withColumnsRenamed({x: f"{c}_{x}" for x in ("node", "n", "at", "part", "sketch")})

    if near is not None:
        members = joined(members)
    while True:
        sizes = members.groupBy("h", "part").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("all"), F.count("*").alias("k")).where("k > 1")
        members = materialise(members.join(materialise(sizes.select("h", "all"), "sizes"), "h"), "members")
        drawn = members.join(sketches, "node").withColumn("slot", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(HEADS)))
        first = F.min_by(F.struct("node", "n", "at", "part", "sketch"), F.xxhash64("node", F.lit(-1 - turn)))
        heads = drawn.groupBy("h", "slot").agg(first.alias("x")).select("h", "x.*")
        heads = materialise(heads, "heads")
        met = heads.groupBy("h").agg(F.count("*").alias("heads"))
        found = sided(drawn.drop("slot"), "u").join(sided(heads.join(met, "h"), "v"), "h").where(could())
        # a pair at a point is met by either's being a head
        found = materialise(found.select(F.col("u_node").alias("u"), F.col("v_node").alias("v"), (F.col("all") / F.col("heads") / 2).alias("stands_for")), "met")
        left, rows = found.agg(F.coalesce(F.sum("stands_for"), F.lit(0.0))).first()[0], members.count()
        if left:
            more = _confirmed(found, sets, similarity)
            links = more if links is None else links.union(more)
            members, turn = joined(members), turn + 1
        if left <= listed * rows or before is not None and left > 0.8 * before:
            break
        before = left
    # the last round's links may have left no second part at a point
    blocks = F.ceil(F.col("all") / block).cast("int")
    sizes = members.groupBy("h", "part").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("all"), F.count("*").alias("k")).where("k > 1")
    mine = members.drop("all").join(sizes.select("h", "all"), "h").withColumn("x", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = materialise(mine.withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("all").join(sketches, "node"), "dealt")
    u = sided(dealt.where("x <= y"), "u").withColumnsRenamed({"x": "a", "y": "b"})
    v = sided(dealt.where("x >= y"), "v").withColumnsRenamed({"x": "b", "y": "a"})
    asked = u.join(v, ["h", "a", "b"]).where(could() & ((F.col("a") < F.col("b")) | (F.col("u_node") < F.col("v_node"))))
    found = _confirmed(asked.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")), sets, similarity)
    return found if links is None else links.union(found)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but the row of the smallest id in each of the verified_groups; rows that repeat that id become one.

    Columns stay as they are; a null id keeps its row."""
    found = verified_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, similarity)
    found = materialise(found.select(F.col(id_col).alias("__id"), (F.col(id_col) == F.col("component_id")).alias("__first")), "groups")
    # only the ids that go are shuffled against the texts, but for ids that more than one row has
    gone = materialise(found.where("not __first").select("__id").distinct(), "gone")
    kept = docs.join(gone, F.col(id_col) == F.col("__id"), "left_anti")
    if found.groupBy("__id").count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
