"""The Merkle manifest against plain recursion."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.manifest import fold, prove, tampered_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key int, more int, tree int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def plain_leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """(root, for each node the siblings with their sides, '' where there is none)"""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, at in enumerate(where):
            other = at ^ 1
            paths[k].append(("<" if other < at else ">") + level[other] if other < len(level) else "")
            where[k] = at // 2
        level = [digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], paths


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars); the expected results in no order."""
    groups = {}
    for i, text, lang, source, n in rows:
        shown = n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        groups.setdefault(lang, []).append((i, plain_leaf((i, source, lang, n, text)), plain_leaf((i, source, lang, shown, text))))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = plain_tree([x[1] for x in groups[name]])
    root, over = plain_tree([trees[n][0] for n in names]) if names else (None, [])
    out = []
    for name, above in zip(names, over, strict=True):
        for (i, leaf, shown), path in zip(groups[name], trees[name][1], strict=True):
            path = path + above
            folded = shown
            for e in path:
                folded = digest(folded) if not e else digest(e[1:], folded) if e[0] == "<" else digest(folded, e[1:])
            out.append((i, leaf, trees[name][0], root, digest(*(e[1:] for e in path if e)), folded, folded == root, path))
    return sorted(out, key=repr)


def built(spark, rows, **how):
    table = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS)
    out = prove(table, FIELDS, received={"n_chars": tampered_count("doc_id", "n_chars", 7)}, keep_path=True, **how)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_trees_match_plain_recursion(spark, levels):
    rng = random.Random(levels)
    rows = [(k * 3 - 50, "tëxt " * rng.randint(0, 4), rng.choice(["en", "en", "en", "dé", None]), rng.choice([None, "src"]), rng.choice([None, 5, 70])) for k in range(150)]
    rows += [(None, None, None, None, None), (None, "x", "en", "s", 1), (7, "", "zz", "s", 0), *[(1, "same", "en", "s", 4)] * 5, (1, "other", "en", "s", 4), (2, "word " * 40_000, "en", "s", 200_000)]
    rng.shuffle(rows)
    got = built(spark, rows, levels=levels)
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}


def test_groups_over_partitions(spark):
    """One group holds most rows, some have one each."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, f"t{k}", "en" if k % 10 else f"l{k:04}", "s", k) for k in range(700)]
        assert built(spark, rows, levels=2) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    rows = [(k, "t", "en", None, None) for k in range(n)]
    assert built(spark, rows) == plain(rows)


def test_a_path_proves_its_leaf_and_no_other(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en", "s", k) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = prove(docs, FIELDS, received={"text": F.when(F.col("doc_id") == 3, F.lit("forged")).otherwise(F.col("text"))}, keep_path=True).collect()
    for r in rows:
        path = [e[:1].encode() + bytes.fromhex(e[1:]) for e in r.siblings]
        assert fold(bytes.fromhex(r.leaf), path).hex() == r.root
        assert r.verified == (r.doc_id != 3)
