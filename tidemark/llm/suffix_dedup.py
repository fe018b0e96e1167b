"""Exact substring deduplication: bytes covered by a string of a given length that also starts earlier are removed.

Content anchors bring equal strings together without sorting the corpus; suffix arrays decide where texts begin and
cease to agree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, materialise, text_partitions, typed_ids
from tidemark.llm.suffix_array import suffix_array

#: Length of the substrings whose hashes serve as anchors: any window of the match length holds at least one.
ANCHOR = 32
#: Bytes of text that are hashed at once, and that a task gathers before it ships its anchors.
PIECE, BLOCK = 1 << 19, 1 << 24
#: Bytes of text whose anchors one task settles: what it reads is about a quarter of it more than once.
BUCKET = 1 << 26
#: Anchors with more different surroundings than this are dealt out by the core of their windows.
MANY = 512
#: Windows that share one core when surroundings are compared, and characters for one suffix array.
SPAN, CHUNK = 8, 1 << 18
_POSITION = np.uint64((1 << 20) - 1)


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ANCHOR bytes from each position, and for each window of `length` bytes the position of its anchor:
    the least hash in it, the leftmost among equals)."""
    h = (np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    factor, m = 0x9E3779B97F4A7C15, 1
    while m < ANCHOR:  # doubling: the hash of 2m bytes from those of its halves
        h = h[:-m] * np.uint64(factor) + h[m:]
        factor, m = factor * factor % (1 << 64), 2 * m
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    size, wanted = 1, length - ANCHOR + 1
    while 2 * size <= wanted:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if wanted > size:
        least = np.minimum(least[: size - wanted], least[wanted - size :])
    return h, (least & _POSITION).astype(np.int64)


def piece_runs(ids: list[int], bases: list[int], parts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """The runs of windows with one anchor: its hash, a hash of the bytes that the windows span, document, first and last
    start and the anchor's place, all within the document."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    raw = b"".join(parts)
    sizes = np.array([len(p) for p in parts])
    if len(raw) < length:
        return {}
    h, at = anchors(raw, length)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    starts = np.flatnonzero(owner[: len(at)] == owner[length - 1 : length - 1 + len(at)])
    if not len(starts):
        return {}
    at, of = at[starts], owner[starts]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(of) != 0)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(starts) - 1]))
    a, b, pos, of = starts[first], starts[last], at[first], of[first]
    base = (np.array(bases) - (np.cumsum(sizes) - sizes))[of]
    spans = np.fromiter((digest(raw[x:y]) for x, y in zip(a.tolist(), (b + length).tolist(), strict=True)), np.uint64, len(a))
    return {"h": h[pos], "span": spans, "doc": np.array(ids, dtype=np.int64)[of], "a": a + base, "b": b + base, "pos": pos + base}


def _earliest(runs: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """runs in the order of (anchor, span, document, start); whether each begins a new (anchor, span), and is a later one
    than the first of it."""
    order = np.lexsort((runs["a"], runs["doc"], runs["span"], runs["h"]))
    runs = {k: v[order] for k, v in runs.items()}
    new = np.ones(len(order), dtype=bool)
    new[1:] = (runs["h"][1:] != runs["h"][:-1]) | (runs["span"][1:] != runs["span"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return runs, new, (runs["doc"] != runs["doc"][head]) | (runs["a"] != runs["a"][head])


PACKED = {"h": "<u8", "span": "<u8", "doc": "<i8", "a": "<i4", "back": "u1", "more": "u1"}


def _ship(block: list[dict[str, np.ndarray]], buckets: int, length: int) -> Iterator[pd.DataFrame]:
    """One block's runs: the earliest of equal ones are packed by the anchor's bucket, the later ones are settled here."""
    block = [x for x in block if x]
    if not block:
        return
    runs, new, later = _earliest({k: np.concatenate([x[k] for x in block]) for k in block[0]})
    rows: list[dict] = []
    k = np.flatnonzero(later)
    # settled rows travel with any bucket
    rows.append({"bucket": int(runs["h"][0] % np.uint64(buckets)), "doc": runs["doc"][k].tobytes(), "a": runs["a"][k].astype("<i4").tobytes(), "b": (runs["b"][k] + length).astype("<i4").tobytes(), "n": len(k)})
    k = np.flatnonzero(new)
    runs = {name: v[k] for name, v in runs.items()}
    runs["back"], runs["more"] = runs["pos"] - runs["a"], runs["b"] - runs["a"]
    bucket = (runs["h"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    packed = {name: runs[name][order].astype(kind) for name, kind in PACKED.items()}
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
        rows.append({"bucket": int(bucket[order[x]]), "n": -1} | {name: v[x:y].tobytes() for name, v in packed.items()})
    yield pd.DataFrame(rows, columns=["bucket", "n", "b", *PACKED])


def ship_runs(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, bases, parts, size, held, block = [], [], [], 0, 0, []
        for pdf in batches:
            for i, text in zip(pdf["id"].tolist(), pdf["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for base in range(0, max(1, len(data) - length + 1), PIECE):
                    part = data[base : base + PIECE + length - 1]
                    if len(part) < length:
                        continue
                    if size and size + len(part) > PIECE:
                        block.append(piece_runs(ids, bases, parts, length))
                        ids, bases, parts, held, size = [], [], [], held + size, 0
                        if held >= BLOCK:
                            yield from _ship(block, buckets, length)
                            block, held = [], 0
                    ids.append(i)
                    bases.append(base)
                    parts.append(part)
                    size += len(part)
        if parts:
            block.append(piece_runs(ids, bases, parts, length))
        yield from _ship(block, buckets, length)

    schema = "bucket long, n long, b binary, " + ", ".join(f"{name} binary" for name in PACKED)
    return docs.mapInPandas(run, schema)


def settle_runs(shipped: DataFrame, length: int, buckets: int) -> DataFrame:
    """Of all runs by anchor: (doc, a, b) removed for later copies of a span, with key null; and for anchors with several
    spans the earliest of each, with the anchor as key: (key, doc, pos, a, b, hot), windows from a to b. Spans of an anchor
    that has MANY are hot: they are cut into parts of SPAN windows."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf[pdf["n"] > 0].itertuples():
            out.append(pd.DataFrame({"doc": np.frombuffer(r.doc, "<i8"), "a": np.frombuffer(r.a, "<i4"), "b": np.frombuffer(r.b, "<i4")}))
        packed = pdf[pdf["n"] < 0]
        if len(packed):
            runs = {name: np.frombuffer(b"".join(packed[name]), kind) for name, kind in PACKED.items()}
            runs["a"] = runs["a"].astype(np.int64)
            runs, new, later = _earliest(runs)
            b = runs["a"] + runs["more"]
            out.append(pd.DataFrame({"doc": runs["doc"][later], "a": runs["a"][later], "b": b[later] + length}))
            k = np.flatnonzero(new)
            h = runs["h"][k]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            spans = np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h))))
            k, spans = k[spans > 1], spans[spans > 1]
            a, b, pos = runs["a"][k], b[k], runs["a"][k] + runs["back"][k]
            key, doc, hot = runs["h"][k].view(np.int64), runs["doc"][k], spans > MANY
            out.append(pd.DataFrame({"doc": doc[~hot], "a": a[~hot], "b": b[~hot], "key": key[~hot], "pos": pos[~hot], "hot": False}))
            if hot.any():  # equal windows lie equally far before the anchor
                a, b, pos, key, doc = a[hot], b[hot], pos[hot], key[hot], doc[hot]
                for j in range((length - ANCHOR) // SPAN + 1):
                    low, high = np.maximum(a, pos - SPAN * j - SPAN + 1), np.minimum(b, pos - SPAN * j)
                    k = low <= high
                    out.append(pd.DataFrame({"doc": doc[k], "a": low[k], "b": high[k], "key": key[k], "pos": pos[k], "hot": True}))
        out = [x for x in out if len(x)]
        if not out:
            return pd.DataFrame(columns=["doc", "a", "b", "key", "pos", "hot"])
        out = pd.concat(out).reindex(columns=["doc", "a", "b", "key", "pos", "hot"])
        return out.astype({"key": "Int64", "pos": "Int64", "hot": "boolean"})

    return shipped.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(settle, "doc long, a long, b long, key long, pos long, hot boolean")


def compare_windows(texts: list[bytes], docs: list[int], starts: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(document, from, to) of every window in the texts that equals an earlier one among them.

    The texts are laid end to end between separators and their suffixes sorted; windows that begin alike are then
    neighbours, and a class of equal ones keeps its earliest (smallest document, then start)."""
    sizes = np.array([len(t) for t in texts])
    raw = b"\0".join(texts) + b"\0"
    data = np.frombuffer(raw, np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    letters = data.astype(np.int64) + 1
    letters[begins + sizes] = 0
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    ranks = suffix_array(letters)
    inside = ranks + length <= begins[owner[ranks]] + sizes[owner[ranks]]
    windows = ranks[inside]
    if not len(windows):
        return
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.zeros(len(windows), dtype=bool)
    for at in range(1, len(windows), 4096):
        part = windows[at : at + 4096]
        same[at : at + len(part)] = (view[part] == view[windows[at - 1 : at - 1 + len(part)]]).all(axis=1)
    label = np.cumsum(~same)
    doc = np.array(docs)[owner[windows]]
    start = np.array(starts)[owner[windows]] + windows - begins[owner[windows]]
    order = np.lexsort((start, doc, label))
    label, doc, start = label[order], doc[order], start[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], label[1:] != label[:-1])), np.arange(len(label)), 0))
    later = (doc != doc[first]) | (start != start[first])
    doc, start = doc[later], start[later]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if len(doc):
        cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(start) != 1)) + 1
        for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
            yield int(doc[x]), int(start[x]), int(start[y - 1]) + length


def compare_spans(spans: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc, a, b) removed among the spans (key, doc, pos, a, b, bytes) that share an anchor."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        # windows up to SPAN apart share a core of bytes; equal windows have equal cores, equally far from the anchor
        cores: dict[tuple, dict[bytes, tuple[int, int]]] = {}
        for key, doc, pos, a, b, data in zip(pdf["key"].tolist(), pdf["doc"].tolist(), pdf["pos"].tolist(), pdf["a"].tolist(), pdf["b"].tolist(), pdf["bytes"], strict=True):
            for j in range((pos - b) // SPAN, (pos - a) // SPAN + 1):
                near, far = pos - SPAN * j, pos - SPAN * j - SPAN + 1
                low, high = max(a, far), min(b, near)
                whole = data[low - a : high - a + length]
                known = cores.setdefault((key, j, data[near - a : far - a + length]), {})
                was = known.get(whole)
                if was is None:
                    known[whole] = (doc, low)
                elif was != (doc, low):
                    if was > (doc, low):
                        known[whole], was = (doc, low), was
                    else:
                        was = (doc, low)
                    out.append((was[0], was[1], was[1] + len(whole)))
        texts, docs, starts, size = [], [], [], 0
        for known in cores.values():
            if len(known) > 1:
                for whole, (doc, start) in known.items():
                    texts.append(whole)
                    docs.append(doc)
                    starts.append(start)
                    size += len(whole) + 1
                if size >= CHUNK:
                    out += compare_windows(texts, docs, starts, length)
                    texts, docs, starts, size = [], [], [], 0
        if texts:
            out += compare_windows(texts, docs, starts, length)
        return pd.DataFrame(out, columns=["doc", "a", "b"])

    salted = spans.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return salted.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(compare, "doc long, a long, b long")


def _cut_spans(joined: DataFrame, length: int) -> DataFrame:
    """(key, doc, pos, a, b, bytes) from texts with their lists of spans. The key of a hot part takes in the core of bytes
    that all its windows hold: equal windows still meet, and an anchor that very many texts share is spread."""
    import xxhash

    def keyed(s, data: bytes) -> int:
        if not s["hot"]:
            return s["key"]
        j = (s["pos"] - s["b"]) // SPAN
        core = data[s["pos"] - SPAN * j : s["pos"] - SPAN * j - SPAN + 1 + length]
        return xxhash.xxh3_64_intdigest(core, (s["key"] + j) % (1 << 64)) - (1 << 63)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, spans in zip(pdf["doc"].tolist(), pdf["text"], pdf["spans"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(keyed(s, data), doc, s["pos"], s["a"], s["b"], data[s["a"] : s["b"] + length]) for s in spans]
            yield pd.DataFrame(rows, columns=["key", "doc", "pos", "a", "b", "bytes"])

    return joined.mapInPandas(cut, "key long, doc long, pos long, a long, b long, bytes binary")


def removed_ranges(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ranges array<struct<a, b>>): byte ranges to remove of each document that loses some; they may overlap.

    Every window of `length` bytes has an anchor, its least hash, so equal windows have equal anchors. Runs of windows
    with one anchor travel as hashes. Runs that span the same bytes are settled by their earliest: inside a task's
    block first, so that many copies don't meet in one place, then overall. Only where an anchor has several spans,
    about where texts begin and cease to agree, bytes are fetched, and suffix arrays find the equal windows."""
    if length < ANCHOR + SPAN:
        raise ValueError(f"strings of less than {ANCHOR + SPAN} bytes have no room for an anchor")
    buckets = text_partitions(docs, text_col, BUCKET)
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    settled = materialise(settle_runs(ship_runs(known, length, buckets), length, buckets), "runs")
    by_doc = settled.where("key is not null").groupBy("doc").agg(F.collect_list(F.struct("key", "pos", "a", "b", "hot")).alias("spans"))
    by_doc = materialise(by_doc, "spans")
    fetched = _cut_spans(known.withColumnRenamed("id", "doc").join(by_doc, "doc"), length)
    compared = materialise(compare_spans(fetched, length, buckets), "windows")
    both = settled.where("key is null").select("doc", "a", "b").union(compared)
    return both.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def _merge(ranges, size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(r["a"]), min(int(r["b"]), size)) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def remove_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the UTF-8 bytes that stay.

    A byte goes if it lies in a string of `length` bytes that also starts earlier: in a smaller id, or in the same text
    before. Strings are judged on the input. A null text counts as empty and rows with a null id stay whole; texts
    shorter than `length` lose nothing. Ids are taken to be unique: rows that repeat an id and text count as one
    document, and each gets its result. An empty table gives no rows. With keep_columns the columns of docs are
    returned instead, with the bytes removed from the text; parts of a character that a cut leaves are dropped, and null
    texts stay null."""
    ranges = materialise(removed_ranges(docs, length, id_col, text_col).withColumnRenamed("doc", "__id"), "ranges")
    # docs may have columns of these names
    joined = docs.join(ranges, docs[id_col].cast("long") == ranges["__id"], "left").select(*[docs[c] for c in docs.columns], ranges["ranges"].alias("__ranges"))
    fields = docs.schema.fields if keep_columns else [docs.schema[id_col]]
    names = [f.name for f in fields]
    if not keep_columns:
        joined = joined.select(id_text(id_col), F.col(text_col).alias("text"), F.col("__ranges").alias("ranges"))

        def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for doc, text, found in zip(pdf["id"], pdf["text"], pdf["ranges"], strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    cuts = [] if found is None else _merge(found, len(data))
                    sha, at = hashlib.sha256(), 0
                    for a, b in cuts:
                        sha.update(data[at:a])
                        at = b
                    sha.update(data[at:])
                    rows.append((doc, len(data), sum(b - a for a, b in cuts), len(cuts), sha.hexdigest()))
                yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return typed_ids(joined.mapInPandas(digest, "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), docs, id_col)

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, ranges, strict=True):
            if text is not None and found is not None:
                data = text.encode("utf-8", "surrogatepass")
                parts, at = [], 0
                for a, b in _merge(found, len(data)):
                    parts.append(data[at:a])
                    at = b
                text = b"".join([*parts, data[at:]]).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    return joined.withColumn(text_col, F.when(F.col("__ranges").isNull(), F.col(text_col)).otherwise(shorten(F.col(text_col), F.col("__ranges")))).select(names)
