"""Language-model scores: stupid backoff over n-gram counts of the whole corpus, a document's own counts left out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, text_partitions

#: UTF-8 bytes of text in a block, within which n-grams are counted before they are shuffled.
BLOCK = 1 << 23
#: Bytes of text whose n-grams one bucket counts.
BUCKET = 1 << 26
#: Stands for a null id inside blocks.
NO_ID = -(1 << 63)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * MIX) ^ (right + (left >> np.uint64(29)))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ngram_hashes(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to order, the hash of the n-gram that ends at each word; 0 where the document has fewer words before.

    words: a hash of each word; first: the place in its document."""
    out = [words]
    for n in range(2, order + 1):
        h = np.zeros_like(words)
        h[1:] = _combine(out[-1][:-1], words[1:])
        h[first < n - 1] = 0
        out.append(h)
    return out


def _unique(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct hashes of all orders, how often each occurs, for each order the place of each word's hash, -1 for none)."""
    flat = np.concatenate(hashes)
    distinct, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    places = [p.astype(np.int64) for p in np.split(inverse, len(hashes))]
    for p, h in zip(places[1:], hashes[1:], strict=True):
        p[h == 0] = -1
    return distinct, counts, places


def _shrink(codes: np.ndarray, width: int) -> bytes:
    """Codes as compressed planes of bytes; frequent words have small codes, so high planes are almost empty."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(codes.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _grow(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    top = int(values.max(initial=0))
    return values.astype(next(kind for kind in ("u1", "<u2", "<u4", "<u8") if top <= np.iinfo(kind).max)).tobytes()


def _widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, sizes, codes, vocabulary): words of some documents as places in the block's own vocabulary of hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        ids, sizes, codes, known, held = [], [], [], {}, 0

        def row() -> pd.DataFrame:
            vocabulary = np.fromiter((digest(w) | 1 for w in known), np.uint64, len(known))
            flat = np.concatenate(codes)
            by_count = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
            rank = np.empty(len(known), dtype=np.int64)
            rank[by_count] = np.arange(len(known))
            width = 2 if len(known) <= 1 << 16 else 4
            return pd.DataFrame([{"block": uuid.uuid4().hex, "ids": np.array(ids, dtype="<i8").tobytes(), "sizes": np.array(sizes, dtype="<i8").tobytes(), "codes": _shrink(rank[flat], width), "width": width, "vocabulary": vocabulary[by_count].astype("<u8").tobytes()}])

        for pdf in batches:
            for i, text in zip(pdf["id"].tolist(), pdf["text"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                words = data.lower().split()
                ids.append(i)
                sizes.append(len(words))
                codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                held += len(data) + 64
                if held >= BLOCK:
                    yield row()
                    ids, sizes, codes, known, held = [], [], [], {}, 0
        if ids:
            yield row()

    return docs.mapInPandas(run, "block string, ids binary, sizes binary, codes binary, width int, vocabulary binary")


def _read(r, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(ids, document of each word, its place there, _unique of the n-grams) of a block's row."""
    ids, sizes = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.sizes, "<i8")
    words = np.frombuffer(r.vocabulary, "<u8")[_grow(r.codes, r.width)]
    owner = np.repeat(np.arange(len(ids)), sizes)
    first = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return ids, owner, first, _unique(ngram_hashes(words, first, order))


def _deal(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the hashes by bucket, bounds of the buckets in it); hash 0 stands for no n-gram and goes along.

    The bucket comes from the upper bits; within it the lower 48 name the n-gram."""
    bucket = (distinct >> np.uint64(44)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _own_counts(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each word, how often its n-gram occurs in its own document."""
    key = owner.astype(np.int64) * (int(place.max(initial=0)) + 2) + place + 1
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse]


def backoff_logs(owner: np.ndarray, places: list[np.ndarray], counts: np.ndarray, words_total: int, discount: float) -> np.ndarray:
    """log10 of each word's stupid-backoff score, from corpus counts by place, with its own document's counts left out.

    The longest n-gram that other documents hold gives count / count of its history; each shorter one costs `discount`;
    a word that no other document holds counts as half an occurrence."""
    own = [_own_counts(owner, p) for p in places]
    rest = [np.where(p >= 0, counts[p] - o, 0) for p, o in zip(places, own, strict=True)]
    total = np.maximum(words_total - np.bincount(owner)[owner] if len(owner) else owner, 1)
    score = np.maximum(rest[0], 0.5) / total
    for n in range(1, len(places)):
        # the history ends one word before; others' n-grams imply others' histories
        history = np.zeros(len(owner), dtype=np.int64)
        history[1:] = rest[n - 1][:-1]
        whole = places[n] >= 0
        seen = whole & (rest[n] > 0)
        score = np.where(seen, rest[n] / np.maximum(history, 1), np.where(whole, discount * score, score))
    return np.log10(score)


def score_documents(
    docs: DataFrame, order: int = 2, discount: float = 0.4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, log10_score: the sum over the words, mean_log10: per word; null without words) of every row.

    Words are runs without ASCII white space, with A-Z lower-cased. Counts cover all documents; each document is scored
    by the others' counts. Null texts count as empty; rows with a null id count and score under a null id; rows that
    repeat an id are documents of their own, so a copy vouches for its twin. Other columns are ignored; an empty table
    gives no rows.

    Each task counts the n-grams of a block of documents and sends each distinct hash once to the bucket that holds its
    share of the count table, so a frequent n-gram arrives once a block. Buckets answer with the corpus counts, in the
    order in which they were asked, and each block sums the scores of its documents. Nothing is kept for the whole
    corpus in one place."""
    buckets = text_partitions(docs, text_col, BUCKET)
    blocks = materialise(_blocks(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))), "blocks")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                distinct, counts, _ = _read(r, order)[3]
                at, bounds = _deal(distinct, buckets)
                hashes, counts = np.ascontiguousarray(distinct[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]), counts[at]
                yield pd.DataFrame(
                    [(b, r.block, hashes[x:y].tobytes(), _narrow(counts[x:y])) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x],
                    columns=["bucket", "block", "hashes", "counts"],
                )

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.zeros((sum(map(len, pdf["hashes"])) // 6, 8), dtype=np.uint8)
        low[:, :6] = np.frombuffer(b"".join(pdf["hashes"]), np.uint8).reshape(-1, 6)
        sizes = [len(h) // 6 for h in pdf["hashes"]]
        _, inverse = np.unique(low.view("<u8").ravel(), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([_widen(c, n) for c, n in zip(pdf["counts"], sizes, strict=True)])).astype("<i8")
        cuts = np.cumsum(sizes)[:-1]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "counts": [_narrow(total[x]) for x in np.split(inverse, cuts)]})

    asked = blocks.mapInPandas(ask, "bucket int, block string, hashes binary, counts binary")
    answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(answer, "block string, bucket int, counts binary")
    sizes = blocks.mapInPandas(_block_sizes, "n long").agg(F.sum("n")).first()[0] or 0

    def score(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            ids, owner, _, (distinct, _, places) = _read(r, order)
            counts = np.zeros(len(distinct), dtype=np.int64)
            at, bounds = _deal(distinct, buckets)
            for b, data in zip(told["bucket"], told["counts"], strict=True):
                counts[at[bounds[b] : bounds[b + 1]]] = _widen(data, bounds[b + 1] - bounds[b])
            logs = backoff_logs(owner, places, counts, sizes, discount)
            n = np.bincount(owner, minlength=len(ids))
            out.append(pd.DataFrame({"id": ids, "n_words": n, "log10_score": np.bincount(owner, weights=logs, minlength=len(ids))}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n_words": [], "log10_score": []})

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, "id long, n_words long, log10_score double")
    some = F.col("n_words") > 0
    return scored.select(
        F.when(F.col("id") != NO_ID, F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col),
        "n_words",
        F.when(some, F.col("log10_score")).alias("log10_score"),
        F.when(some, F.col("log10_score") / F.col("n_words")).alias("mean_log10"),
    )


def _block_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"n": [int(np.frombuffer(s, "<i8").sum()) for s in pdf["sizes"]]})
