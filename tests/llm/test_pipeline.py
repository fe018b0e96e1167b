"""The corpus pipeline against a plain chain over a small corpus."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(rng, n):
    return [w.capitalize() if k % 9 == 0 else w for k, w in enumerate(rng.choices(VOCABULARY, k=n))]


VOCABULARY = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=random.Random(k).randint(2, 9))) for k in range(4000)]


def jaccard(a, b, n=5):
    sets = []
    for t in (a, b):
        found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(found[k : k + n]) for k in range(max(1, len(found) - n + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def plain_groups(texts, similarity=0.8):
    """The smallest id of each group that links by similarity join."""
    of = {i: i for i in texts}
    ids = sorted(texts)
    for x in ids:
        for y in ids:
            if x < y and of[x] != of[y] and jaccard(texts[x], texts[y]) >= similarity:
                low, high = sorted((of[x], of[y]))
                of = {i: low if g == high else g for i, g in of.items()}
    return of


def plain_repeats(texts, length=100):
    """Texts without the bytes covered by strings of this length that also start earlier."""
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        cut = bytearray(len(data))
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                cut[k : k + length] = b"\1" * length
            seen.add(window)
        out[i] = bytes(c for c, gone in zip(data, cut, strict=True) if not gone).decode("utf-8", "ignore")
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = {i: " ".join(words(rng, rng.randint(120, 260))) for i in range(1, 41)}
    base = texts[1].split()
    for k, share in enumerate((0.80, 0.83, 0.88, 0.95)):  # another text's beginning is appended, or the end cut off
        texts[50 + k] = " ".join(base + words(rng, int(len(base) * (1 / share - 1)) - 3))
        texts[60 + k] = " ".join(base[: int(len(base) * share) + 3])
        scattered = list(base)
        for at in rng.sample(range(len(base)), k=max(1, int(len(base) * (1 - share) / 12))):
            scattered[at] = "zzz"
        texts[70 + k] = " ".join(scattered)
    texts[80] = texts[5]
    passage = " ".join(words(rng, 60))
    for i in (10, 11, 12):
        texts[i] += " " + passage
    texts[13] += " write to someone@example.org"
    texts[90], texts[91] = "too short", "again and again the very same eight words " * 20
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t), "clash", 1) for i, t in texts.items()] + [(None, None, "en", "s", 0, "clash", 1), (95, None, "en", "s", 0, None, None), (96, "", "en", "s", 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, ranges int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts, docs.schema


def test_pipeline_equals_a_plain_chain(spark, corpus):
    folder, texts, schema = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    good = {i: t for i, t in texts.items() if i not in (90, 91)}
    assert {r.doc_id for r in kept.collect()} == set(good)
    single = stages["simhash_near_dedup"](spark, kept, folder)
    assert single.columns == docs.columns
    groups = plain_groups(good)
    firsts = {i: t for i, t in good.items() if groups[i] == i}
    assert {r.doc_id for r in single.collect()} == set(firsts) and len(firsts) < len(good) - 5
    cut = stages["suffix_dedup"](spark, single, folder)
    want = plain_repeats(firsts)
    assert {r.doc_id: r.text for r in cut.collect()} == want and want[12] != firsts[12]
    assert cut.where("n_chars <> length(text)").isEmpty() and cut.columns == docs.columns
    clean = stages["pii"](spark, cut, folder)
    got = {r.doc_id: r.text for r in clean.collect()}
    assert "someone@" not in got[13] and {i for i in got if got[i] != want[i]} == {13} and clean.columns == docs.columns
    placed = stages["packing"](spark, clean, folder).toPandas()
    assert set(placed.doc_id) == set(firsts) and placed.groupby("sequence_id").length.sum().max() <= 2048
    whole = corpus_pipeline.run(spark, folder)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(same).collect())) == sorted(placed[same].itertuples(index=False, name=None))


def test_runs_own_their_scratch(spark):
    from tidemark.llm.common import materialise, scratch_run

    outside = materialise(spark.range(3), "outside")
    with scratch_run(spark):
        inside = materialise(spark.range(4), "inside")
        lasting = materialise(spark.range(5), "lasting", lasting=True)
        where = Path(inside.inputFiles()[0].removeprefix("file://"))
        assert where.exists() and inside.count() == 4
    assert not where.parent.exists() and outside.count() == 3 and lasting.count() == 5


def test_empty_table(spark, corpus, tmp_path):
    _, _, schema = corpus
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_large_ids_beside_null_ids(spark):
    """Ids above 2^53 stay what they are in a batch that also holds a null id."""
    from tidemark.llm.bpe import default_tokenizer_path, encode_documents
    from tidemark.llm.html_extract import extract_main_text
    from tidemark.llm.packing import pack
    from tidemark.llm.simhash import near_duplicates
    from tidemark.llm.suffix_dedup import remove_repeats

    big = 2**53 + 1
    rows = [(big, "some words to keep"), (None, "some words to keep"), (big + 2, None), (big, "some words to keep")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = lambda df: sorted((r[0] for r in df.collect()), key=str)
    want = sorted([big, None, big + 2, big], key=str)
    for out in (encode_documents(frame, default_tokenizer_path()), pack(frame, default_tokenizer_path()), near_duplicates(frame), remove_repeats(frame)):
        assert ids(out) == want
    pages = frame.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.col("text").alias("html"))
    assert ids(extract_main_text(pages)) == want


def test_a_stage_ends_with_the_scratch_tables_of_the_one_before(spark, tmp_path):
    from tidemark.llm.common import end_stage, materialise, stage

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: {p.name.split("-")[1] for p in folder.glob("tidemark-*") if p.name.split("-")[1] in ("one", "two", "other")}

    @stage
    def first(spark, docs, sf_dir):
        return materialise(docs, "one").where("id > 1")

    @stage
    def second(spark, docs, sf_dir):
        assert held() == {"other"}
        return materialise(docs, "two")

    materialise(spark.range(2), "other")
    first(spark, spark.range(5), "").write.parquet(str(tmp_path / "a"))
    assert held() == {"one", "other"}
    second(spark, spark.read.parquet(str(tmp_path / "a")), "").write.parquet(str(tmp_path / "b"))
    assert held() == {"two", "other"}
    end_stage(spark)
    assert held() == {"other"} and spark.read.parquet(str(tmp_path / "b")).count() == 3
