"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest_neighbours
from tidemark.llm.bpe import default_tokenizer_path, encode_documents
from tidemark.llm.common import table
from tidemark.llm.decontaminate import find_overlaps, report
from tidemark.llm.html_extract import extract_main_text
from tidemark.llm.lm_scoring import score_documents
from tidemark.llm.manifest import prove, tampered_count
from tidemark.llm.packing import pack
from tidemark.llm.phrases import collocations
from tidemark.llm.pii import pseudonymise
from tidemark.llm.quality_rules import judge
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.url_filters import judge_urls

#: Not secret: a deployment passes its own.
DEMO_KEY = "demonstration key"


def bad_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, bad) from the labels."""
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), bad_quality(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), order=2, discount=0.4)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of its id."""
    judged = judge_urls(table(spark, sf_dir, "pages"), bad_quality(spark, sf_dir).withColumnRenamed("doc_id", "page_id"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_tokenizer_path())


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer_path(), capacity=2048, end_id=0)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), most=5, min_count=100, inside_percent=100, top=2000)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides an id's crc32, n_chars is received one too high."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    return prove(table(spark, sf_dir, "documents"), fields, received={"n_chars": tampered_count("doc_id", "n_chars", every=7)})


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_html_extraction": op4_html_extraction,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_bpe": op8_bpe,
    "op9_ann": op9_ann,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_decontamination": op13_decontamination,
}

def _level(name: str, table: str, key: str, parent: str, means: str) -> str:
    """CTEs that shrink a level's rates towards the means of its parent, with the prior's strength by moments."""
    return f"""{name}_prior AS (SELECT {parent}, sum(bad) / sum(seen) AS rate, sum(seen) AS seen, count(*) AS k, sum(bad * bad / seen) AS squares, sum(seen * seen) AS seen2 FROM {table} GROUP BY {parent}),
 {name}_excess AS (SELECT *, rate * (1 - rate) AS noise, squares - seen * rate * rate - (k - 1) * rate * (1 - rate) AS excess FROM {name}_prior),
 {name}_strength AS (SELECT {parent}, k, least(greatest(CASE WHEN excess > 0 AND noise > 0 THEN noise / (excess / greatest(seen - seen2 / seen, 1e-9)) - 1 ELSE 200 END, 5), 200) AS strength FROM {name}_excess),
 {name} AS (SELECT t.{key}, t.bad + s.strength * m.mean AS alpha, t.seen - t.bad + s.strength * (1 - m.mean) AS beta, (t.bad + s.strength * m.mean) / (t.seen + s.strength) AS mean
 FROM {table} t JOIN {name}_strength s USING ({parent}) JOIN {means} m USING ({parent}))"""


URL_SQL = f"""WITH marked AS (SELECT doc_id AS page_id, avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
 rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 parted AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
 hosts AS (SELECT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix, 0 AS root, sum(bad) AS bad, CAST(count(*) AS DOUBLE) AS seen FROM parted JOIN marked USING (page_id) WHERE host <> '' GROUP BY host),
 domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(seen) AS seen FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, 0 AS root, sum(bad) AS bad, sum(seen) AS seen FROM domains GROUP BY suffix),
 everything AS (SELECT 0 AS root, (sum(bad) + 0.5) / (sum(seen) + 1) AS mean FROM suffixes),
 {_level("of_suffix", "suffixes", "suffix", "root", "everything")}, {_level("of_domain", "domains", "domain", "suffix", "of_suffix")}, {_level("of_host", "hosts", "host", "domain", "of_domain")},
 unseen AS (SELECT DISTINCT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix FROM parted WHERE host <> '' AND host NOT IN (SELECT host FROM hosts)),
 given AS (SELECT u.host, coalesce(d.mean, x.mean, e.mean) AS m, CASE WHEN d.domain IS NOT NULL THEN CASE WHEN hs.k > 1 THEN hs.strength ELSE 5 END WHEN x.suffix IS NOT NULL THEN CASE WHEN ds.k > 1 THEN ds.strength ELSE 5 END ELSE CASE WHEN ss.k > 1 THEN ss.strength ELSE 5 END END AS s
 FROM unseen u LEFT JOIN of_domain d ON d.domain = u.domain LEFT JOIN of_host_strength hs ON hs.domain = d.domain LEFT JOIN of_suffix x ON x.suffix = u.suffix LEFT JOIN of_domain_strength ds ON ds.suffix = x.suffix CROSS JOIN everything e LEFT JOIN of_suffix_strength ss ON true),
 bounds AS (SELECT host, alpha, beta FROM of_host UNION ALL SELECT host, s * m, s * (1 - m) FROM given),
 low AS (SELECT host, alpha / (alpha + beta) - 1.645 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS bad_low FROM bounds),
 ruled AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7' WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parted)
 SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL OR low.bad_low > 0.4 THEN 'block' ELSE 'allow' END AS verdict FROM ruled r LEFT JOIN low USING (host)"""

#: Items of fewer than ten words are windows of their own length.
DECONTAMINATION_SQL = r"""WITH lower_docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS window_text
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(len(w), 10) AS m FROM items WHERE len(w) > 0))),
 lengths AS (SELECT DISTINCT m FROM windows),
 places AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS window_text FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lower_docs JOIN lengths ON len(w) >= m)),
 found AS (SELECT p.doc_id, p.m, p.i, x.item_id FROM places p JOIN windows x USING (m, window_text)),
 hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
 FROM lower_docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id)"""

COLLOCATION_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
 totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
 grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) AS lengths(m) WHERE len(w) >= m)),
 counts AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
 candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
 cuts AS (SELECT lang, phrase, m, a, k, array_to_string(w[1 : k], ' ') AS first_part, array_to_string(w[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
 scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score, c.k
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first_part JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
 weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 kept AS (SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.lang = x.lang AND c.a >= x.a AND length(c.phrase) > length(x.phrase) AND contains(' ' || c.phrase || ' ', ' ' || x.phrase || ' '))),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
 SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""

#: crc32 goes bit by bit over the decimal digits, from its usual start, with its usual polynomial.
MANIFEST_SQL = r"""WITH RECURSIVE texts AS (SELECT doc_id, lang, n_chars, text, source, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS t,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
   lambda c, d: list_reduce(list_prepend(xor(c, d), [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) % 7 = 0 AS tampered FROM documents),
 fields AS (SELECT doc_id, lang, t, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
   || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head, n_chars, n_chars + CASE WHEN tampered THEN 1 ELSE 0 END AS shown_chars, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM texts),
 leaves AS (SELECT doc_id, t, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
   sha256(head || CASE WHEN shown_chars IS NULL THEN '-' ELSE strlen(CAST(shown_chars AS VARCHAR)) || ':' || shown_chars END || tail) AS shown FROM fields),
 placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY t) AS n FROM leaves),
 up AS (SELECT t, 0 AS lvl, idx, leaf AS h, n FROM placed UNION ALL SELECT t, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2) FROM up WHERE n > 1 GROUP BY t, lvl, idx // 2),
 subroots AS (SELECT t - 1 AS idx, h, count(*) OVER () AS n FROM up WHERE n = 1),
 over_up AS (SELECT 0 AS lvl, idx, h, n FROM subroots UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2) FROM over_up WHERE n > 1 GROUP BY lvl, idx // 2),
 root AS (SELECT h AS root FROM over_up WHERE n = 1),
 siblings AS (SELECT p.t, p.idx, 0 AS phase, u.lvl, u.h FROM placed p JOIN up u ON u.t = p.t AND u.idx = xor(p.idx >> u.lvl, 1)
  UNION ALL SELECT p.t, p.idx, 1, u.lvl, u.h FROM placed p JOIN over_up u ON u.idx = xor((p.t - 1) >> u.lvl, 1)),
 proofs AS (SELECT t, idx, string_agg(h, '' ORDER BY phase, lvl) AS joined FROM siblings GROUP BY t, idx),
 fold AS (SELECT t, idx, 0 AS lvl, idx AS at, n, shown AS h FROM placed UNION ALL
  SELECT f.t, f.idx, f.lvl + 1, f.at // 2, (f.n + 1) // 2, sha256(CASE WHEN u.h IS NULL THEN f.h WHEN f.at % 2 = 0 THEN f.h || u.h ELSE u.h || f.h END) FROM fold f LEFT JOIN up u ON u.t = f.t AND u.lvl = f.lvl AND u.idx = xor(f.at, 1) WHERE f.n > 1),
 over_fold AS (SELECT f.t, f.idx, 0 AS lvl, f.t - 1 AS at, (SELECT count(*) FROM subroots) AS n, f.h FROM fold f WHERE f.n = 1 UNION ALL
  SELECT f.t, f.idx, f.lvl + 1, f.at // 2, (f.n + 1) // 2, sha256(CASE WHEN u.h IS NULL THEN f.h WHEN f.at % 2 = 0 THEN f.h || u.h ELSE u.h || f.h END) FROM over_fold f LEFT JOIN over_up u ON u.lvl = f.lvl AND u.idx = xor(f.at, 1) WHERE f.n > 1)
 SELECT p.doc_id, p.leaf, s.h AS subroot, r.root, sha256(coalesce(q.joined, '')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
 FROM placed p JOIN subroots s ON s.idx = p.t - 1 CROSS JOIN root r LEFT JOIN proofs q ON q.t = p.t AND q.idx = p.idx JOIN over_fold f ON f.t = p.t AND f.idx = p.idx AND f.n = 1"""

#: The other operators learn, hash, link, tokenize or search, which SQL can't say whole.
ORACLES: dict[str, str] = {"op7_url_filters": URL_SQL, "op11_collocations": COLLOCATION_SQL, "op12_merkle_manifest": MANIFEST_SQL, "op13_decontamination": DECONTAMINATION_SQL}
