"""Quality rules: text statistics, a base filter, and a decision list learned from labelled statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: ASCII white space, between words.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: What rules may test, from the statistics; each is a share or a mean, so that it doesn't depend on a text's length.
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "chars_per_word": "word_chars / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "marks_per_word": "n_marks / n_words",
    "stutter_share": "n_stutters / n_words",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with how many bad and good rows it covered when it was pruned."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks, n_stutters (words equal to the one before).

    Words are runs without ASCII white space. n_dup_lines counts lines with a word that equal an earlier one,
    n_repeat_words the words in windows of 8 words that occur twice or more in the text, the first occurrence included.
    A null text counts as empty. All of it is computed inside the row. keep_rows adds the row itself as struct `row`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    trimmed = F.btrim("t", F.lit(SPACE_CHARS))
    carried = ["id", "row"] if keep_rows else ["id"]
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep_rows else []
    spaced = docs.select(F.col(id_col).alias("id"), text.alias("t"), *row).select(
        *carried,
        "t",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    n = F.size("words")
    # hashes of the windows, in order; a text that repeats none is done at once
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(
        F.array().cast("array<long>")
    )
    hashed = spaced.select(
        *carried,
        n.cast("long").alias("n_words"),
        (F.length("t") - count(SPACE)).alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count("[A-Z]").alias("n_upper"),
        count("[!?]").alias("n_marks"),
        F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).cast("long").alias("n_stutters"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    # the starts of windows whose hash occurs again, ascending: sorted by hash, a start counts if a neighbour's hash is its own
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    sorted_ = hashed.withColumn("placed", F.when(repeats, placed)).drop("hashes")
    again = F.filter(
        "placed",
        lambda x, k: (F.try_element_at("placed", F.greatest(k, F.lit(1)))["h"] == x["h"]) & (k > 0)
        | F.coalesce(F.try_element_at("placed", k + 2)["h"] == x["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    # a start covers 8 words, less those that the start before it has covered
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum"), i.alias("last")),
    )["sum"]
    out = sorted_.withColumn("starts", starts).drop("placed")
    return out.select(
        F.col("id").alias(id_col), *[c for c in out.columns if c not in ("id", "starts")], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    """stats with the FEATURES; a share of nothing is 0."""
    parts = {name: e.split(" / ") for name, e in FEATURES.items()}
    return stats.withColumns({name: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for name, (a, b) in parts.items()})


def learn_rules(
    features: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    max_labelled: int = 200_000,
    max_rules: int = 8,
    max_conditions: int = 3,
    cuts: int = 24,
    min_precision: float = 0.9,
    min_covered: int = 5,
) -> list[Rule]:
    """An ordered list of conjunctions that reject bad rows, by sequential covering.

    labels: (id, bad boolean); repeats of an id count as their mean, and nulls not at all. At most about max_labelled
    labelled rows, chosen by a hash of the id, are used. Two thirds of them grow a rule: the threshold condition with
    most information gain is added until no good row is left in it. The last third prunes it: conditions are dropped
    from the end while (bad - good) / (bad + good) doesn't fall. A rule stays if its lower 90 % bound of precision over
    the rows kept for pruning reaches min_precision; what it covers is taken away and the next is grown. Each step is one
    aggregate over the labelled table, counted by feature and cut; only those counts reach the driver."""
    marked = labels.where("bad is not null").groupBy(id_col).agg(F.avg(F.col("bad").cast("double")).alias("bad")).where("bad <> 0.5")
    marked = features.where(~base_failed()).select(id_col, *FEATURES).join(marked.select(id_col, (F.col("bad") > 0.5).alias("bad")), id_col)
    rows = materialise(marked, "labelled")
    total = rows.count()
    if not total:
        return []
    if total > max_labelled:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(1_000_000)) < int(1e6 * max_labelled / total))
    quantiles = [k / (cuts + 1) for k in range(1, cuts + 1)]
    found = rows.agg(
        *[F.percentile_approx(c, F.array(*map(F.lit, quantiles)), 10_000).alias(c) for c in FEATURES],
        *[F.percentile_approx(F.when(F.col("bad"), F.col(c)), F.array(*map(F.lit, quantiles)), 10_000).alias(c + "_bad") for c in FEATURES],
    ).first()
    values = {c: sorted({*(found[c] or []), *(found[c + "_bad"] or [])}) for c in FEATURES}
    points = {c: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for c, v in values.items()}
    binned = rows.select(
        "bad",
        (F.pmod(F.xxhash64(id_col), F.lit(3)) < 2).alias("grows"),
        *FEATURES,
        *[sum((F.col(c) > p).cast("int") for p in points[c]).cast("int").alias(f"bin_{c}") if points[c] else F.lit(0).alias(f"bin_{c}") for c in FEATURES],
    )
    left = materialise(binned, "binned")

    def counts(within: DataFrame) -> dict[str, list[tuple[int, bool, int]]]:
        cells = ", ".join(f"'{c}', bin_{c}" for c in FEATURES)
        got = within.where("grows").selectExpr("bad", f"stack({len(FEATURES)}, {cells}) as (feature, bin)").groupBy("feature", "bin", "bad").count().collect()
        out: dict[str, list[tuple[int, bool, int]]] = {c: [] for c in FEATURES}
        for r in got:
            out[r["feature"]].append((r["bin"], r["bad"], r["count"]))
        return out

    rules: list[Rule] = []
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        inside = left
        while len(conditions) < max_conditions:
            table = counts(inside)
            some = next(iter(table.values()))
            bad, good = sum(n for _, b, n in some if b), sum(n for _, b, n in some if not b)
            if not bad or not good:
                break
            best, gain = None, 0.0
            for c, cells in table.items():
                for k, point in enumerate(points[c]):
                    # bin counts the cuts below the value, so bin > k means value > points[k]
                    up = [sum(n for i, b, n in cells if b is kind and i > k) for kind in (True, False)]
                    for above, (p, q) in ((True, up), (False, [bad - up[0], good - up[1]])):
                        if p >= min_covered and (g := p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good)))) > gain:
                            best, gain = Condition(c, above, float(point)), g
            if best is None:
                break
            conditions.append(best)
            inside = inside.where(best.column())
        if not conditions:
            break
        # one aggregate judges all shortenings of the rule on the rows kept for pruning, and on all
        within = [Rule(tuple(conditions[: k + 1]), 0, 0).column() for k in range(len(conditions))]
        sums = [F.sum((w & (F.col("bad") == b) & (~F.col("grows") if held else F.lit(True))).cast("long")) for w in within for held in (True, False) for b in (True, False)]
        flat = [x or 0 for x in left.agg(*sums).first()]
        scored = [flat[4 * k : 4 * k + 4] for k in range(len(conditions))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n, _, _ in scored]
        k = min(range(len(conditions)), key=lambda i: (-worth[i], i))
        held, (bad, good) = scored[k][:2], scored[k][2:]
        # only rows that didn't grow the rule judge it
        if bad + good < min_covered or not sum(held) or _lower_bound(held[0], sum(held)) < min_precision:
            break
        rule = Rule(tuple(conditions[: k + 1]), bad, good)
        rules.append(rule)
        left = materialise(left.where(~rule.column()), "binned")
    return rules


def _lower_bound(hits: int, n: int, z: float = 1.2816) -> float:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: the number of the first rule that rejects, from 1, or 0."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(), F.lit(k))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False, **learning) -> DataFrame:
    """Per row of docs: the id, the statistics, base_failed, rule (number of the rejecting rule, else 0) and kept.

    labels: (id, bad boolean), possibly empty: then only the base filter decides. A null text counts as empty and so
    fails it. Repeated rows stay; other columns are ignored; an empty table gives no rows. keep_rows adds each row as
    struct `row`."""
    stats = materialise(statistics(docs, id_col, text_col, keep_rows), "statistics")
    features = with_features(stats)
    rules = learn_rules(features, labels, id_col, **learning)
    judged = features.withColumn("base_failed", base_failed()).withColumn("rule", F.when(F.col("base_failed"), 0).otherwise(verdict(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop(*FEATURES)
