"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0).  Nothing
says how far a rule can be trusted: its vote probabilities in good and in bad documents are
estimated from the agreement of the rules over the whole table, with the share of good
documents.  The posterior probability of being good then decides, so a document that one rule
dislikes can stay and one that passes most rules narrowly can go.

Everything but the votes is a function of the pattern of votes.  Documents are counted per
pattern with map-side aggregation, at most ``3 ** len(RULES)`` rows whatever the number of
documents; the iterations are arithmetic on those counts, and the posterior is an expression
over the votes.

Null texts count as empty; empty and short texts fail the base rule.  Empty tables give empty
results.  Ids are carried along as they are, repeated or null; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquarry.llm.rows import let, stored, text_of, without_spaces, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_ends", "n_bare", "n_marked", "n_stutters"]
WINDOW = 8


def _occurrences(text: Column, chars: str) -> Column:
    """Number of the single-byte characters ``chars`` in ``text``."""
    left = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)
    return (F.octet_length(text) - F.octet_length(left)).cast("bigint")


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice; ``hashes`` in the order of the text."""

    def of_sorted(pairs):
        same = lambda p, j: F.get(pairs, j)["h"] == p["h"]
        repeated = F.transform(pairs, lambda p, j: F.when(F.coalesce(same(p, j - 1), F.lit(False)) | F.coalesce(same(p, j + 1), F.lit(False)), p["i"]))
        return let(F.sort_array(F.filter(repeated, lambda i: i.isNotNull())), lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda a, b: a + b))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_sorted))


def _window_hashes(w: Column) -> Column:
    """Hash of each run of ``WINDOW`` words, from hashes of runs of half the length, and so on."""

    def doubled(hashes: Column, step: int) -> Column:
        if step == WINDOW:
            return hashes
        pairs = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - step), rest_of(h), lambda a, b: F.xxhash64(a, b))
        rest_of = lambda h: F.slice(h, step + 1, F.size(h) - step)
        return let(hashes, lambda h: doubled(pairs(h), 2 * step))

    return doubled(F.transform(w, lambda x: F.xxhash64(x)), 1)


def repeated_words(w: Column) -> Column:
    """Words in ``WINDOW``-word windows found twice or more, the first occurrence included."""
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(_window_hashes(w), _covered))


def measures(text: Column) -> Column:
    """Struct of ``MEASURES`` of a text that is not null."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).alias("n"), repeated_words(w).alias("r"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("s")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return let(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda x: F.struct(
        x["w"]["n"].cast("bigint").alias("n_words"),
        F.char_length(without_spaces(text)).cast("bigint").alias("word_chars"),
        _occurrences(text, "#*$%&|<>").alias("n_symbols"),
        x["l"]["d"].cast("bigint").alias("n_dup_lines"),
        x["w"]["r"].cast("bigint").alias("n_repeat_words"),
        x["l"]["n"].cast("bigint").alias("n_lines"),
        x["w"]["s"].cast("bigint").alias("n_stutters"),
        F.regexp_count(text, F.lit("\\p{Lu}{2,}")).cast("bigint").alias("n_shouts"),
        F.regexp_count(text, F.lit("[.!?][\\x20\\x09-\\x0D]")).cast("bigint").alias("n_ends"),
        F.regexp_count(text, F.lit("(?<![^\\x20\\x09-\\x0D])[^\\p{L}\\x20\\x09-\\x0D]+(?![^\\x20\\x09-\\x0D])")).cast("bigint").alias("n_bare"),
        F.regexp_count(text, F.lit("[#*$%&|<>=_^~@\\\\{}](?![^\\x20\\x09-\\x0D])")).cast("bigint").alias("n_marked"),
    ))


# name, bad if, good if; between the two a rule abstains
RULES = [
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols < n_words"),
    ("symbol_chars", "50 * n_symbols > word_chars", "300 * n_symbols < word_chars"),
    ("bare_words", "5 * n_bare > n_words", "20 * n_bare < n_words"),
    ("marked_words", "5 * n_marked > n_words", "50 * n_marked < n_words"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 11 * n_words", "word_chars between 4 * n_words and 8 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    ("repetition", "100 * n_repeat_words > 20 * n_words", "n_repeat_words = 0"),
    ("stutters", "10 * n_stutters > n_words", "50 * n_stutters < n_words"),
    ("shouting", "10 * n_shouts > 2 * n_words", "50 * n_shouts < n_words"),
    ("sentences", "200 * n_ends < n_words", "60 * n_ends >= n_words and 3 * n_ends <= n_words"),
    ("length", "n_words < 30", "n_words >= 60"),
]
VOTES = [f"vote_{name}" for name, _, _ in RULES]


def with_votes(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """Columns ``carry`` packed as ``row``, then the measures and the votes."""
    measured = docs.select(F.struct(*carry).alias("row"), measures(text_of(docs, text_col)).alias("_m")).select("row", "_m.*")
    return measured.select(
        "*",
        F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
        *(F.expr(f"int(case when {bad} then -1 when {good} then 1 else 0 end)").alias(f"vote_{name}") for name, bad, good in RULES),
    )


def _likelihood(tables: list[dict[int, float]]) -> Column:
    """Product over the rules of the probability of the vote given, in logarithms."""
    import math

    parts = [
        F.when(F.col(v) == 1, math.log(p[1])).when(F.col(v) == -1, math.log(p[-1])).otherwise(math.log(p[0]))
        for v, p in zip(VOTES, tables, strict=True)
    ]
    return reduce(lambda a, b: a + b, parts)


def posterior(model: dict) -> Column:
    """Probability of a good document, given its votes."""
    import math

    odds = _likelihood(model["good"]) - _likelihood(model["bad"]) + math.log(model["prior"] / (1 - model["prior"]))
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, iterations: int = 40, tolerance: float = 1e-7) -> dict:
    """Estimate the share of good documents and each rule's vote probabilities by EM.

    ``patterns`` has the vote columns and ``n``, a row per pattern.  The start says only that
    rules are better than chance.  One document is added to each count, so no probability
    becomes 0.
    """
    counts = sorted((tuple(r[v] for v in VOTES), r["n"]) for r in patterns.collect())
    model = {
        "prior": 0.7,
        "good": [{1: 0.78, 0: 0.2, -1: 0.02} for _ in RULES],
        "bad": [{1: 0.3, 0: 0.3, -1: 0.4} for _ in RULES],
    }
    for _ in range(iterations):
        sides = {"good": [], "bad": []}
        for votes, n in counts:
            odds = model["prior"] / (1 - model["prior"])
            for v, g, b in zip(votes, model["good"], model["bad"], strict=True):
                odds *= g[v] / b[v]
            sides["good"].append(n * odds / (1 + odds))
            sides["bad"].append(n / (1 + odds))
        totals = {side: sum(weights) for side, weights in sides.items()}
        last, model = model, {
            "prior": min(max((totals["good"] + 1) / (sum(totals.values()) + 2), 1e-6), 1 - 1e-6),
            **{side: [
                {k: (sum(w for w, (votes, _) in zip(weights, counts, strict=True) if votes[i] == k) + 1) / (totals[side] + 3)
                 for k in (1, 0, -1)} for i in range(len(RULES))] for side, weights in sides.items()},
        }
        if abs(model["prior"] - last["prior"]) < tolerance:
            break
    return model


def patterns_of(votes: DataFrame) -> DataFrame:
    """Number of documents per pattern of votes; those that fail the base rule take no part."""
    return votes.filter("not base_failed").groupBy(*VOTES).agg(F.count(F.lit(1)).alias("n"))


def score_quality(
    docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, threshold: float = 0.5
) -> DataFrame:
    """A row per document: ``row`` (its columns ``carry``), measures, votes, ``p_good``, ``kept``."""
    votes = stored(with_votes(docs, text_col, carry or docs.columns), "votes")
    model = fit(patterns_of(votes))
    scored = votes.withColumn("p_good", posterior(model))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6``: the measures and the verdict on every document."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_good", 6).alias("p_good"), *VOTES,
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: only documents that the rules keep."""
    return score_quality(docs).filter("kept").select("row.*")
