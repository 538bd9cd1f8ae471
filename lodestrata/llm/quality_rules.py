"""Weak supervision: quality rules vote or abstain, EM weighs them.

Each rule looks at a few statistics of a text and votes clean (1), junk (-1)
or abstains (0). Rules are assumed to be right more often than not and to err
independently given the hidden class; expectation-maximisation over the counts
of vote patterns estimates the share of clean texts and each rule's accuracy.
A text is kept when its posterior probability of being clean reaches one half.

There are at most 3 ** len(RULES) vote patterns whatever the input's size, and
their counts are all that reaches the driver; they cover every row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, durable

#: Low bits of a packed window key that hold the window's position.
POSITION_BITS = 24
_LOW = (1 << POSITION_BITS) - 1

#: name: (SQL that is true for a junk vote, SQL that is true for a clean vote); else the rule abstains.
RULES = {
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
    "repeated_lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    "repeated_words": ("n_repeat_words > 0.25 * n_words", "n_repeat_words <= 0.1 * n_words"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    "letters": ("n_letters < 0.7 * word_chars", "n_letters > 0.9 * word_chars"),
    "variety": ("n_distinct < 0.2 * n_words", "n_distinct > 0.3 * n_words"),
    "punctuation": ("n_ends = 0 and n_words > 30", "n_ends * 60 >= n_words and n_ends * 3 <= n_words"),
    "length": ("n_words < 50", "n_words >= 80"),
}

_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_distinct", "n_ends"]


def _repeat_words_sql() -> str:
    """Words inside 3-word windows that occur twice or more in array w.

    Windows are sorted by a packed (hash, position) long. Neighbours with the
    same hash are compared word by word; if any pair differs, which takes a
    collision, that text is done again by sorting the windows themselves.
    """
    same = f"shiftrightunsigned(k[j], {POSITION_BITS}) = shiftrightunsigned(k[j - 1], {POSITION_BITS})"
    at, before = f"cast(k[j] & {_LOW} as int)", f"cast(k[j - 1] & {_LOW} as int)"
    clash = " or ".join(f"w[{at} + {d}] != w[{before} + {d}]" for d in range(3))
    covered = "cast(size(array_distinct(flatten(transform({starts}, p -> array(p, p + 1, p + 2))))) as long)"
    starts = f"flatten(transform(pairs, j -> array({at}, {before})))"
    windows = "array_sort(transform(sequence(0, size(w) - 3), i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) as s, i as i)))"
    exact = f"flatten(transform(array({windows}), z -> flatten(transform(filter(sequence(1, size(z) - 1), j -> z[j].s = z[j - 1].s), j -> array(z[j].i, z[j - 1].i)))))"
    return (
        f"case when size(w) < 4 then 0L when size(pairs) = 0 and size(w) < {_LOW} then 0L "
        f"when size(w) >= {_LOW} or exists(pairs, j -> {clash}) then {covered.format(starts=exact)} "
        f"else {covered.format(starts=starts)} end"
    ), f"filter(sequence(1, greatest(1, size(k) - 1)), j -> j < size(k) and {same})"


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the statistics of its whole text in columns named as in _STATS, which replace any of that name; null counts as empty.

    A text of 2^24 words or more, and one whose window hashes collide, has its windows themselves sorted.
    """
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in _STATS]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column of docs meets one of the steps below
    docs = docs.select(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    count, pairs = _repeat_words_sql()

    def removed(pattern: str):
        return F.char_length("_t") - F.char_length(F.regexp_replace("_t", pattern, ""))

    shown = (
        docs.withColumn("w", F.array_remove(F.split("_t", SPACE_CLASS), ""))
        .withColumn("lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.ltrim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0))
        .withColumn("word_chars", removed(SPACE_CLASS).cast("long"))
        .withColumn("word_chars", F.char_length("_t").cast("long") - F.col("word_chars"))
        .withColumn("n_symbols", removed(r"[#*$%&|<>]+").cast("long"))
        .withColumn("n_letters", removed(r"[\p{L}]+").cast("long"))
        .withColumn("n_ends", F.regexp_count("_t", F.lit(r"[.!?][ \t-\r]|[.!?]$")).cast("long"))
        .withColumn("k", F.expr(f"sort_array(transform(if(size(w) < 4, cast(array() as array<int>), sequence(0, size(w) - 3)), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & ~{_LOW}L) | i))"))
        .withColumn("pairs", F.expr(pairs))
    )
    return (
        shown.withColumn("n_words", F.size("w").cast("long"))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("n_distinct", F.size(F.array_distinct("w")).cast("long"))
        .withColumn("n_repeat_words", F.expr(count))
        .select(*kept, *_STATS)
    )


#: The digit of a pattern that is set where the base rules fail.
FAILED = 3 ** len(RULES)


def with_votes(stats: DataFrame) -> DataFrame:
    """stats with base_failed and pattern: the rules' votes as one integer to base 3, plus FAILED where the base rules fail. The pattern is never null."""
    votes = [F.expr(f"case when {bad} then 0 when {good} then 2 else 1 end") for bad, good in RULES.values()]
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    pattern = sum((v * 3**i for i, v in enumerate(votes)), F.when(failed, FAILED).otherwise(0)).cast("int")
    return stats.withColumn("base_failed", failed).withColumn("pattern", pattern)


def votes_of(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 - 1 for i in range(len(RULES))]


#: For each class (junk, clean) and rule: probabilities of the votes junk, none and clean.
Accuracies = list[list[list[float]]]


def fit_accuracies(counts: dict[int, int], rounds: int = 60) -> tuple[float, Accuracies]:
    """(share of clean texts, how each rule votes on either class) by EM over counts of vote patterns, those that fail the base rules left out.

    A rule's junk votes and clean votes have accuracies of their own: a rule
    that knows one kind of junk is right when it says so, and says little else.
    EM starts from the belief that a junk vote means junk.
    """
    patterns = [(votes_of(p), n) for p, n in sorted(counts.items()) if p < FAILED]
    clean = [0.98 if min(v) >= 0 else 0.3 if v.count(-1) == 1 else 0.05 for v, _ in patterns]
    share, accuracy = 0.9, [[[0.3, 0.3, 0.4]] * len(RULES), [[0.02, 0.28, 0.7]] * len(RULES)]
    for _ in range(rounds if patterns else 0):
        weights = [[n * (1 - c), n * c] for (_, n), c in zip(patterns, clean, strict=True)]
        total = [sum(w[k] for w in weights) for k in (0, 1)]
        share = min(0.99, max(0.01, (total[1] + 9) / (sum(total) + 10)))
        accuracy = []
        for k, prior in ((0, (0.6, 0.6, 0.8)), (1, (0.04, 0.56, 1.4))):
            table = [list(prior) for _ in RULES]
            for (votes, _), w in zip(patterns, weights, strict=True):
                for row, v in zip(table, votes, strict=True):
                    row[v + 1] += w[k]
            accuracy.append([[x / (total[k] + 2) for x in row] for row in table])
        clean = [_clean(v, share, accuracy) for v, _ in patterns]
    return share, accuracy


def _clean(votes: list[int], share: float, accuracy: Accuracies) -> float:
    odds = math.log(share / (1 - share))
    for i, v in enumerate(votes):
        odds += math.log(accuracy[1][i][v + 1] / accuracy[0][i][v + 1])
    return 1 / (1 + math.exp(-min(700.0, max(-700.0, odds))))


def posterior(pattern: int, share: float, accuracy: Accuracies) -> float:
    """Probability that a text with these votes is clean."""
    return _clean(votes_of(pattern % FAILED), share, accuracy)


def quality_model(voted: DataFrame) -> DataFrame:
    """(pattern, probability, kept), at most 2 * 3 ** len(RULES) rows, fitted on the vote patterns of all rows of voted."""
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}
    share, accuracy = fit_accuracies(counts)
    rows = [(p, q := posterior(p, share, accuracy), p < FAILED and q >= 0.5) for p in sorted(counts)]
    return voted.sparkSession.createDataFrame(rows, "pattern int, probability double, kept boolean")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability.

    Null and empty texts have no words and fail the base rules. Repeated rows
    and repeated or null ids are judged row by row. Other columns are not read,
    so their names can't clash. No rows give no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    voted = durable(with_votes(text_statistics(named)).drop("text"), "quality-votes")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    return voted.join(F.broadcast(quality_model(voted)), "pattern").select(*columns)  # a table of 2 * 3 ** 8 rows at most


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns kept. Rows are written once with their pattern of votes; no text is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    voted = durable(with_votes(text_statistics(docs.select(row, F.col(text_col).alias("text")))).select("row", "pattern"), "quality-rows")
    return voted.join(F.broadcast(quality_model(voted).filter("kept")), "pattern", "left_semi").select("row.*")
