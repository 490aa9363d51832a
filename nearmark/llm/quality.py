"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes for good (1), for bad (-1) or abstains (0). Expectation-maximisation over the distinct vote
patterns (at most 3 ** rules rows, whatever the number of documents) estimates how accurate each rule is, as the
chances of its votes on good and on bad documents, and the share of good documents; a document is kept if its
posterior probability of being good reaches a threshold.

Defined results: a null text counts as empty; empty and short texts fail the hard limit and are not kept; an empty
table gives an empty table; equal rows get equal results; all columns of the input are kept, and a column of the
input that has the name of a result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [*COUNTS, "n_lines", "n_upper"]

# Position-ordered hash of each three-word window, sorted so that equal windows are neighbours. The `transform(array(x),
# name -> ...)[0]` form evaluates x once and gives it a name. A hash stands for its window inside one text only.
_REPEATED = """
CASE WHEN size(w) < 4 THEN 0L ELSE
  transform(array(transform(w, x -> xxhash64(x))), h ->
  transform(array(sort_array(transform(sequence(0, size(h) - 3),
      i -> named_struct('g', xxhash64(get(h, i), get(h, i + 1), get(h, i + 2)), 'p', i)))), s ->
  transform(array(sort_array(transform(filter(s,
      (x, i) -> x.g <=> get(s, i - 1).g OR x.g <=> get(s, i + 1).g), x -> x.p))), p ->
    aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> coalesce(least(3, b - a), 3)), 0L, (sum, x) -> sum + x)
  )[0])[0])[0] END
"""


@dataclass(frozen=True)
class Settings:
    """Hard limits, the limits at which rules vote, and what the estimate starts from."""

    min_words: int = 50
    max_repeat_percent: int = 50
    threshold: float = 0.5
    iterations: int = 25
    prior_good: float = 0.9
    # Chances of the votes -1, 0 and 1 on good and on bad documents, counted like so many documents seen before:
    # a rule looks for one defect, so it often passes a bad document that has another one.
    on_good: tuple[float, float, float] = (0.002, 0.048, 0.95)
    on_bad: tuple[float, float, float] = (0.3, 0.1, 0.6)
    prior_weight: float = 50.0
    # No rule is believed to blame more than this share of the good documents; without it, a defect that only one
    # rule sees would be taken for that rule's error.
    max_false_alarm: float = 0.002


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts the rules read."""
    body = _text(text)

    def without(characters: str) -> Column:
        return F.char_length(F.translate(body, characters, ""))

    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.trim(F.translate(line, "\t\x0b\f\r", ""))) > 0)
    # Each generator is evaluated once per row; fields read from a plain expression would each evaluate it again.
    counted = docs.drop(*FEATURES).select("*", F.explode(F.transform(F.array(lines), lambda held: F.struct(
        F.size(held).cast("long").alias("n"),
        (F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("dup")))).alias("_lines")).select(
        "*", F.explode(F.expr(f"""transform(array(array_remove(split(coalesce(cast({_quoted(text)} AS STRING), ''),
            '[\\\\x20\\\\x09-\\\\x0D]+'), '')),
            w -> named_struct('n', cast(size(w) AS BIGINT), 'repeated', {_REPEATED}))""")).alias("_words"))
    counts = F.struct(
        F.col("_words.n").alias("n_words"), without(" \t\n\x0b\f\r").cast("long").alias("word_chars"),
        (F.char_length(body) - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        F.col("_lines.dup").alias("n_dup_lines"), F.col("_words.repeated").alias("n_repeat_words"),
        F.col("_lines.n").alias("n_lines"),
        (F.char_length(body) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"))
    return counted.select("*", F.explode(F.array(counts)).alias("_counts")).select(
        "*", *[F.col(f"_counts.{c}").alias(c) for c in FEATURES]).drop("_lines", "_words", "_counts")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """One vote per rule, over the feature columns."""
    n, lines, chars = F.col("n_words"), F.col("n_lines"), F.col("word_chars")
    return {
        "length": _vote(n < 20, n >= 80),
        "symbols": _vote(F.col("n_symbols") * 10 > n * 3, F.col("n_symbols") * 100 < n * 5),
        "word_length": _vote((chars < 2 * n) | (chars > 15 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        "repetition": _vote(F.col("n_repeat_words") * 100 > n * 40, F.col("n_repeat_words") * 100 <= n * 30),
        "lines": _vote(F.col("n_dup_lines") * 100 > lines * 60, F.col("n_dup_lines") * 100 <= lines * 40),
        "capitals": _vote(F.col("n_upper") * 100 > chars * 40, F.col("n_upper") * 100 < chars * 15),
    }


def base_failed(settings: Settings = Settings()) -> Column:
    n = F.col("n_words")
    return (n < settings.min_words) | (F.col("n_repeat_words") * 100 > n * settings.max_repeat_percent)


def _posterior(votes: str, theta: str, m: int) -> str:
    """Probability of good given votes.

    theta holds the share of good documents, then for each rule the chances of its votes -1, 0 and 1 on a good document
    and on a bad one.
    """
    score = (f"aggregate(sequence(0, {m - 1}), ln(get({theta}, 0) / (1 - get({theta}, 0))), (sum, j) -> sum + "
             f"ln(get({theta}, 6 * j + 2 + get({votes}, j)) / get({theta}, 6 * j + 5 + get({votes}, j))))")
    return f"1 / (1 + exp(-({score})))"


def estimate(voted: DataFrame, names: list[str], settings: Settings = Settings()) -> DataFrame:
    """``votes, posterior`` for each vote pattern that occurs, from a table with a ``votes`` column.

    The counts are combined before the shuffle, and what meets in one row is bounded by the number of patterns.
    """
    m, w = len(names), settings.prior_weight

    def total(weight: str, j: int | None = None, vote: int = 0) -> str:
        case = "" if j is None else f" * int(get(p.votes, {j}) = {vote})"
        return f"aggregate(e, 0D, (s, p) -> s + p.n * {weight}{case})"

    def chance_of(weight: str, j: int, vote: int, chance: float) -> str:
        found = f"({chance * w}D + {total(weight, j, vote)}) / ({w}D + {total(weight)})"
        return f"least({settings.max_false_alarm}D, {found})" if (weight, vote) == ("p.q", -1) else found

    chances = [
        chance_of(weight, j, vote, chance)
        for j in range(m) for weight, prior in (("p.q", settings.on_good), ("(1 - p.q)", settings.on_bad))
        for vote, chance in zip((-1, 0, 1), prior, strict=True)
    ]
    share = f"({settings.prior_good * w}D + {total('p.q')}) / ({w}D + {total('1')})"
    step = f"""transform(array(transform(patterns, p -> named_struct('votes', p.votes, 'n', p.n,
        'q', {_posterior('p.votes', 'theta', m)}))), e -> array({share}, {', '.join(chances)}))[0]"""
    start = ", ".join(f"{x}D" for x in [settings.prior_good, *[*settings.on_good, *settings.on_bad] * m])
    counted = voted.groupBy("votes").agg(F.count("*").alias("n"))
    one = counted.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    fitted = one.select("patterns", F.expr(
        f"aggregate(sequence(1, {settings.iterations}), array({start}), (theta, round) -> {step})").alias("theta"))
    return fitted.select(F.explode("patterns").alias("p"), "theta").select(
        F.col("p.votes").alias("votes"), F.expr(_posterior("p.votes", "theta", m)).alias("posterior"))


def score(featured: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``votes`` (in the order of ``rules()``), ``posterior``, ``base_failed`` and ``kept``.

    The input is read twice, once to estimate and once to judge; give a written table where its features are costly.
    """
    votes = rules()
    voted = featured.drop("votes", "posterior", "base_failed", "kept").withColumn(
        "votes", F.array(*votes.values()))
    patterns = F.broadcast(estimate(voted.select("votes"), list(votes), settings))  # at most 3 ** rules rows
    failed = base_failed(settings)
    return voted.join(patterns, "votes", "left").withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("posterior") >= settings.threshold))


def filter_documents(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows whose documents are kept, with the columns they came with."""
    columns = [F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)]
    held = docs.toDF(*[f"_in_{i}" for i in range(len(docs.columns))])
    scored = score(with_features(held, f"_in_{docs.columns.index(text)}"), settings)
    return scored.where("kept").select(*columns)
