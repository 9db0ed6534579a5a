"""Quality rules: a threshold table compiled into one Spark projection.

``score`` measures every text once with built-in expressions (no user functions, no shuffle)
and compares the ratios of the table below with their limits. Null or empty texts have no
words and fail ``base``; a null id is passed through; repeated rows are judged one by one;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import SPACE, let

SYMBOLS = "#*$%&|<>"
GRAM = 5
#: Texts of fewer words say too little about stop words; that ratio is null for them.
SHORT = 50
#: Frequent function words of the four languages of the tables.
STOP_WORDS = {
    "en": "the of and to in that is was for it with as be on by at this from are or an have not which one",
    "fr": "le la les de des du et un une dans que qui pour par sur est pas au avec ce il elle plus ne se en",
    "de": "der die das und von zu mit den dem des ein eine ist nicht auf für als auch sich es an bei werden im",
    "es": "el la los las de que y en un una por con para se del al lo como más su es no o sus",
}


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high`` (a null metric passes)."""

    metric: str
    low: float | None = None
    high: float | None = None

    def passed(self, metric: Column) -> Column:
        checks = [metric >= self.low] if self.low is not None else []
        checks += [metric <= self.high] if self.high is not None else []
        both = checks[0] & checks[1] if len(checks) == 2 else checks[0]
        return F.coalesce(both, F.lit(True))


#: The production table; each metric is a key of ``metrics``.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=1.5, high=20.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.5),
)


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0))


def metrics() -> dict[str, Column]:
    """Ratios that a rule may name, over the counted columns."""
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "stop_word_ratio": F.when(F.col("n_words") >= SHORT, _ratio("n_stop_words", "n_words")),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
    }


def _repeat_words(words: Column) -> Column:
    """Words inside a five-word window that occurs at least twice in the text."""

    def covered(at: Column) -> Column:
        """Words under windows at these sorted places: each window adds what the next doesn't cover."""
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(GRAM), F.coalesce(b - a, F.lit(GRAM))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(grams: Column) -> Column:
        """Sorts (hash, place); a place repeats if a neighbour has its hash."""
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def near(x: Column, j: Column, by: int) -> Column:
                return F.coalesce(F.get(s, j + by)["h"] == x["h"], F.lit(False))

            same = F.filter(s, lambda x, j: near(x, j, -1) | near(x, j, 1))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

        return let(placed, places)

    def of_grams(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(repeated(grams))

    def of_hashes(h: Column) -> Column:
        grams = F.transform(F.slice(h, 1, F.size(h) - (GRAM - 1)), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)]))
        return let(grams, of_grams)

    return F.when(F.size(words) < GRAM, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def counted(text: Column) -> Column:
    """One struct of all counts of a text."""
    stop = sorted({form for line in STOP_WORDS.values() for w in line.split() for form in (w, w[:1].upper() + w[1:])})
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: x.isin(*stop))).cast("long").alias("n_stop_words"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    return F.struct(
        of_words.alias("w"), of_lines.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, ``base_failed``, ``failed`` (names of the rules that failed) and ``kept`` per row.

    ``keep`` names input columns to carry along under their own names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # generate=inline over a one-element array keeps the counts in one evaluation per row
    measured = df.select(F.col(id_col).alias(id_col), *[F.col(c) for c in keep if c != id_col], F.explode(F.array(counted(text))).alias("_m"))
    flat = measured.select(
        id_col, *[c for c in keep if c != id_col],
        F.col("_m.w.n_words").alias("n_words"), F.col("_m.word_chars").alias("word_chars"), F.col("_m.n_symbols").alias("n_symbols"),
        F.col("_m.l.n_dup_lines").alias("n_dup_lines"), F.col("_m.w.n_repeat_words").alias("n_repeat_words"),
        F.col("_m.l.n_lines").alias("n_lines"), F.col("_m.w.n_stop_words").alias("n_stop_words"),
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = metrics()
    failed = F.filter(F.array(*[F.when(~r.passed(known[r.metric]), F.lit(r.metric)) for r in rules]), lambda x: x.isNotNull())
    return flat.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
