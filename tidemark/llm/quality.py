"""Quality rules: a table of thresholds compiled into one projection of native functions.

Each rule names a metric, the least and greatest value allowed, and how a document that breaks it is labelled. All
metrics are expressions over the text alone, so a scan, one projection and a filter do the whole job without a shuffle.

Defined cases: a null text has no words. Every metric of a text without words or lines is 0 (ratios divide by at least
1). Such a text fails ``few_words``. Columns other than the text pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CHARS, SPACE_RX, free_name, let, text_or_empty

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were "
    "le la les de des du et un une en que qui dans est pour sur au aux par pas plus ne se ce avec "
    "der die das und ist von zu den mit dem des ein eine einer nicht auf sich als auch im "
    "el los las del y que se por con para una su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    least: float = float("-inf")
    most: float = float("inf")
    #: The rule holds for texts of at least so many words.
    from_words: int = 0


#: The threshold table. Ratios are shares of words, characters or lines.
RULES = (
    Rule("few_words", "n_words", least=10),
    Rule("word_length", "mean_word_chars", least=2, most=15),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("shouting", "upper_ratio", most=0.5),
    Rule("exclamation", "exclaim_ratio", most=0.2),
    Rule("no_letters", "letter_ratio", least=0.3),
    Rule("stop_words", "stop_ratio", least=0.02, from_words=30),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("bullets", "bullet_ratio", most=0.9),
    Rule("ellipses", "ellipsis_ratio", most=0.5),
    Rule("repeated_windows", "repeat_word_ratio", most=0.2),
)


def words_of(text: Column) -> Column:
    trimmed = F.call_function("btrim", text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RX, -1))


def repeat_words(words: Column, k: int = 5) -> Column:
    """Number of words inside k-word windows found twice or more in the text, first occurrences included.

    Windows are compared by 64-bit hashes. Only a text that has a repeat sorts its windows by (hash, place); the places
    of those with an equal neighbour, in order, each cover k words less what the next one covers again.
    """

    def marked(codes: Column) -> Column:
        by_code = F.sort_array(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))
        return let(by_code, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["c"] == x["c"]) | (F.get(s, i + 1)["c"] == x["c"]), x["i"])), lambda x: x.isNotNull())))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(places, i + 1) - p, F.lit(k)))), F.lit(0), lambda a, x: a + x)

    def of_codes(codes: Column) -> Column:
        return F.when(F.size(F.array_distinct(codes)) == F.size(codes), F.lit(0)).otherwise(let(marked(codes), covered))

    def joined(left: Column, right: Column, by: int) -> Column:
        return F.zip_with(left, F.slice(right, by + 1, F.size(right)), lambda a, b: F.xxhash64(a, b))

    def of_hashes(hashes: Column, have: int = 1, codes: Column | None = None) -> Column:
        """codes: hashes of the ``have`` words from each place on; they double, then grow by one word."""
        codes = hashes if codes is None else codes
        if have == k:
            return let(F.slice(codes, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0))), of_codes)
        double = 2 * have <= k
        longer = joined(codes, codes if double else hashes, have)
        return let(longer, lambda c: of_hashes(hashes, 2 * have if double else have + 1, c))

    return F.when(F.size(words) < k, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: of_hashes(h))).cast("long")


def metrics(text: Column) -> dict[str, Column]:
    """Counts of one text; ``words`` and ``lines`` arrays come along for the second step."""
    return {"words": words_of(text), "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))}


def measure(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one struct column of all metrics added, and that column's name."""
    name = free_name(docs, "quality__")
    text = text_or_empty(text_col)

    def removed(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        at_least_one = F.greatest(n, F.lit(1))
        return F.struct(
            n.alias("n_words"), at_least_one.alias("least_one"), repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, _is_stop)).alias("n_stop"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*(?:[-*•]|\d+\.)[\x20\x09-\x0D]"))).alias("n_bullets"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"))).alias("n_ellipses"),
        )

    parts = metrics(text)
    counts = F.struct(
        let(parts["words"], of).alias("w"),
        let(parts["lines"], of_lines).alias("l"),
        removed(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        removed(r"[^!]+").alias("n_exclaim"),
        removed(r"[\p{L}\x20\x09-\x0D]+").alias("n_other"),
        removed(r"\P{Lu}+").alias("n_upper"),
    )
    return docs.withColumn(name, counts), name


def _is_stop(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one struct column added: every metric, ``broken`` (names of broken rules) and ``passed``."""
    measured, name = measure(docs, text_col)
    m = F.col(name)
    words, lines = m["w"]["least_one"], F.greatest(m["l"]["n_lines"], F.lit(1))
    letters = m["w"]["word_chars"] - m["n_other"]
    metric = {
        "n_words": m["w"]["n_words"],
        "word_chars": m["w"]["word_chars"],
        "n_symbols": m["n_symbols"],
        "n_dup_lines": m["l"]["n_dup_lines"],
        "n_repeat_words": m["w"]["n_repeat_words"],
        "mean_word_chars": m["w"]["word_chars"] / words,
        "symbol_ratio": m["n_symbols"] / words,
        "exclaim_ratio": m["n_exclaim"] / words,
        "letter_ratio": letters / F.greatest(m["w"]["word_chars"], F.lit(1)),
        "upper_ratio": m["n_upper"] / F.greatest(letters, F.lit(1)),
        "stop_ratio": m["w"]["n_stop"] / words,
        "dup_line_ratio": m["l"]["n_dup_lines"] / lines,
        "bullet_ratio": m["l"]["n_bullets"] / lines,
        "ellipsis_ratio": m["l"]["n_ellipses"] / lines,
        "repeat_word_ratio": m["w"]["n_repeat_words"] / words,
    }
    broken = F.array_compact(F.array(*[F.when((metric["n_words"] >= r.from_words) & ((metric[r.metric] < r.least) | (metric[r.metric] > r.most)), F.lit(r.name)) for r in rules]))
    final = F.struct(*[c.alias(k) for k, c in metric.items()], broken.alias("broken"), (F.size(broken) == 0).alias("passed"))
    return measured.withColumn(name, final), name


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that break no rule.

    The row number beside the verdict keeps the filter above the projection; pushed below it, every rule would work
    out all metrics anew.
    """
    judged, name = verdicts(docs, rules, text_col)
    row = free_name(judged, "row__")
    kept = judged.withColumn(row, F.monotonically_increasing_id()).filter(F.col(name)["passed"] & (F.col(row) >= 0))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
