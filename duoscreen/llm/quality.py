"""Quality rules: a threshold table compiled into one projection, without user functions.

Each row of the table bounds a percentage of two measures of a text (length, symbols, stop words, lines). ``measures``
takes them all from one split of the text into words and one into lines; ``compiled`` turns the table into columns
beside them, so a document is read once and never shuffled. Percentages are compared as products of whole numbers.

Repeated windows of words are found within the row: the hashes of its windows are sorted with their places in their
low bits, so that equal windows stand side by side. Should neighbours of equal hash hold different words, the words
themselves are sorted instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols, and ASCII blanks.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Frequent function words of the languages that the rules serve.
STOP_WORDS = (
    "the of and to in is that for it was with as on are this be by at from or an not "
    "de la que el en y los se del las un por con no una su para es al lo "
    "le les et des du une pour est dans pas qui sur au par plus ne ce il sont avec "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "di che il per non sono da della o os uma em não do com na het een van dat op te zijn"
).split()

#: Words of a window whose repeats count.
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low`` * of <= 100 * measure <= ``high`` * of; ``of`` None stands for 100 (plain bounds)."""

    name: str
    measure: str
    of: str | None = None
    low: int | None = None
    high: int | None = None


#: These two also decide ``base_failed``.
BASE = [
    Rule("few_words", "n_words", low=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=50),
]
#: Limits in per cent; mean word length in hundredths of a character.
RULES = [
    *BASE,
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(places: Column) -> Column:
    """Words in the windows at the given sorted places."""
    steps = F.transform(places, lambda x, j: F.least(F.coalesce(F.get(places, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _by_words(words: Column) -> Column:
    """Sorted places of the windows found twice or more, by a sort of the windows' words."""
    window = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.struct(F.array_join(F.array(*[F.get(words, i + k) for k in range(WINDOW)]), " ").alias("w"), i.cast("long").alias("i")),
    )

    def repeated(s: Column) -> Column:
        same = lambda j: F.coalesce(F.get(s, j)["w"] == F.get(s, j + 1)["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(j - 1) | same(j)), lambda x: x["i"]))

    return _let(F.sort_array(window), repeated)


def _repeat_words(words: Column) -> Column:
    """Words in windows found twice or more in the array."""
    size = F.size(words)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(size.cast("long"))).cast("int")) - 1

    def of(mask: Column) -> Column:
        keys = F.transform(
            F.sequence(F.lit(0), size - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")),
        )

        def same(k: Column, j: Column) -> Column:
            # equal but for the place; beyond either end there is nothing to equal
            return F.coalesce(F.get(k, j).bitwiseXOR(F.get(k, j + 1)) <= mask, F.lit(False)) & F.coalesce(F.get(k, j).bitwiseXOR(F.get(k, j + 1)) >= 0, F.lit(False))

        def repeated(k: Column) -> Column:
            return F.filter(k, lambda x, j: same(k, j - 1) | same(k, j))

        def differ(r: Column) -> Column:
            def unlike(x: Column, j: Column) -> Column:
                a, b = x.bitwiseAND(mask).cast("int"), F.coalesce(F.get(r, j + 1), x).bitwiseAND(mask).cast("int")
                return same(r, j) & ~F.reduce(F.sequence(F.lit(0), F.lit(WINDOW - 1)), F.lit(True), lambda s, i: s & (F.get(words, a + i) == F.get(words, b + i)))

            return F.size(F.filter(r, unlike)) > 0

        def count(r: Column) -> Column:
            places = F.sort_array(F.transform(r, lambda x: x.bitwiseAND(mask)))
            return F.when(F.size(r) == 0, F.lit(0).cast("long")).when(differ(r), _let(_by_words(words), _covered)).otherwise(_let(places, _covered))

        return _let(_let(F.sort_array(keys), repeated), count)

    return F.when(size <= WINDOW, F.lit(0).cast("long")).otherwise(_let(mask, of))


def measures(text: Column) -> Column:
    """A struct of all measures of a text; a null text has none of anything.

    Words stand between ASCII blanks; lines are what \\n parts, those with a word; a bullet line begins with -, * or a
    bullet after blanks.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_lines(lines: Column) -> Column:
        bullets = F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(bullets).cast("long").alias("n_bullet_lines"),
        )

    def of_words(words: Column) -> Column:
        stops = F.filter(words, lambda x: F.lower(x).isin(STOP_WORDS))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(stops).cast("long").alias("n_stop_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    chars, solid = F.length(text), F.length(F.translate(text, BLANKS, ""))
    both = F.struct(
        _let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        solid.cast("long").alias("word_chars"),
        (chars - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return _let(both, lambda b: F.struct(*[(b["w"][m] if m in ("n_words", "n_repeat_words", "n_stop_words") else b["l"][m] if m.endswith("_lines") else b[m]).alias(m) for m in MEASURES]))


def fails(rule: Rule) -> Column:
    """Whether the measures beside it break a rule; a rule over an empty whole is kept."""
    value, whole = (F.col(rule.measure), F.lit(1)) if rule.of is None else (100 * F.col(rule.measure), F.col(rule.of))
    low = F.lit(False) if rule.low is None else value < rule.low * whole
    high = F.lit(False) if rule.high is None else value > rule.high * whole
    return low | high


def judge(docs: DataFrame, rules: list[Rule] = RULES, base: list[Rule] = BASE) -> DataFrame:
    """doc_id, all measures, base_failed, failed (names of all broken rules, in table order) and kept of every row.

    docs: doc_id, text. A null text has no words. Null ids stay null, repeated rows give a row each, an empty table gives an
    empty result; other columns are ignored. ``kept`` is false where a rule of ``base`` or of ``rules`` is broken.
    """
    measured = docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*")
    failed = F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | fails(rule)
    judged = measured.withColumns({"base_failed": base_failed, "failed": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
