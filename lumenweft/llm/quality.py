"""Quality rules as a short-circuit cascade.

Each rule is a rejecting condition. Its cost and selectivity (rejected share) are estimated on a bounded sample; rules then
stand in order of rejection per cost in one CASE expression, which stops at the first that applies. The order never changes
a verdict, only what has to be computed for it. Cost is work counted on the sample's texts, not time: the characters and
words that a rule goes through, each by what a step of its kind takes. So the same table always gives the same order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweft.llm.native import let, repeated_words, words

#: Rows, from how many files, and characters of each, on which costs and selectivities are estimated; nothing else depends
#: on them. The rows of a file are those of the least hashes of its own.
SAMPLE_ROWS, SAMPLE_FILES, SAMPLE_CHARACTERS = 400, 8, 20_000
#: Work of a step: a character that is scanned, one that a pattern is held against, a word that a lambda is applied to.
SCAN, PATTERN, APPLY = 1, 4, 12

#: Over a text and its words.
Expression = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    """A rejecting condition, and the work that it is."""

    rejects: Expression
    work: Expression


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeats(seen: Column, sought: Column) -> Column:
    """Over a fifth of the words stand in five-word windows found twice or more."""
    return 100 * repeated_words(sought) > 20 * F.size(sought)


def stutters(seen: Column, sought: Column) -> Column:
    same = F.zip_with(sought, F.slice(sought, 2, F.greatest(F.size(sought) - 1, F.lit(0))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return 100 * F.size(F.filter(same, lambda x: x)) > 40 * F.size(sought)


#: Thresholds leave ordinary prose far below.
RULES: dict[str, Rule] = {
    "short": Rule(lambda t, w: F.size(w) < 10, lambda t, w: F.lit(0)),
    "symbols": Rule(lambda t, w: 100 * count_of(t, r"[#*$%&|<>]") > 30 * F.size(w), lambda t, w: PATTERN * F.length(t)),
    "exclamations": Rule(lambda t, w: 100 * count_of(t, "!!") > 30 * F.size(w), lambda t, w: PATTERN * F.length(t)),
    "capitals": Rule(lambda t, w: 100 * count_of(t, r"\p{Lu}") > 60 * F.length(F.array_join(w, "")), lambda t, w: (PATTERN + 2 * SCAN) * F.length(t)),
    "stutter": Rule(stutters, lambda t, w: 2 * APPLY * F.size(w)),
    "lines": Rule(lambda t, w: let(lines_of(t), lambda x: (F.size(x) >= 4) & (2 * F.size(F.array_distinct(x)) < F.size(x))), lambda t, w: (PATTERN + SCAN) * F.length(t) + 2 * APPLY * count_of(t, "\n")),
}
#: As a filter the base condition is one of the rules.
FILTER_RULES = RULES | {"repeats": Rule(repeats, lambda t, w: 8 * APPLY * F.size(w))}


def sample_of(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Texts of up to SAMPLE_FILES files spread evenly over a table of files, the same number of each, those of the least
    hashes of their rows (doc_id and text); of a table that is no files', of all its rows. Only the files chosen are opened."""
    text = clean(F.col("text"))
    drawn = docs.select(F.substring(text, 1, SAMPLE_CHARACTERS).alias("text"), F.xxhash64(*([F.col("doc_id")] if "doc_id" in docs.columns else []), text).alias("h"), *([F.col("_metadata.file_name").alias("f")] if _has_files(docs) else []))
    files = sorted({unquote(f.rsplit("/", 1)[-1]) for f in docs.inputFiles()}) if "f" in drawn.columns else []
    chosen = [files[k * len(files) // SAMPLE_FILES] for k in range(SAMPLE_FILES)] if len(files) > SAMPLE_FILES else files
    parts = [drawn.where(F.col("f") == f) for f in chosen] if len(chosen) > 1 else [drawn]
    first = [r.text for part in parts for r in part.orderBy("h", "text").limit(-(-sample_rows // len(parts))).select("text").collect()]
    return first or [r.text for r in drawn.orderBy("h", "text").limit(sample_rows).select("text").collect()]


def _has_files(docs: DataFrame) -> bool:
    """Whether rows know the file they come from: not if the table has a column of that name, or is more than its files' rows."""
    if "_metadata" in docs.columns:
        return False
    try:
        return bool(docs.select("_metadata.file_name").columns)
    except AnalysisException:
        return False


def cascade_order(docs: DataFrame, rules: dict[str, Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, work a character, rejected share) on a sample of ``docs`` (text), by rejection per work, best first.

    Rules that reject nothing come last, those of less work first; equals by name. An empty table is a sample of no rows: all
    shares are 0 then.
    """
    texts = sample_of(docs, sample_rows)
    sample = docs.sparkSession.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select("text", words(F.col("text")).alias("words"))
    t, w = F.col("text"), F.col("words")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for r in rules.values() for c in (F.coalesce(r.rejects(t, w), F.lit(False)).cast("long"), r.work(t, w).cast("long"))]
    found = sample.agg(*(c.alias(f"c{k}") for k, c in enumerate(sums))).first()
    size = max(1, sum(map(len, texts)))
    seen = [(name, (1 + found[2 * k + 1]) / size, found[2 * k] / max(1, len(texts))) for k, name in enumerate(rules)]
    return sorted(seen, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def clean(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def cascade(order: list[str], rules: dict[str, Rule], text: Column, sought: Column) -> Column:
    """The first rule in ``order`` that rejects a text, else null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(rules[name].rejects(text, sought), F.lit(name)).otherwise(out)
    return out


def keep_good(docs: DataFrame, rules: dict[str, Rule] = FILTER_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` (text; all columns stay as they are) that no rule rejects.

    Null and empty texts are short, and go. The sample only sets the order of the rules. Repeated rows are judged each, and
    null in any other column changes nothing, nor do columns of any other name. An empty table stays empty. A text of any
    length is judged whole, in one task; its words stand in memory there.
    """
    order = [name for name, _, _ in cascade_order(docs, rules, sample_rows)]
    text = clean(F.col("text"))
    return docs.where(let(text, lambda t: let(words(t), lambda w: cascade(order, rules, t, w).isNull())))


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept per row.

    Null texts count as empty: all counts 0, base_failed. Repeated rows are judged each on its own. Other columns, clashing
    names among them, are ignored; an empty table gives no rows. A text of any length is judged whole, in one task.
    """
    order = [name for name, _, _ in cascade_order(docs, RULES)]

    def measured(t: Column, w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            count_of(t, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
            let(lines_of(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            cascade(order, RULES, t, w).isNotNull().alias("rejected"),
        )

    out = docs.select("doc_id", let(clean(F.col("text")), lambda t: let(words(t), lambda w: measured(t, w))).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("rejected")).alias("kept"))
