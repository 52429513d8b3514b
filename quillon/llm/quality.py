"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

The projection is written in two steps, so that words and lines are split once
and not again for every ratio; Spark runs both in one pass over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = "the|of|and|to|in|that|is|was|for|with|on|der|die|und|den|von|zu|das|mit|sich|des|im|ist|le|la|les|et|des|en|un|une|du|que|est|pour|el|los|las|de|y|del|se|por|con|para".split("|")
SYMBOLS = "#$%&*|!~^<>{}[]=\\_@+"


@dataclass(frozen=True)
class Rule:
    """A document of at least ``words`` words fails where its metric is under ``least`` or over ``most``."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    words: int = 0


#: The production table. In few words a share of stop words or of kinds of lines tells nothing, while symbols do.
RULES = (
    Rule("few_words", "n_words", least=1),
    Rule("many_words", "n_words", most=1_000_000),
    Rule("long_words", "mean_word_length", most=14, words=5),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("capitals", "capital_ratio", most=0.5, words=3),
    Rule("stop_words", "stop_word_ratio", least=0.02, words=30),
    Rule("repeated_words", "distinct_word_ratio", least=0.2, words=10),
    Rule("bullets", "bullet_line_ratio", most=0.9, words=30),
    Rule("ellipses", "ellipsis_line_ratio", most=0.3, words=30),
    Rule("repeated_lines", "distinct_line_ratio", least=0.3, words=10),
)


def split_text(docs: DataFrame) -> DataFrame:
    """(doc_id, q_text, q_joined, q_words, q_lower, q_letters, q_lines) of docs: what the metrics are made of."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"\s+", -1), "")
    own = docs.select("doc_id", text.alias("q_text"), words.alias("q_words"))
    own = own.select("doc_id", "q_text", "q_words", F.array_join("q_words", " ").alias("q_joined"))
    own = own.select("*", F.lower("q_joined").alias("q_low"), F.array_remove(F.split("q_text", "\n", -1), "").alias("q_lines"))
    return own.select("doc_id", "q_text", "q_joined", "q_lines", F.size("q_words").alias("n_words"), F.split("q_low", " ", -1).alias("q_lower"), F.split("q_low", r"[^\p{L}]+", -1).alias("q_letters"))


def metrics() -> dict[str, Column]:
    """The metrics of a text, over the columns of :func:`split_text`; ratios of an empty text are 0."""
    n_words, lines, lower, text = F.col("n_words"), F.col("q_lines"), F.col("q_lower"), F.col("q_text")
    ink = F.length("q_joined") - n_words + 1
    symbols = "[" + "".join(f"\\{c}" for c in SYMBOLS) + "]"

    def share(part: Column, whole: Column, some: Column) -> Column:
        return F.when(some > 0, part.cast("double") / whole).otherwise(F.lit(0.0))

    return {
        "n_words": n_words,
        "mean_word_length": share(ink, n_words, n_words),
        "symbol_ratio": share(F.regexp_count("q_joined", F.lit(symbols)), ink, n_words),
        "capital_ratio": share(F.regexp_count("q_joined", F.lit(r"\p{Lu}")), ink, n_words),
        "stop_word_ratio": share(F.size(F.filter("q_letters", lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))), n_words, n_words),
        "distinct_word_ratio": share(F.size(F.array_distinct(lower)), n_words, n_words),
        "bullet_line_ratio": share(F.size(F.filter(lines, lambda s: s.rlike(r"^\s*[-*•]"))), F.size(lines), F.size(lines)),
        "ellipsis_line_ratio": share(F.size(F.filter(lines, lambda s: s.rlike(r"(\.\.\.|…)\s*$"))), F.size(lines), F.size(lines)),
        "distinct_line_ratio": share(F.size(F.array_distinct(lines)), F.size(lines), F.size(lines)),
    }


def verdict(values: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of the names of the rules that fail."""
    names = []
    for r in rules:
        value = values[r.metric]
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (value < r.least)
        if r.most is not None:
            bad = bad | (value > r.most)
        if r.words:
            bad = bad & (values["n_words"] >= r.words)
        names.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*names))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All documents with their metrics, the rules they fail, and whether they are kept.

    Returns doc_id, a column for each metric (ratios rounded to 6 places), failed
    (names in the table's order) and keep. Everything is projections over doc_id
    and text in one stage, without shuffle or Python. A null text is an empty
    text, and as blank ones it has no words, ratios of 0, and fails few_words.
    Texts of any length are measured whole. Each row is judged by itself, so
    repeated rows and ties need no rule; a null doc_id is kept; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    values = {name: value if name == "n_words" else F.round(value, 6) for name, value in metrics().items()}
    measured = split_text(docs.select("doc_id", "text")).select("doc_id", *[v.alias(k) for k, v in values.items()])
    failed = verdict({k: F.col(k) for k in values}, rules)
    return measured.withColumn("failed", failed).withColumn("keep", F.size("failed") == 0)


def _case(r: Rule) -> str:
    bad = " OR ".join(x for x in (f"{r.metric} < {r.least}" if r.least is not None else "", f"{r.metric} > {r.most}" if r.most is not None else "") if x)
    return f"CASE WHEN ({bad}) AND n_words >= {r.words} THEN '{r.name}' END"


def _sql() -> str:
    names = ", ".join(_case(r) for r in RULES)
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    symbols = SYMBOLS.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("^", "\\^").replace("-", "\\-")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\S+')) AS n_words, length(regexp_replace(text, '\\s+', '', 'g')) AS ink,
  list_filter(string_split(text, chr(10)), lambda s: s <> '') AS lines,
  list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda s: s <> '') AS words,
  string_split_regex(lower(text), '[^\\p{{L}}]+') AS letters FROM t),
m AS (SELECT doc_id, CAST(n_words AS INTEGER) AS n_words,
  CASE WHEN n_words > 0 THEN round(ink / n_words, 6) ELSE 0.0 END AS mean_word_length,
  CASE WHEN ink > 0 THEN round((length(text) - length(regexp_replace(text, '[{symbols}]', '', 'g'))) / ink, 6) ELSE 0.0 END AS symbol_ratio,
  CASE WHEN ink > 0 THEN round(len(regexp_extract_all(text, '\\p{{Lu}}')) / ink, 6) ELSE 0.0 END AS capital_ratio,
  CASE WHEN n_words > 0 THEN round(len(list_filter(letters, lambda w: w IN ({stop}))) / n_words, 6) ELSE 0.0 END AS stop_word_ratio,
  CASE WHEN len(words) > 0 THEN round(len(list_distinct(words)) / len(words), 6) ELSE 0.0 END AS distinct_word_ratio,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda s: regexp_matches(s, '^\\s*[-*•]'))) / len(lines), 6) ELSE 0.0 END AS bullet_line_ratio,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda s: regexp_matches(s, '(\\.\\.\\.|…)\\s*$'))) / len(lines), 6) ELSE 0.0 END AS ellipsis_line_ratio,
  CASE WHEN len(lines) > 0 THEN round(len(list_distinct(lines)) / len(lines), 6) ELSE 0.0 END AS distinct_line_ratio FROM p),
f AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT *, len(failed) = 0 AS keep FROM f
"""


#: What judge gives for documents, as SQL.
SQL = _sql()
