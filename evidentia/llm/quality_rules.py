"""Quality rules as a short-circuit cascade, ordered by rejections per cost as estimated on a sample: built-in expressions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch

#: Texts are split into words at runs of these.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: A run of so many words that is found twice in a text counts as repeated.
WINDOW = 5
#: The base rules: fewest words, and the most repeated words in 100.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Bound of the sample that costs and selectivities are estimated on, and how often each rule is timed. Verdicts do not depend on it.
SAMPLE_ROWS, REPEATS = 1000, 2
SEED = 12

#: What a rule can read: text (nulls as empty), words, n_words and word_chars.
Fields = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """rejects(fields) is true for texts that go. sql is the same condition for DuckDB."""

    name: str
    rejects: Callable[[Fields], Column]
    sql: str


@dataclass(frozen=True)
class Estimate:
    """Seconds that a rule takes for the sample's rows alone, and the share of them that it rejects."""

    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once, however often body names it; inside a branch of CASE it is computed there only."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def line_list(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def repeated_lines(text: Column) -> Column:
    return let(line_list(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in a run of width words that is found twice or more; see ``repeated_in``."""
    return let(words, lambda bound: repeated_in(bound, width))


def repeated_in(words: Column, width: int) -> Column:
    """How many words stand in a run of width words that is found twice or more, the first time included.

    Equal hashes of runs are looked for first, which few texts have; sorted by hash and place, runs are then compared word by word
    with their neighbours. (No slice of words inside a lambda: it copies the whole array each time.)
    """

    def run(of: Column, place: Column) -> list[Column]:
        return [F.get(of, place + k) for k in range(width)]

    def found(runs: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            beside = [F.get(runs, j - 1), F.get(runs, j + 1)]
            return F.greatest(*(F.coalesce((y["h"] == x["h"]) & (F.array(*run(words, y["i"])) == F.array(*run(words, x["i"]))), F.lit(False)) for y in beside))

        places = F.array_sort(F.transform(F.filter(runs, twice), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda s, p: F.struct((p + width).alias("end"), (s["n"] + width - F.greatest(s["end"] - p, F.lit(0))).alias("n")), lambda s: s["n"])

    hashes = let(F.transform(words, lambda x: F.xxhash64(x)), lambda hs: F.transform(F.sequence(F.lit(0), F.size(hs) - width), lambda i: F.xxhash64(*run(hs, i))))
    ordered = lambda hs: F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ordered(hs), found)))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(some)


def most_words(f: Fields, what: Callable[[Column], Column], percent: int) -> Column:
    return 100 * F.size(F.filter(f["words"], what)) > percent * f["n_words"]


def most_lines(text: Column, pattern: str, percent: int) -> Column:
    return let(line_list(text), lambda lines: 100 * F.size(F.filter(lines, lambda x: x.rlike(pattern))) > percent * F.size(lines))


_LINES = f"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}'))"

#: The two base rules, of which the first needs a count only.
BASE = [
    Rule("few_words", lambda f: f["n_words"] < LEAST_WORDS, f"n_words < {LEAST_WORDS}"),
    Rule("repeated_words", lambda f: 100 * repeated_words(f["words"]) > MOST_REPEATED * f["n_words"], f"100 * n_repeat_words > {MOST_REPEATED} * n_words"),
]
#: Rules on top of them, in the manner of published web-corpus filters; thresholds in percent of words, letters or lines.
RULES = [
    Rule("symbols", lambda f: 100 * F.regexp_count(f["text"], F.lit(SYMBOL)) > 10 * f["n_words"], f"100 * (length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g'))) > 10 * n_words"),
    Rule("word_length", lambda f: (2 * f["word_chars"] < 5 * f["n_words"]) | (f["word_chars"] > 12 * f["n_words"]), "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words"),
    Rule("repeated_lines", lambda f: let(line_list(f["text"]), lambda x: 100 * F.size(F.array_distinct(x)) < 50 * F.size(x)), f"100 * len(list_distinct({_LINES})) < 50 * len({_LINES})"),
    Rule("capitals", lambda f: most_words(f, lambda x: (x == F.upper(x)) & (x != F.lower(x)), 60), "100 * len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) > 60 * n_words"),
    Rule("exclamations", lambda f: most_words(f, lambda x: x.endswith("!"), 30), "100 * len(list_filter(words, lambda x: suffix(x, '!'))) > 30 * n_words"),
    Rule("few_letters", lambda f: most_words(f, lambda x: ~x.rlike(r"\p{L}"), 50), r"100 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > 50 * n_words"),
    Rule("bullets", lambda f: most_lines(f["text"], r"^[ \t]*[-*\u2022]", 90), f"100 * len(list_filter({_LINES}, lambda x: regexp_matches(x, '^[ \\t]*[-*\u2022]'))) > 90 * len({_LINES})"),
    Rule("ellipses", lambda f: most_lines(f["text"], r"(\.\.\.|\u2026)[ \t\r]*$", 30), f"100 * len(list_filter({_LINES}, lambda x: regexp_matches(x, '(\\.\\.\\.|\u2026)[ \\t\\r]*$'))) > 30 * len({_LINES})"),
    Rule("placeholder", lambda f: F.contains(F.lower(f["text"]), F.lit("lorem ipsum")), "contains(lower(text), 'lorem ipsum')"),
]


def fields(text: Column, words: Column) -> Fields:
    return {"text": text, "words": words, "n_words": F.size(words), "word_chars": F.length(F.array_join(words, ""))}


def with_fields(df: DataFrame, text_col: str) -> tuple[DataFrame, Fields]:
    """df with _text (nulls as empty), _words and their counts as columns, and these columns."""
    df = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_words", word_list(F.col("_text")))
    df = df.select("*", *(c.alias(f"_{k}") for k, c in fields(F.col("_text"), F.col("_words")).items() if k not in ("text", "words")))
    return df, {k: F.col(f"_{k}") for k in ("text", "words", "n_words", "word_chars")}


def estimates(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, scratch: Scratch | None = None) -> list[Estimate]:
    """Cost and selectivity of each rule, alone, on a sample of about sample_rows rows from all over docs.

    The sample is written once, with its words. A rule's cost is the shortest of a few runs over it, less the shortest run without a rule.
    """
    own = scratch or Scratch(docs.sparkSession, "quality-rules")
    rows = docs.count()
    sample = docs.select(F.col(text_col).alias("text"))
    if rows > sample_rows:
        sample = sample.sample(sample_rows / rows, SEED)
    # A few equal parts, so that a run takes little longer than its share of the work.
    sample, f = with_fields(sample.repartition(docs.sparkSession.sparkContext.defaultParallelism), "text")
    sample = own.keep(sample.select(*f.values()), "sample")

    def run(condition: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(REPEATS):
            began = time.perf_counter()
            n, hit = sample.agg(F.count("*"), F.count_if(condition), F.sum("_n_words"), F.sum("_word_chars")).first()[:2]
            best, share = min(best, time.perf_counter() - began), hit / max(n, 1)
        return best, share

    idle, _ = run(F.col("_n_words") < 0)
    measured = [(r.name, *run(r.rejects(f))) for r in rules]
    own.drop("sample")
    return [Estimate(name, max(seconds - idle, 1e-3), share) for name, seconds, share in measured]


def ordered(rules: Sequence[Rule], found: Sequence[Estimate]) -> list[Rule]:
    """Most rejections per second first; rules that reject nothing in the sample come last, cheap ones first."""
    of = {e.name: e for e in found}
    return sorted(rules, key=lambda r: (-of[r.name].gain, of[r.name].seconds, r.name))


def first_failed(rules: Sequence[Rule], f: Fields) -> Column:
    """The name of the first rule that rejects, null if none does. A rule is evaluated only where all before it have passed."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(f), F.lit(rule.name)).otherwise(out)
    return out


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = (*BASE, *RULES), sample_rows: int = SAMPLE_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """docs without the rows that a rule rejects: the cascade over all rules, the base ones included.

    Columns stay, whatever they are called. Null and empty texts have no words and go by ``few_words``. Which rows stay does not
    depend on the order of the rules, so not on the sample either. An empty table gives an empty one.
    """
    chosen = ordered(rules, estimates(docs, rules, text_col, sample_rows, scratch))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # One expression, since a filter is pushed down to the scan, where columns made before it would be made again at each use.
    return docs.where(let(word_list(text), lambda words: first_failed(chosen, fields(text, words))).isNull())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = tuple(RULES), sample_rows: int = SAMPLE_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    The counts are over the whole text and made for every row; rows that pass the base rules go through the cascade of the others.
    Null and empty texts have no words, so they fail the base rules. Repeated rows and rows without an id each get a row; other
    columns are ignored; an empty table gives no rows.
    """
    chosen = ordered(rules, estimates(docs, rules, text_col, sample_rows, scratch))
    df, f = with_fields(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    df = df.select("id", *f.values(), F.regexp_count(f["text"], F.lit(SYMBOL)).alias("_n_symbols"), repeated_lines(f["text"]).alias("_n_dup_lines"), repeated_words(f["words"]).alias("_n_repeat_words"))
    failed = (f["n_words"] < LEAST_WORDS) | (100 * F.col("_n_repeat_words").cast("long") > MOST_REPEATED * f["n_words"])
    df = df.withColumn("_failed", failed)
    kept = F.when(F.col("_failed"), F.lit(False)).otherwise(first_failed(chosen, f).isNull())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select(F.col("id").alias(id_col), *(F.col(f"_{c}").cast("long").alias(c) for c in counts), F.col("_failed").alias("base_failed"), kept.alias("kept"))


def oracle() -> str:
    """The same columns as DuckDB SQL, all rules evaluated."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS words FROM d),
    runs AS (SELECT r, unnest(range(1, len(words) - {WINDOW} + 2)) AS p, words FROM w WHERE len(words) >= {WINDOW}),
    hits AS (SELECT r, p, count(*) OVER (PARTITION BY r, words[p : p + {WINDOW} - 1]) AS k FROM runs),
    spots AS (SELECT r, count(DISTINCT p + j) AS n FROM hits, range({WINDOW}) t(j) WHERE k > 1 GROUP BY r),
    b AS (SELECT w.r, doc_id, text, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g')) AS n_symbols,
      len({_LINES}) - len(list_distinct({_LINES})) AS n_dup_lines, coalesce(spots.n, 0) AS n_repeat_words FROM w LEFT JOIN spots ON spots.r = w.r)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
      {" OR ".join(f"({r.sql})" for r in BASE)} AS base_failed, NOT ({" OR ".join(f"({r.sql})" for r in [*BASE, *RULES])}) AS kept FROM b"""
