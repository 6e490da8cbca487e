"""Text functions on columns. All are built-in expressions; arguments and results are Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a text's strip and split take it, beyond what \s matches in Java.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The characters of SPACE: a trim by them looks at the ends of a text only.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ARTICLE = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
EVIDENCE = r"(?s)<\|EVIDENCE\|>(.*?)</\|EVIDENCE\|>"
TAGGED_ANSWER = r"(?s)<\|answer\|>(.*?)</\|answer\|>"
ANSWER_LINE = r"(?d)Answer:\s*([^\n]+)(?:\n|$)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row: what a lambda holds is otherwise computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{Punct}", ""), ARTICLE, " "))


def clean_text(c: Column) -> Column:
    """As T1, but articles stay."""
    return F.lower(squeeze(F.regexp_replace(c, r"\p{Punct}", "")))


def remove_evidence(c: Column) -> Column:
    """T5: evidence spans go with their content."""
    return squeeze(F.regexp_replace(c, EVIDENCE, ""))


def extract_answer(c: Column) -> Column:
    """The last "Answer:" line without tags; null where there is none."""
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(ANSWER_LINE), 1), F.lit(-1))
    return F.regexp_replace(remove_evidence(F.regexp_replace(last, r"</?\|answer\|>", "")), "[<>]", "")


def extract_answer_tagged(c: Column) -> Column:
    """T4: the first tagged answer; empty where there is none."""
    return strip(F.regexp_extract(c, TAGGED_ANSWER, 1))


def extract_evidence(c: Column) -> Column:
    """Trimmed evidence spans, empty ones kept; an empty array for null."""
    return F.coalesce(F.transform(F.regexp_extract_all(c, F.lit(EVIDENCE), 1), strip), F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    """Sentences by closing punctuation, blanks dropped (rule based).

    The text is stripped as a whole, and a cut takes all white space up to the next sentence, so none is left at the ends of a sentence.
    The pattern begins with a blank, so it looks back at blanks only.
    """
    return F.filter(F.split(strip(c), rf"\s(?<=[.!?。！？]\s){SPACE}*"), lambda s: s != "")


def quoted(c: Column) -> Column:
    """The first single-quoted span, else the whole text."""
    return F.when(c.rlike("(?s)'.*?'"), F.regexp_extract(c, "(?s)'(.*?)'", 1)).otherwise(c)


def html_sentences(c: Column) -> Column:
    """Pieces between <br>, without a leading sentence mark; empty ones dropped."""
    pieces = F.transform(F.split(c, r"(?i)<br\s*/?>"), lambda s: strip(F.regexp_replace(s, r"(?is)^.*?<b>Sent\s+\d+:\s*</b>\s*", "")))
    return F.filter(pieces, lambda s: s != "")


def citation_ids(c: Column) -> Column:
    """All-digit ids of all bracket groups, in order, repeated ones kept."""
    groups = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"(?d)\[(.*?)\]"), 1), lambda g: F.split(g, ",")))
    return F.filter(F.transform(groups, strip), lambda s: s.rlike(r"^\d+$"))


def safe_id(c: Column) -> Column:
    """Unsafe characters of an id as single underscores."""
    out = F.regexp_replace(F.regexp_replace(c, r"[\\/:*?\"<>|'\x00-\x1f]", "_"), "_+", "_")
    out = F.regexp_replace(out, "^_|_$", "")
    return F.when(out == "", "sample_id").otherwise(out)


def safe_question(c: Column, most: int = 100) -> Column:
    """A question as a file name part, of at most so many characters."""
    out = F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), r"[\\/:*?\"<>|'\x00-\x1f]", "")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")
    out = F.regexp_replace(F.substring(out, 1, most), "^_|_$", "")
    return F.when(out == "", "question").otherwise(out)


#: Canonical dataset names.
DATASETS = ["Mixture", "FaithEval", "HotpotQA", "MultiRC", "MuSiQue", "PopQA", "PubMedQA", "Qasper", "2WikiMultiHopQA", "ConFiQA"]


def dataset_name(c: Column) -> Column:
    """The canonical name that equals this one but for case, dashes and underscores; else the name itself."""
    key = F.regexp_replace(F.lower(c), "[-_]", "")
    out = F.when(key.contains("2wiki") & ~key.contains("multihop"), F.lit("2WikiMultiHopQA")).otherwise(c)
    for name in DATASETS:
        out = F.when(key == name.lower(), name).otherwise(out)
    return F.when(key == "twowikimultihopqa", "2WikiMultiHopQA").otherwise(out)


def naive_sentences(c: Column) -> Column:
    """Pieces between ". ", each with a stop at its end; blank ones dropped."""
    return F.transform(F.filter(F.split(c, r"\. "), lambda s: strip(s) != ""), lambda s: F.concat(strip(s), F.lit(".")))


def run_path(c: Column) -> dict[str, Column]:
    """What a result path says of its run, as columns by name; nulls for what it does not say."""
    got = lambda pattern, k=1: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    folder = r"/([^/]+?)-noise_(\d+)-(answerable|unanswerable)(?:/|$)"
    last = F.regexp_extract(c, r"([^/]+)/?$", 1)
    seeded = c.rlike("(^|/)seed_[^/]+/tpr_")
    level = F.when(F.startswith(last, F.lit("prompt_")), "prompt_type").when(last.contains("-noise_") | last.contains("-answerable"), "dataset").when(seeded, "seed_tpr").otherwise("root")
    return {
        "level": level,
        "model": got(r"([^/]+)/seed_[^/]+/"),
        "seed": got(r"(?:^|/)seed_(\d+)").try_cast("int"),
        "tpr": got(r"(?:^|/)tpr_([0-9.]+)").try_cast("double"),
        "prompt_type": got(r"(?:^|/)prompt_([^/]+)"),
        "dataset": got(folder, 1),
        "noise": got(folder, 2).try_cast("int"),
        "answerable": F.nullif(F.regexp_extract(c, folder, 3), F.lit("")) == "answerable",
        "run_ts": got(r"/(\d{14})(?:[/_.]|$)"),
    }


def base_dataset(c: Column) -> Column:
    """A dataset folder's name without the usual noise suffixes."""
    return F.regexp_replace(c, "-noise_(8-answerable|8-unanswerable|0-answerable)$", "")


def method_name(c: Column) -> Column:
    """A prompt folder's name for display."""
    title = F.initcap(F.replace(F.replace(c, F.lit("prompt_"), F.lit("")), F.lit("_"), F.lit(" ")))
    return F.replace(F.replace(title, F.lit("Rep 2"), F.lit("×2")), F.lit("Rep Q"), F.lit("×Q"))


def relative_delta(base: Column, new: Column) -> Column:
    """Change in percent of the base; 0 where the base is 0."""
    return F.when(base == 0, 0.0).otherwise((new - base) / base * 100)


def delta_text(delta: Column) -> Column:
    return F.format_string("%+.1f%%", delta)


def noise_coordinate(noise: Column, gold_removed: Column | None = None, shift: float = 0.5) -> Column:
    """0 for no noise, else log2 + 1; with gold_removed the two sides lie left and right of 0."""
    x = F.when(noise == 0, 0.0).otherwise(F.log2(noise) + 1)
    return x if gold_removed is None else F.when(gold_removed, -(x + shift)).otherwise(x + shift)


def context_text(sents: Column) -> Column:
    """All sentences of all paragraphs, joined by blanks."""
    return F.concat_ws(" ", F.flatten(sents))


def sentence_length(title: Column, sents: Column, wanted: Column, at: Column) -> Column:
    """Length of sentence number ``at`` under a title (the last of equal titles); 0 out of range."""
    hit = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(F.size(title), F.lit(1)) - 1), lambda k: F.get(title, k) == wanted))
    return F.coalesce(F.length(F.get(F.get(sents, hit), F.when(at >= 0, at))), F.lit(0))


def n_words(c: Column) -> Column:
    """Words between white space; 0 for null or blank."""
    return F.when(F.coalesce(strip(c), F.lit("")) == "", 0).otherwise(F.size(F.split(squeeze(c), " ")))


def prose_context(title: Column, sents: Column) -> Column:
    """For each paragraph its title, a stop, its sentences without separators, and a line end."""
    return F.array_join(F.transform(F.arrays_zip(title.alias("t"), sents.alias("s")), lambda p: F.concat(F.coalesce(p["t"], F.lit("")), F.lit(". "), F.array_join(p["s"], ""), F.lit("\n"))), "")


def canonical_paragraph(title: Column, sents: Column) -> Column:
    """###TITLE, a line end, and the sentences joined by blanks."""
    return F.concat(F.lit("###"), F.upper(title), F.lit("\n"), F.concat_ws(" ", sents))


def locate(text: Column, title: Column, sents: Column) -> Column:
    """struct(title, sent_id) of the first sentence that holds the trimmed text; ("", null) where none does."""
    per = F.transform(F.arrays_zip(title.alias("t"), sents.alias("s")), lambda p: F.transform(p["s"], lambda s, k: F.struct(p["t"].alias("title"), k.alias("sent_id"), s.contains(strip(text)).alias("hit"))))
    first = F.get(F.filter(F.flatten(per), lambda x: x["hit"]), F.lit(0))
    return F.struct(F.coalesce(first["title"], F.lit("")).alias("title"), first["sent_id"].alias("sent_id"))


def maximal(c: Column) -> Column:
    """Distinct strings that no other of the array contains, longest first (then in order of text)."""
    return let(F.array_distinct(c), lambda d: by_length(F.filter(d, lambda x: ~F.exists(d, lambda y: (y != x) & y.contains(x))), longest=True))


def minimal(c: Column) -> Column:
    """Distinct strings that contain no other of the array, shortest first (then in order of text)."""
    return let(F.array_distinct(c), lambda d: by_length(F.filter(d, lambda x: ~F.exists(d, lambda y: (y != x) & x.contains(y))), longest=False))


def by_length(c: Column, longest: bool) -> Column:
    sign = -1 if longest else 1
    return F.transform(F.array_sort(F.transform(c, lambda x: F.struct((F.length(x) * sign).alias("n"), x.alias("x")))), lambda s: s["x"])
