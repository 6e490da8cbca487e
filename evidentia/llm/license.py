"""License scan by canonical digest lookup: entire texts, brought to a canonical form, are hash-joined to known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import let
from evidentia.llm.license_texts import DIGESTS, STATEMENTS, TEXTS

#: Spellings that count as the same (word, canonical word), as public licence matching guidelines list them.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sublicence", "sublicense"), ("sublicences", "sublicenses"), ("sublicenced", "sublicensed"), ("licences", "licenses"), ("licencing", "licensing"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
]

#: Equivalents of several words, as canonical words stand: (spelling, canonical spelling), in this order.
PHRASES = [("sub license", "sublicense"), ("sub licence", "sublicense"), ("per cent", "percent"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders")]
#: What SHA-256 of a long licence stops after, beside the whole text.
TERMS_END = "end of terms and conditions"

#: A known-licence table is broadcast only up to this many rows (of two short strings); beyond it the join shuffles.
BROADCAST_ROWS = 10_000

#: On lower-cased text: lines that state a copyright (and name a year, a sign or a placeholder), and list marks before a line's words.
DROPPED = r"^(?:[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*(?:\(c\)|©|[12][0-9]{3}|<[^\n]*>|\[[^\n]*\])[^\n]*$|[^a-z0-9\n]*(?:\(c\)|©) [^\n]*$|[^a-z0-9\n]*all rights reserved[^\n]*$|[^\S\n]*(?:[0-9]{1,2}|[a-z])[.)][^\S\n])"
#: On what is left: up to four lines at the start that name the licence, its version or its address and end like a title.
TITLES = r"\A(?:(?:[^\n]{0,80}\blicen[cs]e\b(?:[^\n]{0,60}[^\s.:;,])?|[^\n]{0,10}version [0-9][^\n]{0,40}|<?https?://[^\s]+)[^\S\n]*\n\s*){1,4}"


def canonical(text: Column) -> Column:
    """Lower case; no copyright lines, list marks and title lines; words of letters and digits only, equivalent spellings alike, single blanks between.

    A text of nothing but title lines keeps them.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + DROPPED, ""), r"\A\s+", "")
    return let(let(plain, untitled), spelled_alike)


def untitled(plain: Column) -> Column:
    return let(F.regexp_replace(plain, TITLES, ""), lambda body: F.when(body.rlike(r"[\p{L}\p{N}]"), body).otherwise(plain))


def spelled_alike(text: Column) -> Column:
    """Words with single blanks between. Only texts with one of the spellings pay for the replacements, which run on words, not on parts of words."""
    same = F.create_map(*(F.lit(x) for pair in EQUIVALENT for x in pair))
    some = f" ({'|'.join([a for a, _ in EQUIVALENT + PHRASES])}) "

    def fixed(words: Column) -> Column:
        out = F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.try_element_at(same, w), w)), " ")
        for a, b in PHRASES:
            out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
        return out

    return F.trim(let(F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" ")), lambda words: F.when(words.rlike(some), fixed(words)).otherwise(words)))


def known_licenses(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    """license_id, text of the built-in licences and statements, and of any more that are given."""
    rows = [(k, v) for k, v in (TEXTS | STATEMENTS | (more or {})).items()]
    return spark.createDataFrame(rows, "license_id string, text string")


def licenses_in(spark: SparkSession, folder: str) -> DataFrame:
    """license_id (the file's name), text of every file below a folder of licence texts, each read whole."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt|\.md)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("license_id"), F.col("value").alias("text"))


def digests_of(known: DataFrame) -> DataFrame:
    """(license_id, digest) of known licences (license_id, text): the whole text's, and that of the text up to the end of its terms."""
    whole = known.select("license_id", canonical(F.col("text")).alias("c"))
    cut = F.concat(F.substring_index("c", f" {TERMS_END}", 1), F.lit(f" {TERMS_END}"))
    both = F.when(F.contains("c", F.lit(f" {TERMS_END}")), F.array("c", cut)).otherwise(F.array("c"))
    return whole.select("license_id", F.explode(both).alias("c")).where("c <> ''").select("license_id", F.sha2("c", 256).alias("digest")).distinct()


def published_digests(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the long licences whose digests come with the library."""
    return spark.createDataFrame([(k, d) for k, own in DIGESTS.items() for d in own], "license_id string, digest string")


def scan(docs: DataFrame, known: DataFrame, digests: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, digest (SHA-256 of the canonical text), n_canonical (its length), license_id (null where none), statements.

    known has (license_id, text), digests more (license_id, digest). license_id comes from the whole text alone.
    statements are the built-in one-line statements that stand as lines of their own inside the text, joined by commas.
    Built-in expressions only. Texts travel no further than their digest: the join sees 64 characters for each row, and
    hot digests are split by adaptive execution. Null, empty and wordless texts have the digest of the empty string and
    match nothing; repeated rows each get a row; of several licences with the same canonical text the smallest id
    is taken; other columns are ignored, and an empty table gives no rows.
    """
    every = digests_of(known)
    every = (every.unionByName(digests.select("license_id", "digest")) if digests is not None else every).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    few = len(every.select("license_id").take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    scanned = docs.select(F.col(id_col), F.col(text_col).alias("_t"), canonical(F.col(text_col)).alias("_c"))
    scanned = scanned.select(id_col, F.sha2("_c", 256).alias("digest"), F.length("_c").cast("long").alias("n_canonical"), statements(F.col("_t")).alias("statements"))
    return scanned.join(F.broadcast(every) if few else every, "digest", "left").select(id_col, "digest", "n_canonical", "license_id", "statements")


def statements(text: Column) -> Column:
    """Ids of the one-line statements among the text's lines, sorted and joined by commas; null where there are none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(F.lower(x), F.lit("licen")) | F.contains(F.lower(x), F.lit("released")))
    ids = F.create_map(*(x for k, v in STATEMENTS.items() for x in (F.lit(fixed_canonical(v)), F.lit(k))))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(ids, canonical(x))), lambda x: x.isNotNull())))
    return F.when(F.lower(text).rlike("licen|released") & (F.size(found) > 0), F.array_join(found, ","))


def fixed_canonical(statement: str) -> str:
    """The canonical form of a one-line statement in plain words without variant spellings, as ``canonical`` gives it."""
    return " ".join("".join(c if c.isalnum() else " " for c in statement.lower()).split())


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in (TEXTS | STATEMENTS).items())
    more = ", ".join(f"({quote(k)}, {quote(d)})" for k, own in DIGESTS.items() for d in own)
    same = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in EQUIVALENT)
    phrases = "f"
    for a, b in PHRASES:
        phrases = f"replace({phrases}, ' {a} ', ' {b} ')"
    lines = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), 'licen|released'))"
    said = ", ".join(f"({quote(k)}, {quote(fixed_canonical(v))})" for k, v in STATEMENTS.items())
    return f"""
    WITH same(a, b) AS (VALUES {same}), m AS (SELECT map(list(a), list(b)) AS m FROM same), known(license_id, text) AS (VALUES {known}), more(license_id, digest) AS (VALUES {more}), said(id, c) AS (VALUES {said}),
    every AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id, NULL AS license_id, text FROM documents UNION ALL SELECT 1, 0, NULL, license_id, text FROM known UNION ALL SELECT 2, r, NULL, NULL, unnest({lines}) FROM (SELECT row_number() OVER () AS r, text FROM documents)),
    plain AS (SELECT kind, r, doc_id, license_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '(?m){DROPPED}', '', 'g'), '\\A\\s+', '') AS p FROM every),
    cut AS (SELECT kind, r, doc_id, license_id, CASE WHEN regexp_matches(regexp_replace(p, '{TITLES}', ''), '[\\p{{L}}\\p{{N}}]') THEN regexp_replace(p, '{TITLES}', '') ELSE p END AS p FROM plain),
    spelled AS (SELECT kind, r, doc_id, license_id, array_to_string(list_transform(string_split(' ' || regexp_replace(p, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' '), lambda w: coalesce(m[w], w)), ' ') AS f FROM cut, m),
    canon AS (SELECT kind, r, doc_id, license_id, trim({phrases}) AS c FROM spelled),
    digests AS (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256(c) AS digest, license_id FROM canon WHERE kind = 1 AND c <> '' UNION ALL SELECT digest, license_id FROM more) GROUP BY 1),
    lines AS (SELECT r, string_agg(DISTINCT said.id, ',' ORDER BY said.id) AS statements FROM canon JOIN said USING (c) WHERE kind = 2 GROUP BY r)
    SELECT doc_id, sha256(c) AS digest, length(c)::BIGINT AS n_canonical, digests.license_id, statements FROM canon LEFT JOIN digests ON sha256(c) = digests.digest LEFT JOIN lines USING (r) WHERE kind = 0"""


if __name__ == "__main__":
    import sys

    spark = SparkSession.builder.master("local[2]").getOrCreate()
    for file in sys.argv[1:]:
        rows = digests_of(licenses_in(spark, file)).orderBy("digest").collect()
        print(f'    "{rows[0].license_id}": [{", ".join(repr(r.digest) for r in rows)}],'.replace("'", '"'))
