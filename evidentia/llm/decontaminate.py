"""Benchmark decontamination by spaced seeds: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch, free_name

#: Fixed masks over token positions: 1 is hashed, 0 is ignored. With every third, fourth, fifth, ... token substituted, at any
#: phase, one of them still fits (tested); substitutions at random are found at the rates that the tests measure.
MASKS = ["110111", "1101011", "10110011", "11011011"]
#: An overlap scores 1 for each equal token and -1 for each substituted one; it counts from this score (or the item's tokens, if fewer).
LEAST_SCORE = 10
#: An overlap also counts if all but one in so many of the item's tokens are equal. That is less than LEAST_SCORE asks for up to
#: PLAIN_BELOW tokens; such items are also looked for by plain seeds: one piece more than tokens may differ, so one is whole.
EACH, PLAIN_BELOW = 6, 14
#: A seed index is broadcast up to so many seeds (two numbers and a hash each). Beyond that a bitmap of its hashes is, which
#: has 2 ** MAP_BITS bits however many seeds there are (at most 2 ** 20 rows of 64), and what it lets through is shuffled.
BROADCAST_SEEDS, MAP_BITS = 300_000, 26
#: Hashes of overlapping texts (8 bytes each) are broadcast up to so many; beyond that the join shuffles.
BROADCAST_TEXTS = 500_000

NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of the whole text."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), " ")


def seed_hashes(words: Column, at: Column) -> list[Column]:
    """One hash for each mask laid at a position, of the tokens that are there; see ``inside``."""
    return [F.xxhash64(F.lit(k), *(F.get(words, at + j) for j, c in enumerate(mask) if c == "1")) for k, mask in enumerate(MASKS)]


def plain_hash(words: Column, at: Column, length: int) -> Column:
    """The hash of so many tokens in a row."""
    return F.xxhash64(F.lit(-length), *(F.get(words, at + j) for j in range(length)))


def inside(at: Column, which: Column, words: Column) -> Column:
    """Whether a mask laid at a position ends inside the text. Asked of hits, not of all seeds: a seed that runs past the end has
    the hash of fewer tokens, and generated code with a test for each hash would be too long to be compiled."""
    return at + F.get(F.array(*(F.lit(len(m)) for m in MASKS)), which) <= F.size(words)


def run_before(words: Column, at: Column, which: Column) -> Column:
    """The hash of all tokens from the one before a mask to the mask's last but one; null at the beginning and for plain seeds."""
    return F.when((at > 0) & (which >= 0), F.xxhash64(F.slice(words, at, F.get(F.array(*(F.lit(len(m)) for m in MASKS)), which))))


def positions(words: Column, least: int = len(MASKS[0])) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - least, F.lit(0)))


def plain_seeds(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """Rows (_item, _n, _p, _h, _k, _before) for the pieces of items (_item, _its) of fewer than PLAIN_BELOW tokens, and the lengths that occur."""
    size = lambda n: n // (n // EACH + 1)
    short = items.where(F.size("_its") < PLAIN_BELOW).select("_item", "_its", F.size("_its").alias("_n"))
    lengths = sorted({size(r[0]) for r in short.select("_n").distinct().collect()})
    length = F.expr(f"cast(_n div (_n div {EACH} + 1) as int)")
    pieces = short.select("_item", "_its", "_n", length.alias("_l"), F.explode(F.expr(f"transform(sequence(0, cast(_n div {EACH} as int)), k -> cast(k * (_n div (_n div {EACH} + 1)) as int))")).alias("_p"))
    chosen = F.coalesce(*(F.when(F.col("_l") == k, plain_hash(F.col("_its"), F.col("_p"), k)) for k in lengths), F.lit(None).cast("long"))
    return pieces.select("_item", "_n", "_p", chosen.alias("_h"), F.lit(-1).alias("_k"), F.lit(None).cast("long").alias("_before")), lengths


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_score: int = LEAST_SCORE) -> DataFrame:
    """Per document id and benchmark item that overlap: score, item_tokens, offset (of the item's first token in the document).

    Seeds at every position of every whole text are probed against the benchmark's seeds; of hits in a row only the first
    stays. They become (document, item, diagonal), pre-aggregated where they arise with the window of tokens around them; there the best
    stretch of equal and substituted tokens is scored. The best diagonal of each pair is returned, if its score
    suffices or, for a short item, enough of its tokens are equal (all of them below EACH). Null and empty texts overlap
    with nothing; repeated rows give one result; null ids are kept as null; other columns are ignored; empty tables give no rows.
    """
    scored = scored_diagonals(docs, benchmark, id_col, text_col, item_col, item_text_col, least_score, Scratch(docs.sparkSession, "decontaminate"))
    top = scored.groupBy("_id", "_item", "_n").agg(F.max(F.struct("_score", (-F.col("_d")).alias("_d"))).alias("_m"))
    return top.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), F.col("_m._score").cast("long").alias("score"), F.col("_n").cast("long").alias("item_tokens"), (-F.col("_m._d")).cast("long").alias("offset"))


def scored_diagonals(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, least_score: int, scratch: Scratch) -> DataFrame:
    """(_id, _t, _item, _n, _d, _score): the diagonals that count, of each text (by its hash _t)."""
    items = benchmark.select(F.col(item_col).alias("_item"), tokens(F.col(item_text_col)).alias("_its")).where(F.get("_its", F.lit(0)) != "").dropDuplicates(["_item", "_its"])
    spread = items.where(F.size("_its") >= len(MASKS[0])).select("_item", "_its", F.explode_outer(positions(F.col("_its"))).alias("_p"))
    index = spread.select("_item", "_its", F.size("_its").alias("_n"), "_p", F.posexplode(F.array(*seed_hashes(F.col("_its"), F.col("_p")))).alias("_k", "_h"))
    index = index.where(inside(F.col("_p"), F.col("_k"), F.col("_its"))).select("_item", "_n", "_p", "_h", "_k", run_before(F.col("_its"), F.col("_p"), F.col("_k")).alias("_before"))
    plain, lengths = plain_seeds(items)
    index = index.union(plain).distinct()
    few = index.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    # explode_outer: a plain explode would make the optimizer test the array first and so split every text twice.
    split = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), tokens(F.col(text_col)).alias("_w"))
    at = split.select("*", F.explode_outer(positions(F.col("_w"), min([len(MASKS[0]), *lengths]))).alias("_i"))
    hashes = F.array(*seed_hashes(F.col("_w"), F.col("_i")), *(plain_hash(F.col("_w"), F.col("_i"), k) for k in lengths))
    if few:
        hits = at.select("*", F.explode(hashes).alias("_h")).join(F.broadcast(index), "_h").where((F.col("_k") < 0) | inside(F.col("_i"), F.col("_k"), F.col("_w")))
        # Where all tokens from the one before on are equal, the hit of the same mask there speaks for this one: a whole copy is one hit a mask.
        hits = hits.where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(run_before(F.col("_w"), F.col("_i"), F.col("_k"))))
        hits = hits.withColumn("_d", F.col("_i") - F.col("_p"))
    else:
        met = scratch.keep(thin_hits(at, hashes, index), "met")
        again = docs.select(F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("_text")).join(only(met.select("_t").distinct()), "_t", "left_semi").dropDuplicates(["_t"])
        hits = met.join(again.select("_t", tokens(F.col("_text")).alias("_w")), "_t")
    start = F.greatest(F.col("_d"), F.lit(0))
    window = F.array_join(F.slice("_w", start + 1, F.greatest(F.col("_n") - F.greatest(-F.col("_d"), F.lit(0)), F.lit(0))), " ")
    # The window is cut out first, so that what is sorted and grouped holds no whole texts.
    near = hits.select("_id", "_t", "_item", "_n", "_d", window.alias("_near"))
    # The same text of the same id is scored once.
    laid = near.groupBy("_id", "_t", "_item", "_n", "_d").agg(F.min("_near").alias("_near"))
    own = F.slice("_its", F.greatest(-F.col("_d"), F.lit(0)) + 1, F.size("_its"))
    equal = F.zip_with(own, F.split("_near", " "), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(-2)))
    # Kadane's best stretch: (running score, best), and all equal tokens. -2 marks places where one of the two texts has ended.
    start_at = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("same"))
    sums = F.aggregate(equal, start_at, lambda s, e: F.struct(F.greatest(s["now"] + F.when(e == 1, 1).when(e == 0, -1).otherwise(0), F.lit(0)).alias("now"), F.greatest(s["best"], s["now"] + F.when(e == 1, 1).otherwise(0)).alias("best"), (s["same"] + F.when(e == 1, 1).otherwise(0)).alias("same")))
    texts = items.select("_item", F.size("_its").alias("_n"), "_its")
    scored = laid.join(F.broadcast(texts) if few else texts, ["_item", "_n"]).select("_id", "_t", "_item", "_n", "_d", sums.alias("_s")).select("_id", "_t", "_item", "_n", "_d", F.col("_s.best").alias("_score"), F.col("_s.same").alias("_same"))
    return scored.where((F.col("_score") >= F.least(F.lit(least_score), F.col("_n"))) | ((F.col("_n") < PLAIN_BELOW) & (F.col("_same") >= F.col("_n") - F.floor(F.col("_n") / EACH))))


def thin_hits(at: DataFrame, hashes: Column, index: DataFrame) -> DataFrame:
    """(_id, _t, _item, _n, _d): diagonals with a hit, for an index of any size.

    Of each position only hashes that the bitmap knows go on, with numbers and no tokens, to the shuffled join with the index.
    """
    bit = F.pmod(F.col("_h"), F.lit(1 << MAP_BITS))
    known = index.select(F.shiftright(bit, 6).alias("_at"), bit.bitwiseAND(F.lit(63)).cast("int").alias("_bit"))
    known = known.groupBy("_at").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_map"))
    seeds = at.select("*", F.posexplode(hashes).alias("_s", "_h")).withColumn("_at", F.shiftright(bit, 6))
    seeds = seeds.join(F.broadcast(known), "_at").where(F.getbit("_map", bit.bitwiseAND(F.lit(63))) == 1)
    masked = F.col("_s") < len(MASKS)
    seeds = seeds.where(~masked | inside(F.col("_i"), F.col("_s"), F.col("_w")))
    thin = seeds.select("_id", "_t", "_i", "_h", F.when(masked, run_before(F.col("_w"), F.col("_i"), F.col("_s"))).alias("_run"))
    hits = thin.join(index, "_h").where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_run")))
    return hits.select("_id", "_t", "_item", "_n", (F.col("_i") - F.col("_p")).alias("_d")).distinct()


def only(names: DataFrame) -> DataFrame:
    """Text hashes, broadcast up to BROADCAST_TEXTS of them."""
    return F.broadcast(names) if names.count() <= BROADCAST_TEXTS else names


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs without the documents whose text overlaps with a benchmark item.

    Texts are named by their hash, so rows without an id and rows that repeat an id with another text are each judged by
    their own text. The hashes of overlapping texts are written first; up to BROADCAST_TEXTS of them are broadcast.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    bad = scratch.keep(scored_diagonals(docs, benchmark, id_col, text_col, item_col, item_text_col, LEAST_SCORE, scratch).select("_t").distinct(), "bad")
    name = free_name(docs, "_t")
    return docs.join(only(bad).withColumnRenamed("_t", name), F.xxhash64(text_col) == F.col(name), "left_anti").select(docs.columns)


def oracle() -> str:
    """The overlaps as DuckDB SQL without seeds: every diagonal with enough equal tokens is scored by running sums."""
    words = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
    enough = f"least({LEAST_SCORE}, CASE WHEN n < {PLAIN_BELOW} THEN n - n // {EACH} ELSE n END)"
    return f"""
    WITH items AS (SELECT DISTINCT item_id, {words} AS w, len({words}) AS n FROM benchmark WHERE {words} <> ['']),
    d AS (SELECT DISTINCT doc_id, {words} AS w, hash({words}) AS t FROM documents),
    ip AS (SELECT item_id, n, unnest(w) AS x, unnest(range(0, n)) AS p FROM items), dp AS (SELECT doc_id, t, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
    laid AS (SELECT doc_id, t, item_id, n, dp.p - ip.p AS diag FROM dp JOIN ip USING (x) GROUP BY ALL HAVING count(*) >= {enough}),
    spots AS (SELECT laid.doc_id, laid.t, laid.item_id, laid.n, diag, d.w, items.w AS iw, unnest(range(1, laid.n + 1)) AS k FROM laid JOIN d ON d.doc_id IS NOT DISTINCT FROM laid.doc_id AND d.t = laid.t JOIN items ON items.item_id IS NOT DISTINCT FROM laid.item_id AND items.n = laid.n),
    e AS (SELECT doc_id, t, item_id, n, diag, k, CASE WHEN k + diag < 1 OR k + diag > len(w) THEN 0 WHEN iw[k] = w[k + diag] THEN 1 ELSE -1 END AS s FROM spots),
    r AS (SELECT *, sum(s) OVER o AS run FROM e WINDOW o AS (PARTITION BY doc_id, t, item_id, n, diag ORDER BY k)),
    b AS (SELECT *, run - least(0, coalesce(min(run) OVER (PARTITION BY doc_id, t, item_id, n, diag ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score FROM r),
    s AS (SELECT doc_id, item_id, n, diag, max(score) AS score, count(*) FILTER (s = 1) AS same FROM b GROUP BY doc_id, t, item_id, n, diag HAVING max(score) >= least({LEAST_SCORE}, n) OR (n < {PLAIN_BELOW} AND count(*) FILTER (s = 1) >= n - n // {EACH}))
    SELECT doc_id, item_id, max(score)::BIGINT AS score, n::BIGINT AS item_tokens, min_by(diag, (-score, diag))::BIGINT AS "offset" FROM s GROUP BY doc_id, item_id, n"""
