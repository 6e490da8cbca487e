"""Exact n-gram Jaccard join by vertical partitioning, and the near-duplicate groups that its links make.

The n-grams (five-word shingles) have a global order. It is cut into fragments; a document is one row per fragment,
overlaps are counted in each fragment by itself, and partial counts are summed per pair. Before that, pairs are found by
prefixes of the order: with Jaccard similarity of 0.8, documents of n shingles must share one of the first
n - ceil(0.8 n) + 1, and at least l of the first n - ceil(0.8 n) + l.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch, as_text, free_name, kind_of

WORDS = 5
#: Fragments of the global order; a row holds a document's shingles of one of them.
FRAGMENTS = 4
#: Cells of each fragment; a class keeps how many of its shingles are in each, which bounds overlaps without reading the sets.
CELLS = 64
#: Prefixes hold 1/EXTRA of the shingles more than one common shingle needs, so that more common ones can be asked for.
EXTRA = 20
#: The names of rows whose texts are read again (8 bytes each) are broadcast up to so many; beyond that all texts are shuffled once.
BROADCAST_ROWS = 1_000_000
#: A pair of classes is taken up at the first shingle that the beginnings of so many of their second prefixes share (at any, if none).
HEAD = 64
#: Hubs of a candidate group that its members are compared with before components are known.
HUBS = 2
#: A component whose links are counted is cut into blocks of about so many classes and shingles; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes (int64) of the whole text: A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64).view(np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    h = sum((w[k : k + n] * MIX[k] for k in range(WORDS)), np.zeros(n, np.uint64))
    h = (h ^ (h >> np.uint64(29))) * MIX[1]
    h = (h ^ (h >> np.uint64(32))) * MIX[0]
    return np.unique((h ^ (h >> np.uint64(29))).view(np.int64))


def in_slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Arrow batches in smaller ones, so that a worker holds the sets of few documents at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def class_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set, as two signed longs: documents with equal sets are one class."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), ">i8").tolist())


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _r): _r names a row by its id and text, so rows without an id and ids with several texts are told apart."""
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_r"))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, a hash of id and text that names the row, the class key (hi, lo), n, and the prefix of the set in hash order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_slices(batches):
            sets = [shingles(t) for t in batch["_text"]]
            keys = [class_key(s) for s in sets]
            prefix = [s[: len(s) - (4 * len(s) + 4) // 5 + max(1, len(s) // EXTRA)] for s in sets]
            yield pd.DataFrame({"_id": batch["_id"], "_r": batch["_r"], "hi": [k[0] for k in keys], "lo": [k[1] for k in keys], "n": [len(s) for s in sets], "prefix": prefix})

    sent = named(docs, id_col, text_col).withColumn("_id", as_text("_id"))
    return sent.mapInPandas(run, "_id string, _r long, hi long, lo long, n long, prefix array<long>").withColumn("_id", F.col("_id").cast(kind_of(docs, id_col)))


def fragments(docs: DataFrame) -> DataFrame:
    """Rows (c, n, fragment, part, cells) of documents (_text): the set cut by ranges of the global order, and counts of finer ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([(-(1 << 63)) + k * ((1 << 64) // FRAGMENTS) for k in range(1, FRAGMENTS)], dtype=np.int64)
        for batch in in_slices(batches):
            rows = []
            for text in batch["_text"]:
                own = shingles(text)
                c = class_key(own)[1]
                place = (own.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - (FRAGMENTS * CELLS).bit_length() + 1)
                cells = np.bincount(place.astype(np.int64), minlength=FRAGMENTS * CELLS).reshape(FRAGMENTS, CELLS).astype(np.int32)
                rows += [(c, len(own), k, part, cells[k]) for k, part in enumerate(np.split(own, np.searchsorted(own, edges)))]
            yield pd.DataFrame(rows, columns=["c", "n", "fragment", "part", "cells"])

    return docs.mapInPandas(run, "c long, n long, fragment int, part array<long>, cells array<int>")


def can_link(a: str, b: str) -> Column:
    """Whether classes of n shingles, u of them found in no other class, can have Jaccard similarity of 0.8 at all."""
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.u"), F.col(f"{b}.n") - F.col(f"{b}.u"))
    return 9 * most >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted per fragment, summed per pair, 100 * common >= 80 * union."""
    left = pairs.join(parts.select(F.col("c").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("pa")), "a")
    both = left.join(parts.select(F.col("c").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("pb")), ["b", "fragment"])
    counted = both.select("a", "b", "fragment", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("common"))
    # Once per fragment, should a repeated row have brought its parts twice.
    once = counted.groupBy("a", "b", "fragment").agg(F.max("common").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    total = once.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return total.where(100 * F.col("common") >= 80 * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b", "common")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) connect each node with.

    Each round takes the smallest root among neighbours and then the root's own root, so long chains halve; it is
    written, and the loop ends when nothing changed. Only a yes or no comes to the driver.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    at = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(at.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        up = at.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        jump = at.select(F.col("node").alias("low"), F.col("root").alias("top"))
        new = scratch.keep(up.join(jump, "low", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("top", "low")).alias("root")), f"{name}-{step}")
        done = not new.where(F.col("old") != F.col("root")).take(1)
        scratch.drop(f"{name}-{step - 1}")
        at = new.select("node", "root")
        if done:
            scratch.drop(f"{name}-edges")
            return at


def overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common shingles of every set on the left with every set on the right."""
    a, b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    _, col = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    ca, cb = col[: len(a)], col[len(a) :]
    na, nb = np.bincount(ca, minlength=len(col)), np.bincount(cb, minlength=len(col))
    out = np.zeros((len(left), len(right)), np.int64)
    # Shingles of many sets by matrix products, a few columns at a time; the others pair by pair.
    dense = np.flatnonzero(na * nb * 16 >= len(left) * len(right))
    for at in range(0, len(dense), 1024):
        place = np.full(len(col), -1)
        place[dense[at : at + 1024]] = np.arange(len(dense[at : at + 1024]))
        x, y = (np.zeros((k, min(1024, len(dense) - at)), np.float32) for k in (len(left), len(right)))
        x[a[place[ca] >= 0], place[ca][place[ca] >= 0]] = 1
        y[b[place[cb] >= 0], place[cb][place[cb] >= 0]] = 1
        out += np.rint(x @ y.T).astype(np.int64)
    rest = (na > 0) & (nb > 0)
    rest[dense] = False
    a, ca = a[rest[ca]], ca[rest[ca]]
    order = np.argsort(cb, kind="stable")
    b, first = b[order], np.concatenate([[0], np.cumsum(nb)])
    for at in range(0, len(a), 4096):
        many = nb[ca[at : at + 4096]]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        np.add.at(out, (np.repeat(a[at : at + 4096], many), b[np.repeat(first[ca[at : at + 4096]], many) + step]), 1)
    return out


def block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """(c, linked): documents that each class of two blocks links with in the other one (or its own, where they are one block)."""
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    rows = rows.drop_duplicates(["c", "fragment"]).sort_values(["c", "fragment"])
    sides = [rows[rows["block"] == k] for k in (i, j)]
    one = [side.drop_duplicates("c") for side in sides]
    if not len(one[0]) or not len(one[1]):
        return pd.DataFrame({"c": np.zeros(0, np.int64), "linked": np.zeros(0, np.int64)})
    common = np.zeros((len(one[0]), len(one[1])), np.int64)
    for k in range(FRAGMENTS):
        common += overlap(*(list(side.loc[side["fragment"] == k, "part"]) for side in sides))
    na, nb = one[0]["n"].to_numpy()[:, None], one[1]["n"].to_numpy()[None, :]
    linked = 100 * common >= 80 * (na + nb - common)
    if i == j:
        np.fill_diagonal(linked, False)
    out = [(one[0]["c"], linked @ one[1]["size"].to_numpy())] + ([(one[1]["c"], linked.T @ one[0]["size"].to_numpy())] if i != j else [])
    return pd.DataFrame({"c": np.concatenate([c for c, _ in out]), "linked": np.concatenate([x for _, x in out])})


def link_counts(roots: DataFrame, parts: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, linked): for each class of a component, the documents of all other classes that it links with.

    Linked classes are in one component, so every pair of a component is compared, no pair of two. Components are cut
    into blocks by a hash, as many as their counted classes and shingles ask for, and each two blocks are a task of their
    own: overlaps per fragment, summed per pair. A component of two classes is one link.
    """
    own = roots.select(F.col("node").alias("c"), "root").join(sizes, "c")
    cut = own.groupBy("root").agg(F.count("*").alias("classes"), F.sum("size").alias("all"), F.sum("n").alias("shingles"))
    cut = cut.withColumn("blocks", F.greatest(F.ceil(F.col("classes") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
    placed = scratch.keep(own.join(cut, "root").withColumn("block", F.expr("cast(pmod(xxhash64(c), blocks) as int)")), "placed")
    two = placed.where("classes = 2").select("c", (F.col("all") - F.col("size")).alias("linked"))
    more = placed.where("classes > 2").select("c", "root", "size", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = more.select("c", "root", "size", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(parts.select("c", "n", "fragment", "part"), "c")
    found = dealt.groupBy("root", "i", "j").applyInPandas(block_links, "c long, linked long")
    return two.union(found).groupBy("c").agg(F.sum("linked").alias("linked"))


def links(docs: DataFrame, scratch: Scratch, sketch: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, roots, parts): pairs (a, b, common) of linked classes that connect every component, (node, root) of all linked
    classes, and the fragments of all classes that may link. Not all links: ``link_counts`` compares the pairs left out.

    Pairs whose classes are already connected are not compared, so a group of near copies costs its size times a few
    hubs. No pair that could connect two components is left out:

    1. Prefixes in hash order: shingles that two classes share are found with a pre-aggregated count; classes with too
       few of them in their prefix link with nothing.
    2. For what is left, whole sets: shingles of one class only count against it; the others are ordered by frequency,
       and the second prefix of that order gives candidate groups (classes that share a shingle).
    3. Members of a group are compared with its hubs, the ones with the fewest shingles of their own.
    4. All pairs of a group across components that bounds on their overlap allow are compared.
    """
    # One row speaks for each class, one with an id if there is any.
    one = F.min(F.struct(F.col("_id").isNull().alias("none"), "_r")).alias("one")
    classes = scratch.keep(sketch.where("n > 0").groupBy("lo").agg(one, F.max("n").alias("n")).select("lo", F.col("one._r").alias("_r"), "n"), "classes")
    rows = sketch.where("n > 0").select("_r", "lo", F.explode("prefix").alias("h"))
    shared = rows.groupBy("h").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).where("x <> y").select("h")
    hits = rows.select("h", "_r").join(shared, "h", "left_semi").groupBy("_r").agg(F.count("*").alias("k"))
    need = F.expr(f"greatest(1L, ((4 * n + 4) div 5) div {EXTRA})")
    # Repeated rows only add to their count, so none is lost.
    first = scratch.keep(hits.join(classes, "_r").where(F.col("k") >= need).select("_r").distinct(), "first")
    scratch.drop("sketch", "classes")

    few = first.count() <= BROADCAST_ROWS
    texts = named(docs, id_col, text_col).select("_r", "_text").join(F.broadcast(first) if few else first, "_r", "left_semi").dropDuplicates(["_r", "_text"]).select("_text")
    parts = scratch.keep(fragments(texts), "parts")
    every = parts.select("c", F.explode("part").alias("h"))
    df = every.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    common = scratch.keep(every.join(df, "h"), "common")
    size = parts.groupBy("c").agg(F.max("n").alias("n"))
    counted = common.groupBy("c").agg(F.count("*").alias("k")).join(size, "c")
    known = counted.where("k >= (4 * n + 4) div 5").select("c", "n", (F.col("n") - F.col("k")).alias("u"), F.expr("k - (4 * n + 4) div 5 + 1").alias("p"))
    ranked = common.join(known, "c").withColumn("r", F.expr("row_number() over (partition by c order by df, h)"))
    groups = scratch.keep(ranked.where("r <= p").select("h", "c", "n", "u", "r"), "groups")
    scratch.drop("common")

    hubs = groups.select("h", "c", "n", "u", F.expr("row_number() over (partition by h order by u / n, c)").alias("r")).where(F.col("r") <= HUBS)
    pairs = groups.alias("x").join(hubs.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & can_link("x", "y"))
    near = scratch.keep(verified(pairs.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct(), parts), "near")
    roots = scratch.keep(components(near, scratch, "roots"), "hub-roots")

    placed = groups.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("h", "c", "n", "u", F.coalesce("root", "c").alias("root"))
    sizes = placed.groupBy("h", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("h").agg(F.max(F.struct("size", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("h", F.col("m.root").alias("main"))
    split = placed.join(main, "h")
    heads = groups.where(F.col("r") <= HEAD).groupBy("c").agg(F.collect_set("h").alias("head"))
    counts = parts.groupBy("c").agg(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("fragment", "cells"))), lambda x: x["cells"])).alias("cells"))
    split = scratch.keep(split.join(heads, "c").join(counts, "c"), "split")
    others = split.where("root <> main")
    # A pair is taken up at the first shingle the beginnings of its second prefixes share, or wherever it is met if they
    # share none (the rows are made distinct), and only if its cells leave room for enough overlap.
    first_shared = F.coalesce(F.array_min(F.array_intersect("x.head", "y.head")) == F.col("x.h"), F.lit(True))
    most = F.aggregate(F.zip_with("x.cells", "y.cells", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    roomy = 9 * most >= 4 * (F.col("x.n") + F.col("y.n"))
    across = others.alias("x").join(split.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & can_link("x", "y") & first_shared & roomy)
    more = across.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
    last = scratch.keep(verified(more, parts), "last")
    found = near.union(last)
    roots = scratch.keep(components(found, scratch, "all"), "all-roots")
    scratch.drop("groups", "split", "first", "hub-roots")
    return found, roots, parts


def classes_of(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, classes, roots, parts): a key for each row, and (hi, lo, low, size, root) for each class of equal sets.

    low is the class's smallest row (none, _id, _r), those without an id last; root is shared by linked classes.
    """
    sketch = scratch.keep(sketches(docs, id_col, text_col), "sketch")
    rows = scratch.keep(sketch.select("_id", "_r", "hi", "lo", "n"), "keys")
    _, roots, parts = links(docs, scratch, sketch, id_col, text_col)
    low = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_r")).alias("low")
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(low, F.count("*").alias("size"))
    return rows, classes.join(roots.select(F.col("node").alias("lo"), "root"), "lo", "left").withColumn("root", F.coalesce("root", "lo")), roots, parts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, with_links: bool = False) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    with_links adds n_links, the other rows whose sets have a Jaccard similarity of 0.8 at least, copies included.
    Documents with the same set are one class (128-bit keys; candidates carry 64 of them). Texts with fewer than five
    words are one shingle; without words or text a document is empty, linked with nothing. Repeated rows each get a row;
    rows without an id link like others and take the smallest id of their component, or null where it has none; other
    columns are ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    rows, classes, roots, parts = classes_of(docs, id_col, text_col, scratch)
    n_links = F.lit(None).cast("long")
    if with_links:
        sizes = rows.where("n > 0").groupBy(F.col("lo").alias("c")).agg(F.count("*").alias("size"), F.max("n").alias("n"))
        counts = scratch.keep(link_counts(roots, parts, sizes, scratch), "counts")
        classes = classes.join(counts.select(F.col("c").alias("lo"), "linked"), "lo", "left")
        n_links = F.col("size") - 1 + F.coalesce("linked", F.lit(0))
    scratch.drop("parts", "placed")
    lows = classes.groupBy("root").agg(F.min("low").alias("least"))
    found = classes.join(lows, "root").select("hi", "lo", F.col("least._id").alias("component_id"), n_links.alias("n_links"))
    alone = rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = scratch.keep(rows.where("n > 0").join(found, ["hi", "lo"]).select("_id", "n", "component_id", "n_links").union(alone), "out")
    scratch.drop("keys", "near", "last", "all-roots", "counts")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *(["n_links"] if with_links else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest id; a group without ids keeps one row too.

    Rows are judged by their own text: an id that repeats with texts that are not linked keeps both. Texts without words
    link with nothing, and all their rows stay. Columns stay as they are.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    _, classes, _, _ = classes_of(docs, id_col, text_col, scratch)
    name = free_name(docs, "_r")
    kept = scratch.keep(classes.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low._r").alias(name)), "kept")
    scratch.drop("keys", "near", "last", "all-roots", "parts")
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    some = docs.where(worded).withColumn(name, F.xxhash64(id_col, text_col)).join(kept, name, "left_semi").dropDuplicates([name])
    return some.select(docs.columns).union(docs.where(~worded))


def oracle() -> str:
    """The same groups as DuckDB SQL: all pairs that share a shingle are counted, components by recursion (for small tables)."""
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda k: array_to_string(w[k : k + {WORDS} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
    n AS (SELECT doc_id, len(list_distinct(s)) AS n FROM g), s AS (SELECT DISTINCT doc_id, unnest(s) AS h FROM g),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
    degree AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
    SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach.b) AS component_id, coalesce(any_value(degree.n), 0)::BIGINT AS n_links FROM n JOIN reach ON reach.a = n.doc_id LEFT JOIN degree ON degree.a = n.doc_id GROUP BY n.doc_id, n.n"""
