"""URL filter by path templates: a per-host tree of path segments, generalised, merged and judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch

#: The rules of the query's contract, (verdict, host, path prefix).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: A branch point with more distinct segments than MOST_CHILDREN, of which at least a share of LIGHT_SHARE have less than
#: 1/LIGHT_PART of its pages each, is variable: its segments become a wildcard.
MOST_CHILDREN, LIGHT_PART, LIGHT_SHARE = 8, 50, 0.9
#: Branches are merged unless their shares of bad pages differ beyond the 95 % of a two-sided normal test, or the shares of pages
#: that end at them beyond Hoeffding's bound at that level.
SIMILAR_Z, SIMILAR_ALPHA = 1.96, 0.05
#: Smoothing: a template counts the rate of the branch above it as so many labelled pages, a host that of all pages; a template
#: is rejected from this smoothed share of bad ones.
PRIOR_PAGES, REJECT_FROM = 4.0, 0.5

#: Characters of a line that is looked for in other texts.
LINE = 40

WILD = "*"
#: A merged branch is named by its leader and this sign, which no path segment can hold (shown as "leader|...").
MERGED = "/+"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([(v, h, p, h + p) for v, h, p in rules], "rule_verdict string, rule_host string, rule_path string, rule string")


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (with host, path) plus rule and rule_verdict of the longest rule that fits, else nulls.

    The rules are a short list of parameters and so part of the expression: hosts match whole or below a dot, paths by prefix.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # longest last, so that it stands outermost
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def segments(path: Column) -> Column:
    """Path segments, plainly variable ones (numbers, hex, dates, long mixed ids) as wildcards that keep their suffix."""
    cut = F.filter(F.split(path, "/"), lambda s: s != "")
    number = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|(?=[^/]*[0-9])[A-Za-z0-9_-]{16,})(\.[A-Za-z]{1,5})?$"
    return F.transform(cut, lambda s: F.when(s.rlike(number), F.concat(F.lit(WILD), F.regexp_extract(s, number, 1))).otherwise(s))


def nodes(tree: DataFrame) -> DataFrame:
    """(host, path, level, head, seg, ...): a row for each segment of each path; head is the hash of what precedes it, path that of the raw path."""
    heads = F.aggregate("segs", F.array(F.lit(0).cast("long")), lambda acc, s: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), s))))
    each = tree.withColumn("heads", heads).select("*", F.posexplode("segs").alias("level", "seg"))
    return each.select("host", F.xxhash64("raw").alias("path"), "n", "labelled", "bad", "level", F.get("heads", F.col("level")).alias("head"), "seg", (F.size("segs") == F.col("level") + 1).alias("ends"))


def branches(tree: DataFrame) -> DataFrame:
    """(host, head, seg, n, labelled, bad, ended): counts of every branch of every host's tree, pre-aggregated."""
    return nodes(tree).groupBy("host", "head", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0)).alias("ended"))


def rewritten(tree: DataFrame, change: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """tree with the first segment of each path that change (host, head, seg, new) names replaced; column changed says where."""
    hits = nodes(tree).join(change, ["host", "head", "seg"]).groupBy("host", "path").agg(F.min(F.struct("level", "new")).alias("hit"))
    joined = tree.withColumn("path", F.xxhash64("raw")).join(hits, ["host", "path"], "left")
    at = F.col("hit.level")
    segs = F.when(at.isNotNull(), F.transform("segs", lambda s, k: F.when(k == at, F.col("hit.new")).otherwise(s))).otherwise(F.col("segs"))
    return scratch.keep(joined.select("host", "raw", "n", "labelled", "bad", segs.alias("segs"), at.isNotNull().alias("changed")), name)


def variable(tree: DataFrame) -> DataFrame:
    """(host, head, seg, new): all segments of variable branch points (one that is a wildcard already waits for the others)."""
    own = branches(tree)
    total = own.groupBy("host", "head").agg(F.sum("n").alias("pages"))
    light = own.join(total, ["host", "head"]).groupBy("host", "head").agg(F.count("*").alias("kids"), F.sum((F.col("n") * LIGHT_PART <= F.col("pages")).cast("int")).alias("light"), F.max("pages").alias("pages"))
    # Few pages cannot show small shares; there, most segments must have a single page.
    single = own.groupBy("host", "head").agg(F.sum((F.col("n") == 1).cast("int")).alias("single"))
    wide = light.join(single, ["host", "head"]).where((F.col("kids") > MOST_CHILDREN) & (F.greatest("light", "single") >= LIGHT_SHARE * F.col("kids")))
    return own.join(wide.select("host", "head"), ["host", "head"]).select("host", "head", "seg", F.lit(WILD).alias("new"))


def similar(tree: DataFrame) -> DataFrame:
    """(host, head, seg, new): branches to be merged with a leader among their siblings, and the leaders themselves.

    Siblings fall into three sides: most labelled pages bad, most good, none labelled. The side's leader is its branch
    with the most pages (ties: the smallest name). Others join it unless they differ from it beyond chance in their share
    of bad pages or in the share of pages that end at them. A branch point merges once.
    """
    own = branches(tree)
    done = own.groupBy("host", "head").agg(F.max(F.endswith("seg", F.lit(MERGED))).alias("done")).where("not done").select("host", "head")
    own = own.join(done, ["host", "head"]).withColumn("side", F.when(F.col("labelled") == 0, 2).when(2 * F.col("bad") >= F.col("labelled"), 1).otherwise(0))
    lead = own.groupBy("host", "head", "side").agg(F.max_by(F.struct("seg", "n", "labelled", "bad", "ended"), F.struct("n", F.col("seg"))).alias("l"), F.count("*").alias("kids")).where("kids > 1")
    pair = own.join(lead, ["host", "head", "side"]).where(F.col("seg") != F.col("l.seg"))
    one = F.lit(1)
    rate = (F.col("bad") + F.col("l.bad")) / F.greatest(F.col("labelled") + F.col("l.labelled"), one)
    deviation = F.sqrt(rate * (1 - rate) * (1 / F.greatest("labelled", one) + 1 / F.greatest(F.col("l.labelled"), one)))
    apart = F.abs(F.col("bad") / F.greatest("labelled", one) - F.col("l.bad") / F.greatest(F.col("l.labelled"), one)) > SIMILAR_Z * deviation
    bound = (1 / F.sqrt("n") + 1 / F.sqrt("l.n")) * F.sqrt(F.log(F.lit(2 / SIMILAR_ALPHA)) / 2)
    shaped = F.abs(F.col("ended") / F.col("n") - F.col("l.ended") / F.col("l.n")) <= bound
    joined = pair.where(~apart & shaped).select("host", "head", "seg", F.concat("l.seg", F.lit(MERGED)).alias("new"), F.col("l.seg").alias("to"))
    return joined.select("host", "head", "seg", "new").union(joined.select("host", "head", F.col("to").alias("seg"), "new").distinct())


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, raw, segs, n, labelled, bad): distinct paths (host, segs, bad) of pages with the template each has in its host's tree.

    Every level of every path is a branch point. A round takes the shallowest change of each path, since deeper branch
    points depend on it; rounds end when nothing changes, so there are as many as changes on one path, whatever the
    depth. First variable branch points become wildcards, then similar branches merge, top down. Work is on distinct
    (host, path) rows and pre-aggregated counts; each round is written and only a yes or no comes to the driver.
    """
    tree = pages.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = scratch.keep(tree.select("host", F.col("segs").alias("raw"), "n", "labelled", "bad", "segs", F.lit(True).alias("changed")), "tree-0")
    step = 0
    for change in (variable, similar):
        while True:
            step += 1
            tree = rewritten(tree, change(tree), scratch, f"tree-{step}")
            scratch.drop(f"tree-{step - 1}")
            if not tree.where("changed").take(1):
                break
    return tree


def smoothed(bad: Column, labelled: Column, rate: Column) -> Column:
    return (bad + PRIOR_PAGES * rate) / (labelled + PRIOR_PAGES)


def judged(tree: DataFrame) -> DataFrame:
    """(host, segs, labelled, bad_share) of every template.

    A template's share of bad pages is smoothed towards that of the branch above it, this one towards the next, and so on to its
    host's, which is smoothed towards that of all pages: without labelled pages a template is judged by its nearest labelled ancestor.
    """
    leaf = tree.groupBy("host", "segs").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).withColumn("key", F.xxhash64("segs"))
    hosts = leaf.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    base = F.coalesce(F.col("all_bad") / F.nullif(F.col("all_labelled"), F.lit(0)), F.lit(0.0))
    total = hosts.agg(F.sum("host_labelled").alias("all_labelled"), F.sum("host_bad").alias("all_bad"))
    heads = F.transform(F.sequence(F.lit(1), F.size("segs")), lambda k: F.xxhash64(F.slice("segs", F.lit(1), k)))
    every = leaf.where(F.size("segs") > 0).select("host", "key", "labelled", "bad", F.size("segs").alias("own"), F.posexplode(heads).alias("level", "head"))
    counts = every.groupBy("host", "head").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    chain = every.where(F.col("level") < F.col("own") - 1).join(counts, ["host", "head"]).groupBy("host", "key").agg(F.array_sort(F.collect_list(F.struct("level", "l", "b"))).alias("chain"))
    # total is one row of two numbers.
    out = leaf.join(hosts, "host").crossJoin(F.broadcast(total)).join(chain, ["host", "key"], "left")
    host_rate = smoothed(F.col("host_bad"), F.col("host_labelled"), base)
    down = F.coalesce(F.aggregate("chain", host_rate, lambda r, x: smoothed(x["b"], x["l"], r)), host_rate)
    return out.select("host", "segs", "labelled", smoothed(F.col("bad"), F.col("labelled"), down).alias("bad_share"))


def lines_of(html: Column) -> Column:
    """Hashes of the distinct lines of LINE characters or more of a page's visible text, or of a plain text."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?i)<(br|/?(p|div|li|td|tr|h[1-6]|title|ul|table))\b[^>]*>", "\n")
    cut = F.transform(F.split(F.regexp_replace(plain, "<[^>]*>", ""), "\n"), F.trim)
    return F.array_distinct(F.transform(F.filter(cut, lambda x: F.length(x) >= LINE), lambda x: F.xxhash64(x)))


def labels_by_text(pages: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "page_id", html_col: str = "html", doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, bad 0/1) of the pages that share lines with labelled documents: bad where at least half of what they share is with bad ones.

    labels has (doc_id, quality, toxic); a document is bad if its quality is 0 or it is toxic. A line that n documents hold
    counts 1/n for each of them, so lines that many share say little. Lines are counted before they meet pages; no pair of a page
    and a document is made. Pages without an id or without such lines have no label.
    """
    # explode_outer: a plain explode would make the optimizer test the arrays first and so cut every text twice.
    own = docs.select(F.col(doc_col).alias("_d"), F.explode_outer(lines_of(F.col(text_col))).alias("_h")).where("_h is not null")
    one = labels.groupBy(F.col(doc_col).alias("_d")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("_bad"))
    counts = own.join(one, "_d", "left").groupBy("_h").agg(F.count("*").alias("_n"), F.count("_bad").alias("_l"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("_b")).where("_l > 0")
    met = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_p"), F.explode_outer(lines_of(F.col(html_col))).alias("_h")).join(counts, "_h")
    share = F.sum(F.col("_b") / F.col("_n")) / F.sum(F.col("_l") / F.col("_n"))
    return met.groupBy("_p").agg((share >= 0.5).cast("int").alias("bad")).select(F.col("_p").alias(id_col), "bad")


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", label_col: str = "bad", scratch: Scratch | None = None) -> DataFrame:
    """Per row of pages: id, host, path, rule (or null), verdict (allow or block), template, labelled (pages of it) and bad_share.

    labels has (id, bad 0/1) for some pages, see ``labels_by_text``. Pages that a rule decides also count as labelled, by the rule's
    verdict, where labels says nothing. A fitting rule decides (the longest wins); else the page's template is blocked where its
    smoothed share of bad pages, or without labelled pages that of its nearest labelled ancestor, reaches REJECT_FROM.
    Null urls and urls without :// have empty host and path and form a host of their own; repeated rows are judged
    alike; null ids are kept and count as unlabelled; a page with several labels counts as bad if one says so; other
    columns are ignored, also those named like results; an empty table gives no rows.
    """
    base = with_rule(pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")), rules).withColumn("segs", segments(F.col("path")))
    if labels is not None:
        one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("long").alias("_bad"))
        base = base.join(one, "_id", "left")
    else:
        base = base.withColumn("_bad", F.lit(None).cast("long"))
    base = base.withColumn("bad", F.coalesce("_bad", F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)))
    tree = templates(base, scratch or Scratch(pages.sparkSession, "urls"))
    paths = tree.select("host", "raw", "segs").join(judged(tree), ["host", "segs"]).select("host", F.col("raw").alias("segs"), F.col("segs").alias("template"), "labelled", "bad_share")
    out = base.join(paths, ["host", "segs"], "left")
    learned = F.when(F.col("bad_share") >= REJECT_FROM, "block").otherwise("allow")
    template = F.concat(F.lit("/"), F.array_join(F.transform("template", lambda s: F.replace(s, F.lit(MERGED), F.lit("|..."))), "/"))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"), template.alias("template"), "labelled", F.round("bad_share", 9).alias("bad_share"))


def top_templates(judged_pages: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent templates of each verdict, a report."""
    n = judged_pages.groupBy("verdict", "host", "template").agg(F.count("*").alias("pages"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("verdict").orderBy(F.desc("pages"), "host", "template"))).where(F.col("rank") <= k)
