"""Personal data: regex, gazetteer and context labelers vote on spans; EM weighs the labelers; a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. The method adds spans of other kinds
(``secret``: keys and tokens; ``contact``: addresses and numbers in spelled-out or local forms).

Labelers vote for, against or not at all. How far each is to be trusted is estimated by expectation-maximisation from how
they agree over the whole corpus. The labels that follow train the final classifier, which does not see the votes: it reads
the span itself (length, entropy, classes of characters) and what stands around it, so it also decides where labelers abstain.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch, as_text, kind_of

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["secret", "contact"]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidate spans of the method: patterns that alone prove nothing.
CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])"),
    "contact": re.compile(r"(?<![A-Za-z0-9._%+@-])(?:[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9.-]{1,64} ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z]{2,12}|\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4})(?![A-Za-z0-9@-])"),
}
#: Words that the gazetteer labeler looks for just before a span, and words around it that speak of contact or access.
GAZETTEER = ["token", "secret", "password", "passwd", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "auth", "bearer", "email", "e-mail", "mail", "phone", "tel", "mobile", "fax", "call", "contact"]
CONTEXT = re.compile(r"(?:[=:]\s*[\"']?|[\"'])$")
NEAR = 24
#: Votes: 0 abstains, 1 against, 2 for. Prior share of true spans, and rounds of expectation-maximisation.
LABELERS = ["regex", "gazetteer", "context", "shape"]
ROUNDS, PRIOR = 25, 0.5
KEEP_FROM = 0.5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kinds as listed, then by start. Linear in the text: no pattern restarts inside a run."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, int, int, int]:
    """Each labeler's vote (see LABELERS) on a candidate; it sees the span and NEAR characters before it."""
    span, before = text[start:end], text[max(0, start - NEAR) : start]
    low = before.lower()
    named = 2 if any(x in low for x in GAZETTEER) else 0
    context = 2 if CONTEXT.search(before) else 1 if re.search(r"[A-Za-z][.,]? $", before) else 0
    if kind == "secret":
        digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
        regex = 2 if re.fullmatch(r"[0-9a-f]{32,128}|(?:sk|pk|ghp|AKIA)[A-Za-z0-9_-]{12,}", span) else 1 if not digits or not letters else 0
        mixed = len(set(span)) >= 10 and digits >= 4 and letters >= 4
        return regex, named, context, 2 if mixed else 1
    regex = 2 if re.search(r"(?i)[\[(]at[\])]", span) else 0
    return regex, named, context, 2 if sum(c.isdigit() for c in span) == 10 or regex else 1


#: Features of a span for the final classifier and how many values each has; together they bound what is counted.
FEATURES = {"length": 6, "entropy": 5, "digits": 5, "upper": 3, "signs": 3, "runs": 3, "before": 4, "after": 2, "line": 2}
WORD_BEFORE = re.compile(r"[A-Za-z][A-Za-z0-9_-]*(?=[\s\"'=:>(]*$)")


def shape(text: str, start: int, end: int) -> tuple[int, ...]:
    """The values of FEATURES for a span."""
    span, before = text[start:end], text[max(0, start - NEAR) : start]
    n = end - start
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(span).values())
    digits, upper, signs = (sum(map(f, span)) / n for f in (str.isdigit, str.isupper, lambda c: not c.isalnum()))
    runs = sum(x.isalpha() and x.isascii() and (x.islower() or x.isupper() or x.istitle()) for x in re.split(r"[^A-Za-z]+", span) if len(x) > 3)
    named = WORD_BEFORE.search(before)
    assigned = 2 if before.rstrip(" \"'")[-1:] in ("=", ":") else 1 if before[-1:] in ("\"", "'") else 0
    return (
        min(5, int(math.log2(n / 8) * 2) if n > 8 else 0), min(4, int(entropy)), min(4, int(digits * 8)), 0 if upper < 0.05 else 1 if upper < 0.8 else 2, 0 if not signs else 1 if signs < 0.15 else 2, min(2, runs),
        min(3, assigned + (any(x in named[0].lower() for x in GAZETTEER) if named else 0)), int(text[end : end + 1] in ("\"", "'")), int("\n" not in before and start - NEAR > 0),
    )


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, votes, shape) of candidate spans outside base spans; votes and shape are strings of digits."""
    edges: list[list[int]] = []  # base spans as disjoint intervals
    for a, b in sorted((a, b) for _, a, b in base):
        if edges and a <= edges[-1][1]:
            edges[-1][1] = max(edges[-1][1], b)
        else:
            edges.append([a, b])
    starts, out = [a for a, _ in edges], []
    for kind, pattern in CANDIDATES.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            k = bisect_left(starts, b) - 1
            if k < 0 or edges[k][1] <= a:
                out.append((kind, a, b, "".join(map(str, votes(kind, text, a, b))), "".join(map(str, shape(text, a, b)))))
    return out


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = ROUNDS, prior: float = PRIOR) -> dict[tuple[str, str], float]:
    """P(true span) for each (kind, votes) pattern from its counts over the corpus, by expectation-maximisation.

    Every kind has its own labeler tables P(vote | true), P(vote | false) and share of true spans, all smoothed. The
    start is a majority of votes, so that class 1 means "personal".
    """
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = sorted((v, n) for k, v, n in patterns if k == kind)
        vote, count = np.array([[int(c) for c in v] for v, _ in own]), np.array([n for _, n in own], dtype=float)
        score = (vote == 2).sum(axis=1) - (vote == 1).sum(axis=1)
        p = 1 / (1 + np.exp(-1.5 * (score - 0.5)))
        for _ in range(rounds):
            share = (np.dot(p, count) + 10 * prior) / (count.sum() + 10)
            table = np.empty((2, vote.shape[1], 3))
            for y, weight in enumerate(((1 - p) * count, p * count)):
                for k in range(3):
                    table[y, :, k] = (weight @ (vote == k) + 1 + 3 * (k == (1, 2)[y])) / (weight.sum() + 6)
            odds = np.log(share / (1 - share)) + sum(np.log(table[1, j, vote[:, j]] / table[0, j, vote[:, j]]) for j in range(vote.shape[1]))
            p = 1 / (1 + np.exp(-odds))
        out |= {(kind, v): float(x) for (v, _), x in zip(own, p, strict=True)}
    return out


def fit(patterns: list[tuple[str, str, str, int]], steps: int = 100, l2: float = 1e-3) -> dict[tuple[str, str], float]:
    """The final span classifier as a table of its outputs: P(personal) for each (kind, shape).

    patterns are (kind, votes, shape, count) over the corpus. EM on the votes gives each pattern its label; logistic
    regression on the shape's values, one for each kind, learns the labels with the counts as weights.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, *_ in patterns}):
        own = [(v, s, n) for k, v, s, n in patterns if k == kind]
        by_votes: Counter[str] = Counter()
        for v, _, n in own:
            by_votes[v] += n
        label = reliabilities([(kind, v, n) for v, n in by_votes.items()])
        shapes = sorted({s for _, s, _ in own})
        at = {s: k for k, s in enumerate(shapes)}
        x = np.concatenate([np.ones((len(shapes), 1)), *(np.array([[float(s[j] == str(c)) for c in range(width)] for s in shapes]) for j, width in enumerate(FEATURES.values()))], axis=1)
        good, n = np.zeros(len(shapes)), np.zeros(len(shapes))
        for v, s, c in own:
            good[at[s]] += c * label[kind, v]
            n[at[s]] += c
        y, w, beta = good / n, n / n.sum(), np.zeros(x.shape[1])
        for _ in range(steps):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(len(beta)), x.T @ (w * (y - p)) - l2 * beta)
            beta += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        out |= {(kind, s): float(v) for s, v in zip(shapes, 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), strict=True)}
    return out


SPAN = "struct<kind:string,start:int,end:int>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs: its id, base (array of base spans) and added (array of the method's spans with probabilities).

    One pass over the texts writes base and candidate spans (never texts) to the shared folder; the counts of vote
    and shape patterns over all documents (bounded by the number of values each can have, whatever the corpus) go to the driver, where EM and the
    classifier are fitted; a second pass over the spans alone applies the result. Null text counts as empty; repeated
    rows and null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, found = [], []
            for text in batch["_text"]:
                own = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                found.append([{"kind": k, "start": a, "end": b, "votes": v, "shape": s} for k, a, b, v, s in candidates(text, own)])
            yield pd.DataFrame({"_id": batch["_id"], "base": base, "found": found})

    texts = docs.select(as_text(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    spans = scratch.keep(texts.mapInPandas(run, f"_id string, base array<{SPAN}>, found array<struct<kind:string,start:int,end:int,votes:string,shape:string>>"), "spans")
    patterns = spans.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes", "f.shape").count().collect()
    model = fit([tuple(r) for r in patterns])
    return spans.select(F.col("_id").cast(kind_of(docs, id_col)).alias(id_col), "base", decide(F.col("found"), model).alias("added"))


def decide(found: Column, model: dict[tuple[str, str], float]) -> Column:
    """The candidates whose shape the model takes for personal, with p."""
    good = {f"{k}:{s}": p for (k, s), p in model.items() if p >= KEEP_FROM}
    if not good:
        return F.expr("cast(array() as array<struct<kind:string,start:int,end:int,p:double>>)")
    table = F.create_map(*(F.lit(x) for pair in sorted(good.items()) for x in pair))
    p = lambda f: F.try_element_at(table, F.concat_ws(":", f["kind"], f["shape"]))
    return F.transform(F.filter(found, lambda f: p(f).isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"), p(f).alias("p")))


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, base_sha256 and spans (all of them as kind:start:end, by kind, then start)."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = lambda s, k: F.filter(s, lambda x: x["kind"] == k)
    added = F.concat(*(order(plain, k) for k in ADDED))
    return found.select(
        id_col,
        *(F.size(order("base", k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat(F.col("base"), added)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of ``find`` replaced by its kind in angle brackets; n_chars, if present, follows the new text.

    All columns and rows stay (also repeated rows and null ids: the spans are found from the text itself, in the same
    task that replaces them). The model is fitted as in ``find``. Where spans overlap, the one that starts first (then
    the longest) is replaced. Null texts stay null.
    """
    def candidates_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter((k, v, s) for text in batch["_text"] for k, _, _, v, s in candidates(text, base_spans(text)))
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "votes", "shape", "n"])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text"))
    patterns = texts.mapInPandas(candidates_only, "kind string, votes string, shape string, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    model = fit([tuple(r) for r in patterns])
    good = {k for k, p in model.items() if p >= KEEP_FROM}

    def mask(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = base + [(k, a, b) for k, a, b, _, s in candidates(text, base) if (k, s) in good]
        if not spans:
            return text
        out, at = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{k}>"]
                at = b
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return text.map(mask)

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def brute_force(text: str | None) -> tuple[int, int, int, int, str]:
    """The base contract by its patterns as written, for tests."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    count = [sum(k == x for k, _, _ in out) for x in KINDS]
    return (*count, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in out).encode()).hexdigest())
