import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evidentia.llm import ann, urls, warc

PAGES = "page_id long, url string, html string, record_type string, host string"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a/b c", "20010203040506", "text/html", "é\n\nx".encode()), ("http://b", "2001", "text/plain", b""), ("", "bad", "-", b"\n\n\n")]
    got = list(warc.read_arc(warc.arc_file(version, records)))
    assert [b for _, b in got] == [r[3] for r in records]
    assert got[0][0]["url"] == "http://a/b%20c" and warc.warc_date(got[0][0]["date"]) == "2001-02-03T04:05:06Z" and warc.warc_date("2001") == "2001-01-01T00:00:00Z" and warc.warc_date("x") == "1970-01-01T00:00:00Z"
    with pytest.raises(ValueError, match="fields"):
        list(warc.read_arc(b"http://a 1 2\nx"))
    with pytest.raises(ValueError, match="length"):
        list(warc.read_arc(b"http://a 0.0.0.0 2001 text/html 99\nx"))


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    long = "h" * 150
    rows = [(4, "http://x", long), (2, "http://y", long), (2, "http://y", long), (7, None, "é" * 40), (9, "u", "é" * 40), (5, "z", None), (6, "z", ""), (8, "w", "\r\n\r\nWARC/1.1" * 20), (None, "n", long)]
    df = spark.createDataFrame([(*r, "old", "h") for r in rows], PAGES).repartition(3)
    got = warc.round_trip(df, version).collect()
    assert len(got) == len(rows)
    for key, _, html in rows:
        body = (html or "").encode()
        own = [r for r in got if r.page_id == key and r.payload_digest == hashlib.sha256(body).hexdigest()]
        assert own and all(r.payload_bytes == len(body) for r in own)
        kind = "revisit" if key in (4, None) else "response"
        assert {(r.record_type, r.refers_to) for r in own} == {(kind, 2 if kind == "revisit" else None)}
        assert {None if r.payload is None else bytes(r.payload) for r in own} == {None if kind == "revisit" else body}
    assert len({r.record_id for r in got}) == len(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def strict(blob):
    """(fields, block) of each record of a .warc.gz file, by the letter of the format."""
    at = 0
    while at < len(blob):
        packer = zlib.decompressobj(31)
        record = packer.decompress(blob[at:])
        assert packer.eof
        at = len(blob) - len(packer.unused_data)
        head, gap, rest = record.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        assert first == "WARC/1.1" and gap and all(re.fullmatch(r"[A-Za-z-]+: [^\r\n]*", x) for x in lines)
        f = dict(x.split(": ", 1) for x in lines)
        assert len(f) == len(lines) and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= set(f)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", f["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"]) and re.fullmatch(r"[a-z]+/[a-z-]+(; [a-z-]+=[A-Za-z0-9-]+)?", f["Content-Type"])
        n = int(f["Content-Length"])
        block, tail = rest[:n], rest[n:]
        assert len(block) == n and tail == b"\r\n\r\n"
        if f["WARC-Type"] == "warcinfo":
            assert f["Content-Type"] == "application/warc-fields"
        else:
            assert re.match(r"[a-z]+:", f["WARC-Target-URI"])
        if f["WARC-Type"] in ("response", "revisit"):
            assert f["Content-Type"] == "application/http; msgtype=response" and block.startswith(b"HTTP/1.") and b"\r\n\r\n" in block
        if f["WARC-Type"] == "revisit":
            assert {"WARC-Profile", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"} <= set(f) and block.endswith(b"\r\n\r\n")
        if f["WARC-Type"] == "response":
            assert hashlib.sha256(block.split(b"\r\n\r\n", 1)[1]).hexdigest() == f["WARC-Payload-Digest"].split(":")[1]
        yield f, block


def test_a_strict_reader_takes_the_archives(spark, tmp_path):
    long, huge = "p" * 120, "é<p>\r\n\r\n" * 400000
    rows = [("a\r\nX-Evil: 1 %41", "http://x/ y", long), ("", "http://e", long), ("", "http://e", long), (None, None, "q"), (None, None, "q"), ("k", "http://k", huge), ("l", "http://l", huge), ("z", "http://z", None)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], PAGES.replace("page_id long", "page_id string"))
    warc.convert(df, f"file://{tmp_path}/out").collect()
    records = [x for f in sorted((tmp_path / "out").glob("*.warc.gz")) for x in strict(f.read_bytes())]
    assert len({f["WARC-Record-ID"] for f, _ in records}) == len(records)
    kinds = [f["WARC-Type"] for f, _ in records if f["WARC-Type"] != "warcinfo"]
    assert sorted(kinds) == ["response"] * 6 + ["revisit"] * 2 and not any("X-Evil" in f for f, _ in records)
    back = warc.read(spark, f"file://{tmp_path}/out").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.refers_to) for r in back), key=repr) == sorted(((k, len((h or "").encode()), "" if k and h == long else "k" if k == "l" else None) for k, _, h in rows), key=repr)


def test_existing_archives(spark, tmp_path):
    page = warc.http_message(b"<html>" + b"x" * 200, "text/html")
    for n, (version, packed) in enumerate([(1, False), (2, True)]):
        data = warc.arc_file(version, [("http://a/", "20010203040506", "text/html", page), ("dns:a", "20010203040506", "text/dns", b"20010203 a 1.2.3.4"), ("http://b/", "19991231235959", "text/html", page)])
        (tmp_path / f"{n}.arc{'.gz' * packed}").write_bytes(gzip.compress(data) if packed else data)
    warc.convert_archives(spark, f"file://{tmp_path}", f"file://{tmp_path}/out").collect()
    records = [x for f in (tmp_path / "out").glob("*.warc.gz") for x in strict(f.read_bytes())]
    assert len({f["WARC-Record-ID"] for f, _ in records}) == len(records)
    got = {r.key: r for r in warc.read(spark, f"file://{tmp_path}/out", "key").collect()}
    assert {k: (r.record_type, r.refers_to, r.date) for k, r in got.items()} == {
        "0.arc#0": ("response", None, "2001-02-03T04:05:06Z"), "0.arc#1": ("resource", None, "2001-02-03T04:05:06Z"), "0.arc#2": ("revisit", "0.arc#0", "1999-12-31T23:59:59Z"),
        "1.arc.gz#0": ("revisit", "0.arc#0", "2001-02-03T04:05:06Z"), "1.arc.gz#1": ("resource", None, "2001-02-03T04:05:06Z"), "1.arc.gz#2": ("revisit", "0.arc#0", "1999-12-31T23:59:59Z"),
    }
    assert bytes(got["0.arc#0"].payload) == page.split(b"\r\n\r\n", 1)[1] and got["0.arc#1"].url == "dns:a"


def test_url_contract(spark):
    def host(u):
        return re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", u.split("://", 1)[1])[0]) if u and "://" in u else ""

    def path(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        return re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0]

    def rule(h, p):
        fits = [(v, a + b) for v, a, b in urls.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return max(fits, key=lambda x: len(x[1]), default=(None, None))

    cases = ["http://WWW.Example.COM/en/1?x", "https://a.example.com/en/", "http://example.com/de/", "http://a.net/es/2#t", "http://net/fr/", "http://b.org/x/1", "ftp://xcom/", "nothing", "", None, "http://a.com", "http://a.com?q://z/y", "a://b://c/d", "http://é.net/es", "http://n.net/es/\nx", "http://com/"]
    rows = [(k, u, "", "", "clash") for k, u in enumerate(cases)] + [(0, cases[0], "", "", ""), (None, cases[5], "", "", "")]
    got = urls.filter_urls(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    for r in got:
        u = cases[5] if r.page_id is None else cases[r.page_id]
        v, name = rule(host(u), path(u))
        assert (r.host, r.path, r.rule) == (host(u), path(u), name), u
        assert r.verdict == (v or r.verdict) and r.verdict in ("allow", "block")
    assert urls.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_templates_generalise_and_reject(spark):
    rows = [(k, f"http://h.org/spam/item{k:05d}x/p.html", "", "", "") for k in range(60)] + [(100 + k, f"http://h.org/news/{k}", "", "", "") for k in range(60)]
    labels = spark.createDataFrame([(k, 1) for k in range(30)] + [(100 + k, 0) for k in range(30)] + [(None, 1)], "page_id long, bad int")
    out = urls.filter_urls(spark.createDataFrame(rows, PAGES), labels, rules=[])
    got = out.collect()
    assert {(r.template, r.verdict) for r in got} == {("/spam/*/p.html", "block"), ("/news/*", "allow")}
    assert urls.top_templates(spark.createDataFrame(got, out.schema)).count() == 2


def test_spam_hosts_and_deep_paths(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    spam = [f"http://win{h}.org/{r.choice(['bonus', 'play'])}/{word()}/a/b/c/{word()}/{word()}?x" for h in range(3) for _ in range(80)]
    fine = [f"http://ok{h}.org/{r.choice(['wiki', 'blog'])}/{word()}/a/b/c/{word()}" for h in range(3) for _ in range(80)]
    rows = [(k, u, "", "", "") for k, u in enumerate(spam + fine)]
    labels = spark.createDataFrame([(k, int(k < len(spam))) for k in range(0, len(rows), 4)], "page_id long, bad int")
    got = {x.page_id: x for x in urls.filter_urls(spark.createDataFrame(rows, PAGES), labels, rules=[]).collect()}
    assert all((got[k].verdict == "block") == (k < len(spam)) for k in got)
    assert all(x.template.endswith("/*/a/b/c/*/*" if x.page_id < len(spam) else "/*/a/b/c/*") for x in got.values()) and len({(x.host, x.template) for x in got.values()}) <= 12


def plain_tree(rows):
    """Templates and shares of (host, segments, bad or None) by a tree in memory, one level after the other, from the top."""
    paths = {}
    for host, segs, bad in rows:
        at = paths.setdefault((host, segs), [0, 0, 0])
        at[0], at[1], at[2] = at[0] + 1, at[1] + (bad is not None), at[2] + (bad or 0)
    now = {k: list(k[1]) for k in paths}

    def kids(level):
        out = {}
        for k, segs in now.items():
            if len(segs) > level:
                n, labelled, bad = paths[k]
                at = out.setdefault((k[0], tuple(segs[:level])), {}).setdefault(segs[level], [0, 0, 0, 0])
                for j, x in enumerate((n, labelled, bad, n * (len(segs) == level + 1))):
                    at[j] += x
        return out

    def rename(level, names):
        for k, segs in now.items():
            if len(segs) > level and (key := (k[0], tuple(segs[:level]), segs[level])) in names:
                segs[level] = names[key]

    depth = max(map(len, now.values()), default=0)
    for level in range(depth):
        names = {}
        for (host, head), own in kids(level).items():
            pages = sum(x[0] for x in own.values())
            light, single = sum(x[0] * urls.LIGHT_PART <= pages for x in own.values()), sum(x[0] == 1 for x in own.values())
            if len(own) > urls.MOST_CHILDREN and max(light, single) >= urls.LIGHT_SHARE * len(own):
                names |= {(host, head, s): urls.WILD for s in own}
        rename(level, names)
    for level in range(depth):
        names = {}
        for (host, head), own in kids(level).items():
            for side in range(3):
                group = {s: x for s, x in own.items() if (2 if not x[1] else 1 if 2 * x[2] >= x[1] else 0) == side}
                if len(group) < 2:
                    continue
                lead = max(group, key=lambda s: (group[s][0], s))
                n, labelled, bad, ended = group[lead]
                for s, x in group.items():
                    if s == lead:
                        continue
                    rate = (x[2] + bad) / max(x[1] + labelled, 1)
                    apart = abs(x[2] / max(x[1], 1) - bad / max(labelled, 1)) > urls.SIMILAR_Z * (rate * (1 - rate) * (1 / max(x[1], 1) + 1 / max(labelled, 1))) ** 0.5
                    bound = (x[0] ** -0.5 + n**-0.5) * (np.log(2 / urls.SIMILAR_ALPHA) / 2) ** 0.5
                    if not apart and abs(x[3] / x[0] - ended / n) <= bound:
                        names[host, head, s] = names[host, head, lead] = lead + urls.MERGED
        rename(level, names)
    leaf, hosts, total, under = {}, {}, [0, 0], {}
    for k, segs in now.items():
        above = [under.setdefault((k[0], tuple(segs[:j])), [0, 0]) for j in range(1, len(segs) + 1)]
        for at in (leaf.setdefault((k[0], tuple(segs)), [0, 0]), hosts.setdefault(k[0], [0, 0]), total, *above):
            at[0] += paths[k][1]
            at[1] += paths[k][2]
    base = total[1] / total[0] if total[0] else 0
    share = {}
    for k, segs in now.items():
        labelled, bad = leaf[k[0], tuple(segs)]
        rate = (hosts[k[0]][1] + urls.PRIOR_PAGES * base) / (hosts[k[0]][0] + urls.PRIOR_PAGES)
        for j in range(1, len(segs)):
            n, b = under[k[0], tuple(segs[:j])]
            rate = (b + urls.PRIOR_PAGES * rate) / (n + urls.PRIOR_PAGES)
        share[k] = "/" + "/".join(s.replace(urls.MERGED, "|...") for s in segs), labelled, (bad + urls.PRIOR_PAGES * rate) / (labelled + urls.PRIOR_PAGES)
    return share


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_a_plain_one(spark, seed):
    r = random.Random(seed)
    word = lambda n: r.choice("abcdefghijklmnop"[:n]) * 3
    rows = []
    for k in range(900):
        host = f"h{r.randrange(3)}.org"
        tail = r.choice([[], [word(3)], [word(16) + word(16)], [word(16) + word(16), "end"], [word(2), word(16) + word(16), word(16) + word(4), word(2)]])
        rows.append((k, f"http://{host}/" + "/".join([word(4), *tail, *(["deep"] * r.choice([0, 0, 0, 12]))]), "", "", ""))
    rows += [(5000, None, "", "", ""), (5001, "http://h0.org", "", "", ""), (None, rows[0][1], "", "", "")]
    labels = [(k, int(r.random() < (0.8 if "/aaa/" in u or "/bbb" in u else 0.1))) for k, u, *_ in rows[:900] if r.random() < 0.4]
    known = dict(labels)
    got = urls.filter_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, "page_id long, bad int"), rules=[]).collect()
    cut = lambda u: (u.split("/")[2], tuple(x for x in u.split("/")[3:] if x)) if u else ("", ())
    want = plain_tree([(*cut(u), known.get(k)) for k, u, *_ in rows])
    by = {k: u for k, u, *_ in rows}
    assert len(got) == len(rows)
    for x in got:
        template, labelled, share = want[cut(by[x.page_id])]
        assert (x.template, x.labelled, x.verdict) == (template, labelled, "block" if share >= urls.REJECT_FROM else "allow") and abs(x.bad_share - share) < 1e-8
    assert {x.verdict for x in got} == {"allow", "block"} and any("|..." in x.template for x in got) and any("*" in x.template for x in got)


def test_unlabelled_templates_follow_their_nearest_labelled_ancestor(spark):
    rows = [(k, f"http://h.org/a/x/{'p' if k % 2 else 'q'}", "", "", "") for k in range(40)] + [(100 + k, f"http://h.org/b/{'p' if k % 2 else 'q'}", "", "", "") for k in range(40)]
    labels = spark.createDataFrame([(k, 1) for k in range(1, 40, 2)] + [(100 + k, 0) for k in range(1, 40, 2)], "page_id long, bad int")
    got = {x.page_id: x.verdict for x in urls.filter_urls(spark.createDataFrame(rows, PAGES), labels, rules=[]).collect()}
    assert got == {k: "block" if k < 100 else "allow" for k in got}


def test_labels_by_shared_text(spark):
    line = lambda k: f"line number {k} of a text that is long enough to be looked for"
    docs = spark.createDataFrame([(1, line(1) + "\n" + line(9)), (2, line(2) + "\nshort\n" + line(9)), (3, line(3)), (4, None), (None, line(1))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 1), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    pages = [(1, f"<html><p>{line(1)}</p></html>"), (2, f"<div>{line(2)}<br/>{line(2)}</div>"), (3, f"<script>{line(1)}</script><p>{line(3)}</p>"), (4, "<p>short</p>"), (5, None), (None, f"<p>{line(1)}</p>"), (6, f"<p>{line(7)}"), (7, f"<p>{line(2)}</p><p>{line(1)}</p><p><b>{line(3)}</b></p>")]
    got = urls.labels_by_text(spark.createDataFrame(pages, "page_id long, html string"), docs, labels).collect()
    assert {(r.page_id, r.bad) for r in got} == {(1, 1), (2, 0), (3, 1), (7, 1)}


VECTORS = "vec_id long, embedding array<float>, score string"


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[50] = x[40] = x[30]
    rows = [(k, v.tolist(), "s") for k, v in enumerate(x)] + [(2000, None, ""), (2020, [0.0] * 16, ""), (2040, [float("nan")] * 16, ""), (2060, [None] * 16, ""), (2080, [1.0], ""), (20, x[20].tolist(), ""), (None, x[1].tolist(), "")]
    df = spark.createDataFrame(rows, VECTORS)
    ask = df.where("vec_id % 20 = 0")
    got = ann.search(df, ask, k=20, probes=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    # The shorter vector counts as filled up with zeros.
    own = {k: v.astype(float) for k, v in enumerate(x)} | {2080: np.eye(16)[0]}
    assert set(by) == {*range(0, 900, 20), 2080}
    for q, found in by.items():
        found.sort()
        s = {k: v @ own[q] for k, v in own.items()}
        want = sorted((k for k in own if k != q), key=lambda k: (-s[k], k))[:20]
        assert [v for _, v, _ in found] == want and [r for r, _, _ in found] == list(range(1, 21))
        assert np.allclose([c for _, _, c in found], [s[k] for k in want], rtol=0, atol=1e-12)
    assert ann.recall(ann.search(df, ask), df, ask) >= 0.9


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=3 + k % 2)], "") for k in range(60)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, df.where("vec_id % 20 = 0"), k=5, probes=8).collect())
    s = lambda a, b: sum(c * d for c, d in zip(rows[a][1], rows[b][1], strict=False))
    want = [(q, r + 1, k) for q in range(0, 60, 20) for r, k in enumerate(sorted((k for k in range(60) if k != q), key=lambda k: (-s(q, k), k))[:5])]
    assert got == want


def test_blocks_of_a_hot_partition_are_keys_of_their_own(spark, monkeypatch):
    """One partition holds all vectors; the search's join is keyed by partition and block, and gives the same rows."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, [1.0 + float(c) for c in rng.normal(size=4) * 0.01], "") for k in range(300)], VECTORS)
    ask = df.where("vec_id % 20 = 0")
    want = sorted(map(tuple, ann.search(df, ask, probes=8).collect()))
    monkeypatch.setattr(ann, "BLOCK", 16)
    out = ann.search(df, ask, probes=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in x and "part" in x and "block" in x.split("q_block")[0] for x in plan.split("\n"))
    assert sorted(map(tuple, out.collect())) == want


def test_search_of_little(spark):
    none = spark.createDataFrame([], VECTORS)
    assert ann.search(none, none).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.0, 1.0], "")], VECTORS)
    assert [tuple(r) for r in ann.search(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.0)]


def test_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0], ""), (0, [0.0, 2.0], ""), (1, [0.5, 0.0], ""), (1, [9.0, 0.0], ""), (2, [3.0, 0.0], ""), (2, [3.0, 0.0], ""), (3, [0.0, 1.0], "")]
    df = spark.createDataFrame(rows, VECTORS)
    got = [tuple(r) for r in ann.search(df, df.where("vec_id = 0"), k=2).collect()]
    assert sorted(got) == [(0, 1, 1, 9.0), (0, 2, 2, 3.0)]
    assert ann.recall(ann.search(df, df.where("vec_id = 0"), k=2), df, df.where("vec_id = 0"), k=2) == 1


def test_balanced_cut():
    x = np.concatenate([np.random.default_rng(k).normal(c, 0.05, (50, 2)) for k, c in enumerate([(1, 0), (0, 1), (-1, 0), (0, -1)])])
    part = ann.balanced_cut(ann.neighbour_graph(x, 10), 4)
    assert np.bincount(part, minlength=4).max() <= 53
    assert sum(len(set(part[k * 50 : k * 50 + 50].tolist())) for k in range(4)) <= 7
