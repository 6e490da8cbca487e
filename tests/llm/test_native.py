"""License scan and decontamination: small tables, plans without Python."""

import random
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, license

DOCS = "doc_id long, text string, digest string, score int"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_license_scan(spark):
    mit = license.TEXTS["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "sublicence").replace(",", " ;")), (3, mit + " more"), (4, None), (5, ""), (6, "Copyright 1999 x"), (7, "Licenced under the Apache Licence -- version 2.0"), (1, mit), (None, mit)]
    known = license.known_licenses(spark, {"own": "Do as you like.", "zz": "do as you LIKE"})
    out = license.scan(spark.createDataFrame([(k, t, "d", 1) for k, t in rows] + [(8, "do as you like!", "", 0)], DOCS), known)
    got = sorted(((r.doc_id, r.license_id) for r in out.collect()), key=repr)
    assert got == sorted([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, "statement:Apache-2.0"), (1, "MIT"), (None, "MIT"), (8, "own")], key=repr)
    assert "Python" not in plan(out) and "Pandas" not in plan(out)
    assert license.scan(spark.createDataFrame([], DOCS), known).count() == 0


TITLED = {
    "MIT": "The MIT License (MIT)\n\nCopyright (c) 2021 A. Person and others\n\n", "ISC": "ISC License\n\nCopyright 2004-2010 by Somebody\nCopyright 1995 X, Inc.\n", "Zlib": "\n  zlib Licence\n(C) 2011 Y\n", "Unlicense": "The Unlicense License\n",
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) <year>, <owner>. All rights reserved.\n\n", "BSD-2-Clause": "Copyright (c) 2000 Z\nAll rights reserved.\n\nBSD 2-Clause License\n", "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\n", "0BSD": "Zero-Clause BSD License\n=======\n", "MIT-0": "MIT No Attribution License\n\nCopyright 2020 Q\n\n",
}


def test_whole_licence_files_are_found(spark):
    rows, want = [], {}
    for k, (name, head) in enumerate(TITLED.items()):
        for j, width in enumerate((40, 57, 72, 79, 100000)):
            body = "\n\n".join("\n".join(textwrap.wrap(line, width)) for line in license.TEXTS[name].split("\n"))
            for i, text in enumerate((head + body, head + body.upper(), body.replace("1. ", "* ").replace("2. ", " a) ").replace(" license ", " licence "), head.replace("\n", "\r\n") + body.replace("\n", "\r\n"))):
                want[100 * k + 10 * j + i] = name
                rows.append((100 * k + 10 * j + i, text, "", 0))
    got = {r.doc_id: r.license_id for r in license.scan(spark.createDataFrame(rows, DOCS), license.known_licenses(spark)).collect()}
    assert got == want


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this machine")
def test_long_licences(spark):
    files = {"GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1", "BSD-3-Clause-UC": "BSD"}
    texts = {k: Path("/usr/share/common-licenses", f).read_text() for k, f in files.items()}
    end = "END OF TERMS AND CONDITIONS"
    rows = [(10 * k + j, t, "", 0) for k, (_, text) in enumerate(texts.items()) for j, t in enumerate((text, text.upper(), "Copyright (c) 2020 B\n" + text, text.split(end)[0] + end * (end in text)))]
    got = {r.doc_id: r.license_id for r in license.scan(spark.createDataFrame(rows + [(99, texts["GPL-3.0"][:-900] + " x", "", 0)], DOCS), license.known_licenses(spark), license.published_digests(spark)).collect()}
    assert got == {10 * k + j: name for k, name in enumerate(texts) for j in range(4)} | {99: None}
    folder = license.digests_of(license.licenses_in(spark, "/usr/share/common-licenses/GPL-2")).collect()
    assert {r.digest for r in folder} == set(license.DIGESTS["GPL-2.0"]) and folder[0].license_id == "GPL-2"


def test_statements_inside_texts(spark):
    rows = [(1, "A story.\nReleased under the MIT licence\nEnd. Licensed under CC BY-NC 4.0."), (2, "x\nLicensed under CC BY-NC 4.0.\nreleased under the mit license\n"), (3, "Released under the MIT License."), (4, None), (5, "licenses " * 30000)]
    rows.append((6, "\n" * 50000 + "Copyright " * 50000))
    got = {r.doc_id: (r.license_id, r.statements) for r in license.scan(spark.createDataFrame([(k, t, "", 0) for k, t in rows], DOCS), license.known_licenses(spark)).collect()}
    assert got == {1: (None, "statement:MIT"), 2: (None, "statement:CC-BY-NC-4.0,statement:MIT"), 3: ("statement:MIT", "statement:MIT"), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_equivalent_spellings(spark):
    a = spark.createDataFrame([(1, "The LICENCE, wilful per cent non-commercial sub-licence"), (2, "the license willful percent noncommercial sublicense"), (3, "sublicence")], "doc_id long, text string")
    got = {r.doc_id: r.digest for r in license.scan(a, license.known_licenses(spark)).collect()}
    assert got[1] == got[2] != got[3]


def test_overlaps(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(2000)]
    item = r.choices(words, k=30)
    noisy = [w if k % 5 else "zzz" for k, w in enumerate(item)]
    filler = lambda n: r.choices([f"f{k}" for k in range(3000)], k=n)
    text = lambda w: " ".join(w)
    rows = [(1, text(filler(40) + item + filler(9))), (2, text(filler(7) + noisy)), (3, text(filler(300))), (4, None), (5, ""), (6, text(filler(50) + item[:5] + filler(20))), (7, text(item[12:] + filler(5))), (8, text(item[:8])), (1, text(filler(1))), (None, text(item).upper().replace(" ", ", "))]
    bench = spark.createDataFrame([(70, text(item), "x"), (71, "too short", "x"), (72, None, "x"), (70, text(item), "x")], "item_id long, text string, doc_id string")
    out = decontaminate.overlaps(spark.createDataFrame([(k, t, "", 1) for k, t in rows], DOCS), bench)
    got = {(r.doc_id, r.item_id): (r.score, r.offset) for r in out.collect()}
    assert got == {(1, 70): (30, 40), (2, 70): (got[2, 70][0], 7), (7, 70): (18, -12), (None, 70): (30, 0)} and got[2, 70][0] >= 12
    assert "Python" not in plan(out) and "Pandas" not in plan(out) and "CartesianProduct" not in plan(out)
    left = decontaminate.drop_contaminated(spark.createDataFrame([(k, t, "", 1) for k, t in rows], DOCS), bench)
    assert sorted(((x.doc_id for x in left.collect())), key=repr) == sorted([1, 3, 4, 5, 6, 8], key=repr) and left.columns == ["doc_id", "text", "digest", "score"]


def test_empty_benchmark(spark):
    docs, none = spark.createDataFrame([(1, "a b c d e f g", "", 0)], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, none).count() == 0
    assert decontaminate.overlaps(spark.createDataFrame([], DOCS), none).count() == 0


def test_shuffled_index_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(40)), "", 0)], DOCS)
    bench = spark.createDataFrame([(9, " ".join(f"t{k}" for k in range(10, 30)))], "item_id long, text string")
    want = decontaminate.overlaps(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 1)
    assert decontaminate.overlaps(docs, bench).collect() == want and want[0].score == 20


def test_large_index_on_the_given_tables(spark, monkeypatch):
    """The path for an index of any size gives the same rows, stays free of Python and broadcasts a bounded bitmap only."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.unionByName(docs.limit(40).withColumn("text", F.concat_ws(" ", F.col("text"), F.lit(bench.first().text)))).withColumn("_t", F.lit("clash"))
    few = decontaminate.overlaps(docs, bench)
    want = sorted(map(tuple, few.collect()), key=repr)
    kept = sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    many = decontaminate.overlaps(docs, bench)
    assert sorted(map(tuple, many.collect()), key=repr) == want and len(want) >= 40 and "Python" not in plan(many)
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == kept


def seedless(doc, item):
    """Whether some diagonal of the two token lists passes verification."""
    n = len(item)
    for d in range(-n, len(doc)):
        now = best = same = 0
        for k in range(max(0, -d), min(n, len(doc) - d)):
            equal = item[k] == doc[k + d]
            now, same = max(0, now + (1 if equal else -1)), same + equal
            best = max(best, now)
        if best >= min(decontaminate.LEAST_SCORE, n) or n < decontaminate.PLAIN_BELOW and same >= n - n // decontaminate.EACH:
            return True
    return False


def test_all_that_verification_accepts_is_found(spark):
    r = random.Random(5)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in [*range(1, 15), 60]}
    filler = lambda: [f"f{r.randrange(3000)}" for _ in range(r.randint(0, 9))]
    docs = []
    for period in range(2, 13):
        docs += [[w if k % period != phase else "zzz" for k, w in enumerate(items[60])] for phase in range(period)]
    for n in range(1, 15):
        docs += [items[n]] + [[w if k not in (a, b) else "zzz" for k, w in enumerate(items[n])] for a in range(n) for b in range(a, n)]
    docs = [filler() + d + filler() for d in docs] + [[]]
    want = {(k, n) for k, d in enumerate(docs) for n, item in items.items() if seedless(d, item)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(0, ""), (-1, None)], "item_id long, text string")
    out = decontaminate.overlaps(spark.createDataFrame([(k, " ".join(d), "", 1) for k, d in enumerate(docs)], DOCS), bench)
    assert {(x.doc_id, x.item_id) for x in out.collect()} == want
    assert {(k, 60) for k in range(2, 5)} <= want


def test_random_substitutions(spark):
    """Share of overlaps that verification accepts and seeds find, for items of 14 to 60 tokens with tokens substituted at random."""
    r = random.Random(8)
    found, accepted = {}, {}
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (14, 20, 30, 60)}
    rows, at = [], {}
    for rate in (0.1, 0.2, 0.3):
        for n, item in items.items():
            for _ in range(60):
                doc = [f"f{r.randrange(3000)}" for _ in range(r.randint(0, 9))] + [w if r.random() > rate else "zzz" for w in item] + ["end"] * 9
                if seedless(doc, item):
                    at[len(rows)] = rate, n
                    accepted[rate] = accepted.get(rate, 0) + 1
                rows.append((len(rows), " ".join(doc), "", 1))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    for x in decontaminate.overlaps(spark.createDataFrame(rows, DOCS), bench).collect():
        assert at[x.doc_id][1] == x.item_id
        found[at[x.doc_id][0]] = found.get(at[x.doc_id][0], 0) + 1
    share = {rate: found[rate] / n for rate, n in accepted.items()}
    print(share)
    assert share[0.1] == 1 and share[0.2] >= 0.98 and share[0.3] >= 0.95, share


def test_long_texts(spark):
    item = [f"i{k}" for k in range(3000)]
    rows = [(1, " ".join(["the"] * 60000 + item + ["the"] * 1000), "", 0), (2, "the " * 100000, "", 0), (None, " ".join(item[:50]), "", 0), (2, " ".join(item[100:200]), "", 0)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(((x.doc_id, x.score, x.offset) for x in decontaminate.overlaps(docs, bench).collect()), key=repr) == [(1, 3000, 60000), (2, 100, -100), (None, 50, 0)]
    assert [x.doc_id for x in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
