import random
import re

import pytest

from evidentia.llm import pii

DOCS = "doc_id long, text string, base string, spans int"
CASES = [
    "mail a.b+c@x-y.co.uk, and @no, a@b, b@c.d.", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5 01.02.03.004 1.2.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112, 41111111111111112222333", "+1 (555) 123-4567 +12 +1234567890123456 +1.2.3.4.5.6.7.8",
    "", None, "@" * 50, "a" * 3000 + "@", "1" * 3000, "+" * 100, "1.2." * 500, "é@x.y ü+49 30 1234567 ü", 'token = "0123456789abcdef0123456789abcdef01234567"', "x@y.z@w.v", "a@b.c.@d.e 1.1.1.1.1.1.1.1",
]


@pytest.mark.parametrize("text", CASES)
def test_base_equals_the_patterns(text):
    spans = pii.base_spans(text or "")
    import hashlib

    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert (*(sum(k == x for k, _, _ in spans) for x in pii.KINDS), digest) == pii.brute_force(text)


def test_base_on_random_texts():
    r = random.Random(3)
    for _ in range(1500):
        text = "".join(r.choice("@@..++--  01259aZ_é()%") for _ in range(r.randint(0, 60)))
        assert [*pii.brute_force(text)[:4]] == [sum(k == x for k, _, _ in pii.base_spans(text)) for x in pii.KINDS], text
    for _ in range(300):
        text = "".join(r.choice(["4111111111111111", "4111 1111 1111 1111", "-", " ", "1", "+1 555 555 5555", "1.1.1.1", "a@b.cd", "."]) for _ in range(r.randint(0, 9)))
        assert pii.brute_force(text)[4] == __import__("hashlib").sha256(",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text)).encode()).hexdigest(), text


def test_query_columns(spark):
    rows = [(k, t, "b", 1) for k, t in enumerate(CASES)] + [(0, CASES[0], "b", 1), (None, "a@b.cd", "", 2)]
    got = pii.digest_columns(pii.find(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(CASES):
        assert (by[k].n_email, by[k].n_ip, by[k].n_card, by[k].n_phone, by[k].base_sha256) == pii.brute_force(t)
    assert by[0].spans.startswith("email:5:20")
    assert pii.digest_columns(pii.find(spark.createDataFrame([], DOCS))).count() == 0


def test_em_and_classifier_separate():
    key, word = "434000311", "230001001"
    counts = [("secret", "2222", key, 400), ("secret", "2022", key, 60), ("secret", "0111", word, 3000), ("secret", "1001", word, 500), ("contact", "0001", word, 10)]
    p = pii.fit(counts)
    assert p["secret", key] > 0.9 and p["secret", word] < 0.1
    # Where labelers abstain, the shape decides.
    more = pii.fit(counts + [("secret", "0000", key, 5), ("secret", "0000", word, 5)])
    assert more["secret", key] > 0.9 and more["secret", word] < 0.1
    assert pii.fit([]) == {}


def test_added_spans_lie_outside_base_spans():
    text = "key = aa@bb.cc and 1.1.1.1.2.2.2.2x4.4.4.4-5.5.5.5_abcdefghijklmnopqrstuvwxyz1234567890@x.yz tail"
    base = pii.base_spans(text)
    assert not [(x, y) for x in pii.candidates(text, base) for y in base if x[1] < y[2] and y[1] < x[2]]
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(["A1b2C3d4E5f6G7h8I9j0k", "1.2.3.4", "@", ".", " ", "=", "x.yz", "/", "+49 30 1234567", "4111111111111111"]) for _ in range(r.randint(1, 14)))
        base = pii.base_spans(text)
        assert not [(x, y) for x in pii.candidates(text, base) for y in base if x[1] < y[2] and y[1] < x[2]], text


def planted(r):
    """(text, secret or None): half the texts hold a secret, the others something that only looks like one."""
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))
    if r.random() < 0.5:
        kind = r.randrange(4)
        secret = "".join(r.choice("0123456789abcdef" if kind == 0 else chars) for _ in range(r.choice([24, 32, 40, 64, 240])))
        secret = ("AKIA" + secret[:20].upper() if kind == 1 else "sk_" + secret if kind == 2 else secret) + "=" * (kind == 3)
        form = r.choice(['token = "%s"', "api_key=%s", "password: %s", "Authorization: Bearer %s", "export SECRET_KEY='%s'", "access_key => %s"])
        return f"{words(12)} {form % secret} {words(9)}", secret
    other = r.choice(["internationalisationsverfahren" + words(1), "a_rather_long_name_of_a_function", "/usr/local/lib/python/site-packages/numpy", "TheVeryLongNameOfSomeJavaClassFactory", "die-unendliche-geschichte-der-technik", "=" * 3 + "-" * 30])
    return f"{words(12)} {other} {words(9)}", None


def test_held_out_precision_and_recall():
    r = random.Random(12)
    model = pii.fit([(*k, n) for k, n in __import__("collections").Counter((k, v, s) for text, _ in (planted(r) for _ in range(3000)) for k, _, _, v, s in pii.candidates(text, pii.base_spans(text))).items()])
    hit = said = true = 0
    for text, secret in (planted(r) for _ in range(1500)):
        found = [text[a:b] for k, a, b, _, s in pii.candidates(text, pii.base_spans(text)) if model.get((k, s), 0) >= pii.KEEP_FROM]
        hit, said, true = hit + (secret in found), said + len(found), true + (secret is not None)
    print("precision", hit / said, "recall", hit / true)
    assert hit / said >= 0.95 and hit / true >= 0.95


def test_redaction_keeps_rows_and_columns(spark):
    key = "0123456789abcdef0123456789abcdef01234567"
    rows = [(k, f'plain words here and token = "{key}" mail a@b.cd end', "b", 1) for k in range(30)] + [(99, None, None, None), (100, "nothing at all", "x", 3)] + [(200 + k, "justaverylongwordwithoutanydigits here", "", 0) for k in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns and len(got) == len(rows)
    assert got[0] == 'plain words here and token = "<secret>" mail <email> end'
    assert got[99] is None and got[100] == "nothing at all" and got[200] == rows[-1][1]
    assert not re.search("[0-9]{8}", got[5])


FORMS = {"token=%s": "0123456789abcdef0123456789abcdef01234567", "API_KEY=%s": "QWxhZGRpbjpvcGVuIHNlc2FtZTEyMzQ1Njc4OQ==", 'secret = "%s"': "aB3dE6gH9k" * 30, "export AWS_SECRET_ACCESS_KEY_1=%s": "wJa1rXUtn2FEMI7K3MDENG9bPx4RfiCYEX5AMPL8"}


@pytest.mark.parametrize("form", FORMS)
def test_usual_forms_of_keys_are_candidates(form):
    text = f"see {form % FORMS[form]} there"
    assert FORMS[form] in [text[a:b] for kind, a, b, *_ in pii.candidates(text, pii.base_spans(text)) if kind == "secret"]


def test_usual_forms_of_keys_are_redacted(spark):
    rows = [(10 * k + j, f"words before {form % key} words after", "b", 1) for k in range(20) for j, (form, key) in enumerate(FORMS.items())]
    rows += [(1000 + k, "justaverylongwordwithoutanydigits here", "", 0) for k in range(80)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, DOCS)).collect()}
    for j, form in enumerate(FORMS):
        assert got[j] == f"words before {form % '<secret>'} words after"
    assert got[1000] == rows[-1][1]
