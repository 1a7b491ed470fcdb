import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in PATTERNS.items()}


def texts():
    draw = random.Random(5)
    parts = ["a@b.c", "x@y", "a@b.c_d@e.f", "p..q@h-.org.", "@", "é@b.c", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0001.002.3.255", "12.34.5", "4111111111111111", "4111-1111 1111 1111", "4111 1111 1111 1112", "41111111111111111111", "+1 (234) 555-1234", "+12", "+1 2 3 4 5 6 7 8.", "+1--2345678", "+491234567890123456", "😀", " ", "\n", "word", "7", "-", "a.b@c.d.e-f", "999999999999999999999999.1.1.1"]
    out = ["".join(draw.choice(parts) + draw.choice(["", " ", ",", "x"]) for _ in range(draw.randrange(1, 14))) for _ in range(300)]
    return out + ["", None, "a" * 100_000 + "@", "1" * 100_000, "1 " * 20_000, "a@b" + ".c" * 20_000, "+1" + "2" * 50_000, "x@y.z " * 300]


@pytest.fixture(scope="module")
def weights(sample):
    return pii.train(sample)


def test_base_spans(frame, weights):
    data = texts()
    rows = {r.doc_id: r for r in pii.report(frame(data), weights).collect()}
    for i, t in enumerate(data):
        want = base(t)
        joined = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k])
        r = rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()], (t or "")[:200]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_method_adds_what_labelers_agree_on(frame, weights):
    text = "Call me, phone (030) 1234 5678. Mr. John Smith, bob [at] site [dot] com; IBAN DE89 3704 0044 0532 0130 00"
    plain = ["no 9807915762804490 here", "key f4111111111111112a", "build 12.13.14.256", "The 2020 report"]
    rows = {r.doc_id: r.spans for r in pii.report(frame([text, *plain]), weights).collect()}
    kinds = [s.split(":")[0] for s in rows[0].split(",")]
    assert kinds == ["email", "phone", "iban", "name"]
    assert all(rows[i] == "" for i in range(1, 5))


def test_reliabilities():
    posterior, accuracy = pii.reliabilities({"0222110": 90, "0101110": 60, "0112110": 3})
    assert posterior["0222110"] > 0.95 > 0.5 > posterior["0101110"]
    assert all(0.5 <= a <= 0.99 for a in accuracy)


def test_redacted(frame, weights):
    docs = frame(["mail a@b.com now", None, "", "é 😀 1.2.3.4.", "nothing", "+1 (234) 555-1234 a@b.c"])
    out = pii.redacted(docs, weights)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "mail <EMAIL> now", 1: None, 2: "", 3: "é 😀 <IP>.", 4: "nothing", 5: "<PHONE> <EMAIL>"}


def test_columns_with_any_names(frame, weights):
    names = ["spans", "more", "base0", "near1", "extra", "_null", "_found", "_base", "row", "pos", "a.b"]
    docs = frame(["mail a@b.com now", None])
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    out = pii.redacted(docs, weights)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "mail <EMAIL> now" and rows[1].text is None
    assert all(rows[i][n] == f"own {n}" for i in (0, 1) for n in names)


def test_empty(frame):
    weights = pii.train(frame([]))
    assert pii.report(frame([]), weights).collect() == []
    assert pii.report(frame(["a@b.c"]), weights).first().n_email == 1


def test_no_python_on_the_main_path(sample, weights):
    plan = pii.report(sample, weights)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
