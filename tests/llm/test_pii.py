import random
import re

from siltstone.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = {k: [m.span() for m in re.finditer(p, text)] for k, p in FORMS.items()}
    n = lambda s: sum(c in "0123456789" for c in text[s[0] : s[1]])
    found["ip"] = [s for s in found["ip"] if all(int(p) <= 255 for p in text[s[0] : s[1]].split("."))]
    found["card"] = [s for s in found["card"] if 13 <= n(s) <= 19 and pii.luhn(re.sub(r"\D", "", text[s[0] : s[1]]))]
    found["phone"] = [s for s in found["phone"] if 9 <= n(s) <= 15]
    return found


def test_base_spans_equal_the_expressions():
    r = random.Random(2)
    bits = ["@", ".", "-", "+", " ", "a", "B", "9", "255", "256", "1.2.3.4", "x@y.zz", "4111 1111 1111 1111", "+49 (30) 1234567", "é", "\n", "%", "(", ")", "0"]
    for _ in range(6000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        found = pii.find(text)
        assert {k: found[k] for k in pii.BASE} == brute(text), text


def test_added_kinds_and_redaction():
    text = "See https://a.example/x?y=1. IBAN GB82 WEST 1234 5698 7654 32, account no: 12345678; me@x.org"
    found = pii.find(text)
    assert [text[a:b] for a, b in found["url"]] == ["https://a.example/x?y=1"]
    assert [text[a:b] for a, b in found["iban"]] == ["GB82 WEST 1234 5698 7654 32"]
    assert [text[a:b] for a, b in found["account"]] == ["12345678"]
    assert pii.redact(text) == "See [url]. IBAN [iban], account no: [account]; [email]"
    assert pii.redact(None) is None


def test_edge_rows(spark):
    frame = spark.createDataFrame([(1, None, "q"), (None, "", "q"), (3, "a@b.c", "q"), (3, "a@b.c", "q")], "doc_id long, text string, spans string")
    got = {(x.doc_id, x.spans) for x in pii.scan(frame).collect()}
    assert got == {(1, ""), (None, ""), (3, "email:0:5")}


def test_long_text_is_linear():
    assert pii.find("a" * 2_000_000)["email"] == [] and pii.find("1." * 500_000)["ip"]
