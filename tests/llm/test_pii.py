import random
import re

import pytest

from plumbline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PARTS = ["a", "b.", "@", "é", "𝔘", "1", "22", "255", "256", ".", "..", "-", " ", "+", "(", ")", "_", "%", "x@y.z", "4111 1111 1111 1111", "+1 (555) 123-4567", "1.2.3.4", "\n", "　", "٣"]


def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def spans(found):
    return [(pii.KINDS[s.kind], s.start, s.end) for s in found]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [None, "", "a@b.com_c@d.org", "1" * 5000, "a" * 3000 + "@", "1 " * 3000, "(1" * 3000, "0.0.0.000000000012 1.1.1.99999999999"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        assert spans(found[i].base) == plain(t or ""), t
        assert set(found[i].base) <= set(found[i].spans)


@pytest.fixture(scope="module")
def taught(spark):
    """Phones behind the same words teach a pattern; the last texts hold numbers that no base pattern finds."""
    rows = [(i, f"Some words {i} please call hotline +49 30 555-{1000 + i} today") for i in range(20)]
    rows += [(100, "You can call hotline 030 555 7788 today"), (101, "the year 2024 and item 030 555 7799 today"), (102, None), (103, "")]
    rows += [(103, ""), (None, "call hotline 030 555 1122 today")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_patterns_discover_what_the_base_misses(taught):
    found = {r.doc_id: r for r in pii.find(taught).collect()}
    assert spans(found[100].spans) == [("phone", 21, 33)] and found[100].base == []
    assert found[101].spans == [] and spans(found[None].spans) == [("phone", 13, 25)]
    assert pii.find(taught).count() == taught.count()


def test_contexts_are_whole_words_however_far(spark):
    far, long = " " * 90, "https://example.org/" + "a" * 70
    texts = [f"see {long} hotline{far}+49 30 555-1000{far}today", f"see {long}{far}+49 30 555-1000 {long}{far}", "+49 30 555-1000"]
    found = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    one, two, none = ({p for m in r.mentions if m.kind == 3 for p in m.patterns} for r in found)
    assert one == {"1 hotline", f"2 {long} hotline", "3 hotline today"}
    assert two == {f"1 {long}", f"2 see {long}", f"3 {long} {long}"} and none == set()


def test_redaction_replaces_spans_only(taught):
    clashing = taught.selectExpr("doc_id", "text", "doc_id AS start", "text AS spans")
    out = {r.doc_id: r for r in pii.redact(clashing).collect()}
    assert out[3].text == "Some words 3 please call hotline [phone] today" and out[3].start == 3
    assert out[101].text == "the year 2024 and item 030 555 7799 today" and out[102].text is None
    assert pii.redact(clashing).count() == taught.count() and pii.redact(taught.limit(0)).count() == 0


def test_main_path_is_native(spark, small):
    assert not re.search("Python|Pandas|Arrow", pii.op4_pii(spark, small)._jdf.queryExecution().executedPlan().toString())
