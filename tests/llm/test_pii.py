"""Personal data: plain finds against the patterns themselves, disguises and clean texts by example, edge rows."""

import random
import re

import pytest

from darkroom.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]


def test_plain_finds_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice("ab1239@.+- ()_%2545é\n") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.plain(text)) == sorted(brute(text)), text


DISGUISED = [
    ("email", "write to ", "john dot doe at example dot com", " soon"), ("email", "", "jane [at] mail [dot] org", " now"), ("email", "a ", "jоhn@exаmple.com", "."),
    ("email", "", "j.smith (at) mail7.example.com", ". Then"), ("email", "x ", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", " ok"), ("email", "", "j.doe at example.com", ""), ("email", "", "john @ example . com", ""),
    ("email", "a ", "b​@c.com", ""), ("email", "", "user_at_example_dot_com", ""), ("email", "", "john AT example DOT com", " DOT Thanks"), ("email", "", "john&#64;example&#46;com", ""),
    ("email", "", "eva underscore k at mail dot example dot de", ""), ("card", "card ", "４１１１ １１１１ １１１１ １１１１", " x"), ("card", "", "four " + "one " * 14 + "one", ""), ("card", "", "4lll 1111 1111 1111", ""),
    ("card", "", "vier " + "eins " * 14 + "eins", ""), ("card", "", "٤١١١ ١١١١ ١١١١ ١١١١", ""), ("ip", "at ", "one nine two dot one six eight dot one dot one", ""), ("ip", "", "192[.]168[.]1[.]1", ""),
    ("ip", "", "192 dot 168 dot 1 dot 1", ""), ("phone", "", "plus one five five five one two three four five six seven", ""), ("phone", "", "+1 (555) l23-4567", ""), ("phone", "", "+49–30–1234567", ""),
    ("phone", "", "plus one double five five one two three four five six seven", ""),
]


@pytest.mark.parametrize("kind,before,said,after", DISGUISED)
def test_disguises(kind, before, said, after):
    text = before + said + after
    assert [(s[0], text[s[1] : s[2]]) for s in pii.spans_of(text) if s[3]] == [(kind, said)]


@pytest.mark.parametrize("text", [
    "look at this dot pattern", "meet at example.com", "End . Then go", "почта@пример.рф", "one two three four five six seven eight nine ten",
    "a dot at noon", "call +1 (848) 555-1373 Un homme", "Ungeöffnet – fünf sechs", "10 − 3", "a, b . c @ d", "at dot com", "l 5 I 6",
])
def test_clean_texts(text):
    assert not any(s[3] for s in pii.spans_of(text))


def test_plain_finds_stay_and_come_in_order():
    text = "+1 (487) 555-7209 a@b.co 10.0.0.1, 4111 1111 1111 1111 c [at] d.org"
    assert [(k, text[i:j], a) for k, i, j, a in pii.spans_of(text)] == [
        ("email", "a@b.co", False), ("email", "c [at] d.org", True), ("ip", "10.0.0.1", False), ("card", "4111 1111 1111 1111", False), ("phone", "+1 (487) 555-7209", False),
    ]


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "a." * 150_000, "1." * 150_000, "one " * 80_000, "dot " * 80_000, "x at " * 80_000, "а" * 200_000 + "@", "0 " * 150_000, "+1(" * 90_000):
        pii.spans_of(text)


def test_query_on_edge_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "x " * 200_000 + "é a@b.co"), (4, "👍 a@b.co"), (None, "a@b.co"), (4, "👍 a@b.co"), (5, "c [at] d.org")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sorted(map(tuple, queries.op11_pii(spark, f"{tmp_path}/a").select("doc_id", "n_email", "n_ip", "spans", "n_added").collect()), key=str)
    want = [(1, 0, 0, "", 0), (2, 0, 0, "", 0), (3, 1, 0, "email:400002:400008", 0), (4, 1, 0, "email:2:8", 0), (4, 1, 0, "email:2:8", 0), (5, 0, 0, "email:0:12", 1), (None, 1, 0, "email:0:6", 0)]
    assert got == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op11_pii(spark, f"{tmp_path}/b").count() == 0
