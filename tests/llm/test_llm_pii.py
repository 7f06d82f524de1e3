"""Personal data: base spans against plain patterns, disguises, places, defined results."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from scriptorium.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]


def odd_texts(count):
    draw = random.Random(7)
    pieces = ["a", "jo", "@", "@", ".", "..", "-", "+", "+1", "1", "255", "256", "4111", " 1111", "0000", " ", "(", ")", "\n", "é", "_", "x.y", "9" * 17]
    return ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 40))) for _ in range(count)]


def test_base_spans_are_those_of_the_patterns():
    for text in odd_texts(4000):
        assert [s[:3] for s in pii.spans(text) if s[3]] == base(text), text


#: What is disguised, in marks that the test cuts out, and what it stands for.
DISGUISED = [
    ("write to <john.smith (at) example (dot) com> now", "email", "john.smith@example.com"),
    ("<ann[at]mail.example.org>, please", "email", "ann@mail.example.org"),
    ("<bob at mail dot example dot org>.", "email", "bob@mail.example.org"),
    ("<bob underscore b AT web dash site DOT co DOT uk>", "email", "bob_b@web-site.co.uk"),
    ("sagt <jane.doe at example.com> und", "email", "jane.doe@example.com"),
    ("escribe a <ana arroba correo punto example punto es> hoy", "email", "ana@correo.example.es"),
    ("<eva&#64;host&#46;net>!", "email", "eva@host.net"),
    ("über <ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ> ok", "email", "joe@example.com"),
    ("é <jоhn.sмith@example.com>", "email", "john.smith@example.com"),
    ("<a​b@c‍.de> ß", "email", "ab@c.de"),
    ("ok <joe (at)  a  (dot)  b> ok", "email", "joe@a.b"),
    ("server <192[.]168[.]1[.]10> down", "ip", "192.168.1.10"),
    ("at <one nine two dot one six eight dot one dot one>", "ip", "192.168.1.1"),
    ("<１９２.１６８.1.1>", "ip", "192.168.1.1"),
    ("call <plus four four two zero 7946 0958> today", "phone", "+4420 7946 0958"),
    ("call <+1 four one five, five five five 2671>", "phone", "+1 415555 2671"),
    ("ruf <+49 30 null eins zwei drei vier fünf> an", "phone", "+49 30 012345"),
    ("<+٤٤ 20 7946 0958>", "phone", "+44 20 7946 0958"),
    ("pay <4111 1111 1111 one one one one> yes", "card", "4111 1111 1111 1111"),
    ("pay <4111 1111 1111 1111> yes", "card", "4111 1111 1111 1111"),
]
CLEAN = [
    "look at example.com", "Look at that, one two three", "plus one", "We met at noon. Dot your i's at home.",
    "version 2.0 at 10.30", "(at) home (dot)", "one two three four five six seven eight nine", "five hundred and one", "été à 5 h 30",
    "1 2 3 4 5 6 7 8 9", "Привет, как дела в 2020 году", "dot at dot at dot", "a@b", "x (dot) y", "3 dot 5 dot 7",
]


@pytest.mark.parametrize("marked,kind,value", DISGUISED)
def test_disguised_data_is_found_where_it_stands(marked, kind, value):
    start, end = marked.index("<"), marked.index(">") - 1
    text = marked.replace("<", "").replace(">", "")
    added = [s for s in pii.spans(text) if not s[3]]
    assert added == [(kind, start, end, False, value)]
    assert pii.masked(text) == f"{text[:start]}[{kind}]{text[end:]}"
    assert [s[:3] for s in pii.spans(text) if s[3]] == base(text)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_left_alone(text):
    assert pii.spans(text) == [] and pii.masked(text) == text


def test_added_spans_do_not_repeat_base_ones():
    text = "+1 (988) 555-2485 one day, joe@example.com at home, one é"
    assert [s[:4] for s in pii.spans(text)] == [("email", 27, 42, True), ("phone", 0, 17, True)]


@pytest.mark.parametrize("piece", ["a", "1", "1 ", "@", "+1(", "a.b@", "one ", " dot a", "a at ", "a dot b at ", "(", "plus ", "é", "о", "1.", "&#64;"])
def test_time_is_linear(piece):
    def took(n):
        begun = time.process_time()
        pii.spans(piece * (n // len(piece)))
        return time.process_time() - begun

    assert took(400_000) < 10 * took(100_000) + 0.2


def test_query_rows(spark, tmp_path):
    texts = [None, "", "joe@example.com, 10.0.0.1 and joe (at) example (dot) org", *odd_texts(60), "x" * 4000 + " a@b.c", "é \n" * 300_000]
    rows = [(i if i % 9 else None, t, "v", 3) for i, t in enumerate(texts)] + [(2, texts[2], "v", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, found int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op13_pii(spark, str(tmp_path)).collect()
    want = []
    for key, text, *_ in rows:
        held = base(text or "")
        joined = lambda ss: ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in ss)
        counts = [sum(s[0] == k for s in held) for k in PATTERNS]
        want.append((key, *counts, hashlib.sha256(joined(held).encode()).hexdigest(), joined(pii.spans(text or ""))))
    order = lambda r: (r[0] is None, r[0] or 0, r[5], r[6])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert pii.scan(docs.limit(0)).collect() == [] and pii.redact(docs).columns == docs.columns
    assert pii.redact(docs.where("doc_id = 2")).first().text == "[email], [ip] and [email]"
