"""Secret scan against plain regular expressions and whole-window entropies."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from scriptorium.llm import secret_scan as S

NAMED = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in NAMED.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    plain = text
    for word in S.PLACEHOLDERS:
        plain = re.sub(S.any_case(word), " " * len(word), plain)
    for number, kind in enumerate(S.CLASSES, 3):
        for m in re.finditer(kind.pattern, plain):
            if any(re.search(p, m[0]) for p in S.ALLOWED):
                continue
            windows = [m[0][i : i + S.WINDOW] for i in range(len(m[0]) - S.WINDOW + 1)]
            bits = [-sum(w.count(c) / S.WINDOW * math.log2(w.count(c) / S.WINDOW) for c in set(w)) for w in windows]
            dense = [i for i, b in enumerate(bits) if b + 1e-9 >= kind.bits]
            if dense:
                spans.append((m.start() + dense[0], number, m.start() + dense[-1] + S.WINDOW))
    return sorted(spans)


def test_against_brute_force(spark):
    draw = random.Random(6)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [None, "", "plain wörds", "a" * 50000, "token = 'abc' secret: abcdef", 'token="token": "abcdefgh"']
    texts += ["PassWord:\x20\x20hunter22 é API_KEY=" + pick(base, 40), "AKIA" + pick("ABCDEF0123", 16) + " AKIA" + pick("ABC", 15)]
    texts += ["example/" + pick(base, 40), pick(base, 30) + "Example" + pick(base, 30) + "abcdefghij", pick(base, 15) + "EXAMPLE" + pick(base, 15)]
    texts += ["x" * 30 + pick(base, 60) + "x" * 30, "EXAMPLE" + pick(base, 40), "0123456789" + pick(hexes, 30), pick(hexes, 23), pick(hexes, 24)]
    texts += [" é ".join(pick(hexes, draw.randint(10, 60)) + pick(base, draw.randint(0, 50)) for _ in range(9)) for _ in range(8)]
    texts += ["antidisestablishmentarianism " * 3, " ".join(pick(hexes, 30) for _ in range(1200)), "ſecret=abcdefgh"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "secret=abcdefg", "x"), (0, "", "x")], "doc_id long, text string, spans string")
    got = S.scan(docs.repartition(2)).collect()
    assert len(got) == len(texts) + 2
    by_id = {r.doc_id: [tuple(s) for s in r.spans] for r in got}
    assert {i: by_id[i] for i in range(len(texts))} == {i: brute(t) for i, t in enumerate(texts)}
    assert by_id[None] == brute("secret=abcdefg")


def test_running_sums_in_blocks(spark):
    values = [random.Random(1).randint(0, 9) for _ in range(1000)]
    frame = spark.createDataFrame([(values,), ([],), (values[: S.BLOCK],)], "v array<int>")
    for row in frame.select("v", S.sums_before(F.col("v")).alias("s")).collect():
        assert row.s == [sum(row.v[:i]) for i in range(len(row.v))]


def test_native_plan_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    scanned = S.scan(docs)
    assert scanned.collect() == []
    assert not re.search("Python|Arrow|Pandas", scanned._jdf.queryExecution().executedPlan().toString())
