"""Edits on packages and plain paragraphs: results, refusals, formats."""

from __future__ import annotations

import random

import pytest
from documents import p, package, parsed, r, table

from scriptorium.operators import edits as E
from scriptorium.operators import formatting, structure
from scriptorium.operators.positions import positions

ONE = "doc_id string, idx int, text string"


def frame(spark, documents):
    data = [(d, i, t) for d, texts in documents.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(data, ONE)


def texts(edited):
    got: dict = {}
    for row in edited.paragraphs.orderBy("idx").collect():
        got.setdefault(row.doc_id, []).append((row.idx, row.text))
    assert all([i for i, _ in rows] == list(range(len(rows))) for rows in got.values())
    return {d: [t for _, t in rows] for d, rows in got.items()}


def reasons(edited):
    return {row.doc_id: row.reason for row in edited.rejects.collect()}


def test_replace_keeps_run_formats(spark):
    body = p(r("Zwölf Möwen über d", "<dx:i/>"), r("em Watt, ", '<dx:u dx:val="single"/>'), r("drei über dem 🌊.", "<dx:strike/>"))
    nodes, _ = parsed(spark, package(body))
    runs = structure.runs(nodes).drop("part")
    got = E.replace_in_runs(runs, "über dem", "<auf & ab>").orderBy("run").collect()
    assert [x.text for x in got] == ["Zwölf Möwen <auf & ab>", " Watt, ", "drei <auf & ab> 🌊."]
    assert [(x.italic, x.underline) for x in got] == [(True, None), (None, "single"), (None, None)]
    assert [x.text for x in E.replace_in_runs(runs, "Ebbe", "Flut").orderBy("run").collect()] == ["Zwölf Möwen über d", "em Watt, ", "drei über dem 🌊."]
    first = E.replace_in_runs(runs, "e", "E", all=False).orderBy("run").collect()
    assert [x.text for x in first] == ["Zwölf MöwEn über d", "em Watt, ", "drei über dem 🌊."]
    listing = structure.listing(nodes)
    done = E.replace(listing, "über dem", "<auf & ab>", all=True, guards=structure.guards(nodes))
    assert texts(done) == {"0": ["Zwölf Möwen <auf & ab> Watt, drei <auf & ab> 🌊."]}
    assert done.audit.first().replacements == 2
    assert E.replace(listing, "Ebbe", "Flut").audit.first().replacements == 0


def test_replace_in_runs_matches_a_plain_splice(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for idx in range(60):
        pieces = ["".join(rng.choices("ab", k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 5))]
        rows += [("d", idx, n, t) for n, t in enumerate(pieces)]
        whole, owner = "".join(pieces), [n for n, t in enumerate(pieces) for _ in t]
        out, at = [""] * len(pieces), 0
        while at < len(whole):
            if whole.startswith("ab", at):
                out[owner[at]] += "<X>"
                at += 2
            else:
                out[owner[at]] += whole[at]
                at += 1
        want |= {(idx, n): t for n, t in enumerate(out)}
    runs = spark.createDataFrame(rows, "doc_id string, idx int, run int, text string")
    got = {(x.idx, x.run): x.text for x in E.replace_in_runs(runs, "ab", "<X>").collect()}
    assert got == want


def test_replace_is_refused_where_it_could_corrupt(spark):
    bodies = [
        "<dx:sdt><dx:sdtContent>" + p(r("text")) + "</dx:sdtContent></dx:sdt>",
        '<dx:p><dx:fldSimple dx:instr="DATE">' + r("text") + "</dx:fldSimple></dx:p>",
        '<dx:p><dx:bookmarkStart dx:id="1"/>' + r("text") + '<dx:bookmarkEnd dx:id="1"/></dx:p>',
        p(r("text")),
        p(r("outer text"), "<dx:r><dx:pict>" + p(r("boxed")) + "</dx:pict></dx:r>"),
        p(r("fine text")) + p("<dx:r><dx:br/></dx:r>"),
    ]
    nodes, _ = parsed(spark, *[package(b) for b in bodies])
    listing = structure.listing(nodes)
    done = E.replace(listing, "text", "changed", guards=structure.guards(nodes))
    assert set(reasons(done)) == {"0", "1", "2", "4"}
    got = texts(done)
    assert got["0"] == ["text"] and got["3"] == ["changed"] and got["5"] == ["fine changed", "\n"]
    assert reasons(E.replace(listing, "x", "y", paragraph=1))["3"] == "no paragraph has this index"
    with pytest.raises(ValueError):
        E.replace(listing, "", "x")
    with pytest.raises(ValueError):
        E.replace(listing, "x", "\x01")


def test_insert(spark):
    body = p(r("before")) + table([p(r("cell"))]) + "<dx:sectPr/>"
    nodes, _ = parsed(spark, package(body), package(""))
    listing = structure.listing(nodes)
    schema = "doc_id string, idx int, text string, style string"
    edits = spark.createDataFrame([("0", 1, "inserted", "Quote"), ("1", None, "a\r\nb", None)], schema)
    done = E.insert_paragraphs(listing, edits, structure.guards(nodes, anchors=False))
    assert texts(done) == {"0": ["before", "inserted", "cell"], "1": ["a\nb"]}
    row = done.paragraphs.where("doc_id = '0' and idx = 1").first()
    assert (row.style, row.in_table) == ("Quote", True)
    far = spark.createDataFrame([("0", 3, "x", None), ("1", 0, "bad\x02", None)], schema)
    refused = E.insert_paragraphs(listing, far)
    assert len(reasons(refused)) == 2 and texts(refused) == {"0": ["before", "cell"]}


def test_delete(spark):
    body = p(r("keep one")) + p(r("drop me", "<dx:b/>")) + table([p(r("cell a")) + p(r("cell b"))]) + p(r("keep two")) + "<dx:sectPr/>"
    nodes, _ = parsed(spark, package(body))
    once = E.delete_paragraphs(
        structure.listing(nodes), spark.createDataFrame([("0", 1)], "doc_id string, idx int"), structure.deletion_guards(nodes)
    )
    assert texts(once)["0"] == ["keep one", "cell a", "cell b", "keep two"]
    assert once.audit.first().deleted_text == "drop me"
    twice = E.delete_paragraphs(once.paragraphs, spark.createDataFrame([("0", 2)], "doc_id string, idx int"))
    assert texts(twice)["0"] == ["keep one", "cell a", "keep two"]


def test_deletions_that_are_refused(spark):
    cases = [
        (p(r("only")) + "<dx:sectPr/>", 0),
        (p(r("body")) + table([p(r("cell"))]) + "<dx:p/>", 1),
        (p(r("section one"), props="<dx:sectPr/>") + p(r("after")) + "<dx:sectPr/>", 0),
        ('<dx:p><dx:bookmarkStart dx:id="1"/>' + r("marked") + '<dx:bookmarkEnd dx:id="1"/></dx:p><dx:p/>', 0),
        ("<dx:p/>" + table(["<dx:p/>" + table(["<dx:p/>"]) + "<dx:p/>"]) + "<dx:p/>", 3),
        ("<dx:p/><dx:p/>", 2),
    ]
    nodes, _ = parsed(spark, *[package(body) for body, _ in cases])
    listing = structure.listing(nodes)
    edits = spark.createDataFrame([(str(n), at) for n, (_, at) in enumerate(cases)], "doc_id string, idx int")
    done = E.delete_paragraphs(listing, edits, structure.deletion_guards(nodes))
    assert set(reasons(done)) == {"0", "1", "2", "3", "4", "5"}
    assert texts(done) == texts(E.Edited(listing, listing, listing))
    double = spark.createDataFrame([("5", 0), ("5", 1)], "doc_id string, idx int")
    assert reasons(E.delete_paragraphs(listing, double)) == {"5": "one edit per document and batch"}


FORMAT = "doc_id string, idx int, bold boolean, italic boolean, underline boolean, size_pt double, font string, alignment string, style string"


def test_format_paragraph(spark):
    body = p(r("hello", '<dx:color dx:val="112233"/>'), r(" more"), props='<dx:spacing dx:after="120"/><dx:jc dx:val="right"/>') + p(r("x"))
    nodes, _ = parsed(spark, package(body))
    listing, runs = structure.listing(nodes), structure.runs(nodes).drop("part")
    edits = spark.createDataFrame([("0", 0, True, None, None, 12.5, None, "center", "Heading1")], FORMAT)
    done, faces = E.format_paragraphs(listing, runs, edits)
    row = done.paragraphs.where("idx = 0").first()
    assert (row.style, row.alignment) == ("Heading1", "center")
    got = [(x.idx, x.text, x.bold, x.size_pt, x.color) for x in faces.orderBy("idx", "run").collect()]
    assert got == [(0, "hello", True, 12.5, "112233"), (0, " more", True, 12.5, None), (1, "x", None, None, None)]
    for bad in [
        ("0", 0, True, None, None, 12.3, None, None, None),
        ("0", 0, None, None, None, None, None, "middle", None),
        ("0", 0, None, None, None, None, None, None, None),
        ("0", 9, True, None, None, None, None, None, None),
    ]:
        refused, _ = E.format_paragraphs(listing, runs, spark.createDataFrame([bad], FORMAT))
        assert len(reasons(refused)) == 1
    for options in ({}, {"size_pt": 12.3}, {"alignment": "middle"}, {"font": " "}):
        with pytest.raises(ValueError):
            E.check_format(**options)


def test_story_edits(spark):
    base = frame(spark, {"a": ["alpha 🦀 beta", "second"], "b": ["one", "two", "three"]})
    insert = "doc_id string, position int, text string"
    done = E.insert_text(base, spark.createDataFrame([("a", 0, "PREFIX "), ("b", 5, "x\ry\rz")], insert))
    assert texts(done) == {"a": ["PREFIX alpha 🦀 beta", "second"], "b": ["one", "tx", "y", "zwo", "three"]}
    assert {x.doc_id: x.inserted_utf16 for x in done.audit.collect()} == {"a": 7, "b": 5}
    end = E.insert_text(base, spark.createDataFrame([("a", 21, "!"), ("b", 99, "x")], insert))
    assert texts(end)["a"] == ["alpha 🦀 beta", "second!"] and set(reasons(end)) == {"b"}
    cut = "doc_id string, start int, end int"
    gone = E.delete_range(base, spark.createDataFrame([("a", 6, 9), ("b", 2, 9)], cut))
    assert texts(gone) == {"a": ["alpha beta", "second"], "b": ["onhree"]}
    assert {x.doc_id: x.deleted_text for x in gone.audit.collect()} == {"a": "🦀 ", "b": "e\rtwo\rt"}
    tail = E.delete_range(base, spark.createDataFrame([("b", 5, 14)], cut))
    assert texts(tail)["b"] == ["one", "t"]
    assert len(reasons(E.delete_range(base, spark.createDataFrame([("a", 3, 3), ("b", 1, 99)], cut)))) == 2


def test_format_range(spark):
    base = frame(spark, {"a": ["alpha", "second paragraph"]})
    runs = spark.createDataFrame(
        [("a", 0, 0, "alpha", None, None), ("a", 1, 0, "second ", None, None), ("a", 1, 1, "paragraph", True, 9.0)],
        "doc_id string, idx int, run int, text string, bold boolean, size_pt double",
    ).selectExpr("*", "cast(null as boolean) italic", "cast(null as string) underline", "cast(null as string) font")
    edits = spark.createDataFrame(
        [("a", 6, 15, True, None, None, 15.5, None, "center", None)], FORMAT.replace("idx int", "start int, end int")
    )
    done, faces = E.format_range(base, runs, edits)
    assert [(x.idx, x.alignment) for x in done.paragraphs.orderBy("idx").collect()] == [(0, None), (1, "center")]
    got = [(x.idx, x.run, x.text, x.bold, x.size_pt) for x in faces.orderBy("idx", "run").collect()]
    assert got == [
        (0, 0, "alpha", None, None),
        (1, 0, "second ", True, 15.5),
        (1, 1, "pa", True, 15.5),
        (1, 2, "ragraph", True, 9.0),
    ]
    ranges = spark.createDataFrame([("a", 6, 15), ("a", 6, 20), ("a", 0, 0)], "doc_id string, lo int, hi int")
    mixed = formatting.range_formatting(positions(base), faces, ranges, ["bold", "size_pt"])
    assert {(m.lo, m.hi): (m.bold, m.size_pt) for m in mixed.collect()} == {
        (6, 15): (True, 15.5), (6, 20): (True, None), (0, 0): (None, None),
    }


def test_edits_in_order(spark):
    base = spark.createDataFrame(
        [(d, i, f"{d}{i}") for d in "abc" for i in range(4 if d != "c" else 1)], "doc_id string, idx int, text string"
    )
    edits = spark.createDataFrame(
        [("a", 7, 0), ("a", 3, 2), ("a", 9, 1), ("b", 1, 0), ("b", 2, 9), ("c", 1, 0)], "doc_id string, seq int, idx int"
    )
    done = E.in_order(base, edits, E.delete_paragraphs)
    got = sorted((r.doc_id, r.idx, r.text) for r in done.paragraphs.collect())
    # a: a2 goes, then a0, then a3. b and c: an edit is refused, so nothing changes.
    assert got == [("a", 0, "a1"), *[("b", i, f"b{i}") for i in range(4)], ("c", 0, "c0")]
    assert {r.doc_id for r in done.rejects.collect()} == {"b", "c"}
    assert [(r.seq, r.deleted_text) for r in done.audit.orderBy("seq").collect()] == [(1, "a2"), (2, "a0"), (3, "a3")]
    twice = E.in_order(base, spark.createDataFrame([("a", 1, 0), ("a", 1, 1)], "doc_id string, seq int, idx int"), E.delete_paragraphs)
    assert twice.paragraphs.count() == base.count() and twice.rejects.count() == 1
    assert E.in_order(base, edits.limit(0), E.delete_paragraphs).paragraphs.count() == base.count()
