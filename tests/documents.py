"""Small packages for tests, written with an unusual namespace prefix on purpose."""

from __future__ import annotations

import io
import zipfile

from scriptorium.schema import CONTENT_TYPE, CONTENT_TYPES_NS, OFFICE_REL_NS, PACKAGE_REL_NS, REL, WORD_NS

PRESERVED = bytes(range(250, 256)) + b"kept as it is"


def p(*runs: str, props: str = "") -> str:
    inner = "".join(runs)
    return f"<dx:p>{f'<dx:pPr>{props}</dx:pPr>' if props else ''}{inner}</dx:p>"


def r(text: str, props: str = "") -> str:
    before = f"<dx:rPr>{props}</dx:rPr>" if props else ""
    return f'<dx:r>{before}<dx:t xml:space="preserve">{text}</dx:t></dx:r>'


def style(name: str) -> str:
    return f'<dx:pStyle dx:val="{name}"/>'


def number(num: int, level: int) -> str:
    return f'<dx:numPr><dx:ilvl dx:val="{level}"/><dx:numId dx:val="{num}"/></dx:numPr>'


def table(*rows: list[str]) -> str:
    cells = ("".join(f"<dx:tc>{cell}</dx:tc>" for cell in row) for row in rows)
    return "<dx:tbl>" + "".join(f"<dx:tr>{row}</dx:tr>" for row in cells) + "</dx:tbl>"


def archive(entries: list[tuple[str, bytes | str]]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in entries:
            package.writestr(name, data)
    return buffer.getvalue()


def package(body: str, extra: dict[str, tuple[str, str]] | None = None, links: dict[str, str] | None = None) -> bytes:
    """``extra`` maps part names to (kind, xml); ``links`` relationship ids to targets."""
    extra, links = extra or {}, links or {}
    overrides = f'<Override PartName="/word/document.xml" ContentType="{CONTENT_TYPE["document"]}"/>'
    related = ""
    entries: list[tuple[str, bytes | str]] = []
    for at, (name, (kind, xml)) in enumerate(extra.items(), start=1):
        overrides += f'<Override PartName="/{name}" ContentType="{CONTENT_TYPE[kind]}"/>'
        related += f'<Relationship Id="rId{at}" Type="{REL[kind]}" Target="{name.removeprefix("word/")}"/>'
        entries.append((name, xml))
    for name, target in links.items():
        related += (
            f'<Relationship Id="{name}" Type="{REL["hyperlink"]}" '
            f'Target="{target.replace("&", "&amp;")}" TargetMode="External"/>'
        )
    entries += [
        (
            "[Content_Types].xml",
            f'<Types xmlns="{CONTENT_TYPES_NS}"><Default Extension="rels" ContentType="{CONTENT_TYPE["relationships"]}"/>'
            f'<Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>',
        ),
        (
            "_rels/.rels",
            f'<Relationships xmlns="{PACKAGE_REL_NS}"><Relationship Id="rId1" Type="{REL["officeDocument"]}" Target="word/document.xml"/></Relationships>',
        ),
        (
            "word/document.xml",
            f'<dx:document xmlns:dx="{WORD_NS}" xmlns:r="{OFFICE_REL_NS}"><dx:body>{body}</dx:body></dx:document>',
        ),
        ("extras/ledger.dat", PRESERVED),
    ]
    if related:
        entries.append(
            ("word/_rels/document.xml.rels", f'<Relationships xmlns="{PACKAGE_REL_NS}">{related}</Relationships>')
        )
    return archive(entries)


def word_part(root: str, inner: str) -> str:
    return f'<w:{root} xmlns:w="{WORD_NS}">{inner}</w:{root}>'


def style_xml(style_id: str, name: str, more: str = "", default: bool = False) -> str:
    flag = ' w:default="1"' if default else ""
    return f'<w:style w:type="paragraph"{flag} w:styleId="{style_id}"><w:name w:val="{name}"/>{more}</w:style>'


def level_xml(level: int, fmt: str, text: str, start: int = 1) -> str:
    return (
        f'<w:lvl w:ilvl="{level}"><w:start w:val="{start}"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/></w:lvl>'
    )


STYLES = word_part(
    "styles",
    '<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="21"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr>'
    '<w:spacing w:after="100" w:line="300" w:lineRule="auto"/></w:pPr></w:pPrDefault></w:docDefaults>'
    + style_xml("Prose", "Normal", default=True)
    + style_xml(
        "Species",
        "heading 1",
        '<w:basedOn w:val="Prose"/><w:pPr><w:keepLines/><w:spacing w:before="300"/><w:outlineLvl w:val="0"/></w:pPr>',
    )
    + style_xml("Habit", "Habit", '<w:basedOn w:val="Species"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr>')
    + style_xml("Dash", "List Dash", '<w:pPr><w:numPr><w:numId w:val="7"/></w:numPr></w:pPr>')
    + style_xml("DashTight", "List Dash Tight", '<w:basedOn w:val="Dash"/><w:pPr><w:keepNext/></w:pPr>'),
)
NUMBERING = word_part(
    "numbering",
    f'<w:abstractNum w:abstractNumId="3">{level_xml(0, "bullet", "*")}{level_xml(1, "decimal", "%2)", 4)}</w:abstractNum>'
    f'<w:abstractNum w:abstractNumId="5">{level_xml(0, "decimal", "%1.", 2)}</w:abstractNum>'
    '<w:num w:numId="7"><w:abstractNumId w:val="3"/></w:num>'
    '<w:num w:numId="9"><w:abstractNumId w:val="5"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="6"/></w:lvlOverride></w:num>',
)
ENDNOTES = word_part(
    "endnotes",
    '<w:endnote w:type="separator" w:id="0"><w:p><w:r><w:separator/></w:r></w:p></w:endnote>'
    '<w:endnote w:id="4"><w:p><w:r><w:endnoteRef/></w:r><w:r><w:t xml:space="preserve"> Counted at dawn, by boat.</w:t></w:r></w:p></w:endnote>',
)
FOOTER = word_part("ftr", "<w:p><w:r><w:t>Marsh survey, boat two</w:t></w:r></w:p>")
LINK = "https://marsh.test/map?reed=1&pool=7"
RINGED = (
    '<dx:rFonts dx:ascii="Georgia"/><dx:i/><dx:color dx:val="1F6F3A"/><dx:sz dx:val="19"/>'
    '<dx:highlight dx:val="cyan"/><dx:vertAlign dx:val="subscript"/>'
)


def field(instruction: str, *shown: str) -> str:
    """A field in its long form."""
    mark = lambda kind: f'<dx:r><dx:fldChar dx:fldCharType="{kind}"/></dx:r>'
    code = f'<dx:r><dx:instrText xml:space="preserve">{instruction}</dx:instrText></dx:r>'
    return mark("begin") + code + mark("separate") + "".join(shown) + mark("end")


GUIDE_BODY = "".join(
    [
        p(r("Birds of the marsh"), props=style("Title")),
        p(r("Herons"), props=style("Species")),
        p(
            r("They wade "),
            r("slowly", "<dx:b/>"),
            r(", mostly "),
            r("alone_", "<dx:i/>"),
            r("2", RINGED),
            '<dx:r><dx:endnoteReference dx:id="4"/></dx:r>',
            r("!"),
        ),
        p(r("Bitterns"), props=style("Habit")),
        p(r("reed"), props=style("DashTight")),
        p(r("old reed"), props=number(7, 1)),
        p(r("Look"), props=number(9, 0)),
        p(r("Listen"), props=number(9, 0)),
        table(
            [p(r("Bird")), p(r("Count")), p(r("Pool"))],
            [p(r("teal|duck")), p(r("4")) + p(r("5")), p(r("north")) + table([p(r("inner"))])],
        ),
        p(
            r("On the "),
            f'<dx:hyperlink r:id="rMap">{r("map")}</dx:hyperlink>',
            "<dx:r><dx:t>;</dx:t><dx:br/><dx:t>by boat</dx:t></dx:r>",
        ),
        p(
            r("Nests"),
            props='<dx:jc dx:val="right"/><dx:ind dx:right="240" dx:firstLine="480"/><dx:outlineLvl dx:val="3"/>',
        ),
        p(r("after "), field('HYPERLINK "https://rings.test/" \\l "old"', r("rings "), field("PAGE", r("12")))),
    ]
)


def guide() -> bytes:
    return package(
        GUIDE_BODY,
        {
            "word/styles.xml": ("styles", STYLES),
            "word/numbering.xml": ("numbering", NUMBERING),
            "word/endnotes.xml": ("endnotes", ENDNOTES),
            "word/footer1.xml": ("footer", FOOTER),
        },
        {"rMap": LINK},
    )


def files(spark, *packages: bytes):
    """The packages as ``(doc_id, content)`` rows, numbered from 0."""
    rows = [(str(at), bytearray(content)) for at, content in enumerate(packages)]
    return spark.createDataFrame(rows, "doc_id string, content binary")


def parsed(spark, *packages: bytes):
    """Stored element rows and relationships of the packages."""
    from scriptorium.lineage import stored
    from scriptorium.sources.packages import open_packages
    from scriptorium.sources.relationships import relationships
    from scriptorium.sources.xml_nodes import accepted, ingest_nodes

    nodes = stored(accepted(ingest_nodes(open_packages(files(spark, *packages)).parts)))
    return nodes, relationships(nodes)
