"""Personal data in texts, disguised or not, by transducers that keep track of positions.

Four kinds are found in a text as it stands: e-mail addresses, IP addresses, card numbers and phone
numbers. These base spans always stay. Then transducers rewrite the text one after the other:
lookalike characters become the ASCII ones they stand for and invisible ones go; disguised marks
(``[at]``, ``(dot)``, ``&#64;``) become ``@`` and ``.``; spelled digits become digits; and spoken
addresses (``jane at mail dot example dot org``) are joined. Each transducer returns its edits, so
that a place in its output is a place in its input again. The same finders run on what comes out,
and each find is mapped back through all edits to the source characters it covers. It is added
unless it lies within base spans of its kind.

Finders and transducers run in time linear in the text: a finder begins at marks or at the start
of a run only, and no pattern gives back what it took.

Positions are code points from 0, ends exclusive. Spans are ordered by kind, as ``KINDS`` lists them,
then by start and end.

Defined results: a null text is empty, and an empty text has no spans. Rows with the same or a null
key are scanned one by one. Texts of any length are scanned whole. Other columns are not read by
``scan``; ``redact`` passes them through, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.tables import documents

KINDS = ("email", "ip", "card", "phone")
#: Digits of a card and of a phone number.
CARD, PHONE = (16, 19), (8, 15)

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("value", T.StringType()),
    ]
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` with a domain after it, back to where the run of name characters begins."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        domain = _DOMAIN.match(text, at + 1)
        while domain and begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            done = domain.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for found in _IP.finditer(text):
        parts = [p.lstrip("0") for p in found[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield found.span()


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the last but one counts double."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    least, most = CARD
    for found in _CARD.finditer(text):
        begin, end = found.span()
        if least <= end - begin < 2 * most:
            digits = _NO_DIGIT.sub("", found[0])
            if least <= len(digits) <= most and luhn(digits):
                yield begin, end


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if PHONE[0] <= len(_NO_DIGIT.sub("", found[0])) <= PHONE[1]:
            yield found.span()


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, ips, cards, phones)))

# Characters that look like ASCII ones, beyond those that Unicode itself decomposes to them.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "ϲ": "c", "ɑ": "a",
    "ɡ": "g", "ı": "i", "ℓ": "l", "。": ".", "‧": ".", "·": ".", "∙": ".", "⋅": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ",
}
#: Characters that are not seen: soft hyphen, zero-width blanks and joiners, marks of direction.
INVISIBLE = "­​‌‍‎‏⁠﻿"
# Digits as words, in English, German, French and Spanish.
DIGIT_WORDS = {
    "0": ("zero", "null", "zéro", "cero"),
    "1": ("one", "eins", "un", "uno"),
    "2": ("two", "zwei", "zwo", "deux", "dos"),
    "3": ("three", "drei", "trois", "tres"),
    "4": ("four", "vier", "quatre", "cuatro"),
    "5": ("five", "fünf", "cinq", "cinco"),
    "6": ("six", "sechs", "seis"),
    "7": ("seven", "sieben", "sept", "siete"),
    "8": ("eight", "acht", "huit", "ocho"),
    "9": ("nine", "neun", "neuf", "nueve"),
}
# What stands for the marks of an address, as a word.
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
MARK_WORDS = {".": ("dot", "punkt", "point", "punto"), "_": ("underscore",), "-": ("dash", "hyphen")}


@lru_cache(maxsize=1)
def lookalikes() -> dict[int, str]:
    """Code points to replace by one ASCII character each."""
    table = {ord(c): a for c, a in LOOKALIKES.items()}
    for low, high in ((0x600, 0x1100), (0x2000, 0x3100), (0xFE00, 0xFFF0), (0x1D400, 0x1D800)):
        for code in range(low, high):
            char = chr(code)
            digit = unicodedata.decimal(char, None)
            plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
            raised = unicodedata.decomposition(char).startswith(("<super>", "<sub>"))
            if len(plain) == 1 and plain.isascii() and plain.isprintable() and not raised:
                table.setdefault(code, plain)
    return table


@dataclass(frozen=True)
class Edits:
    """Where a transducer changed its input: ranges of the output and of the input, in order."""

    output: list[tuple[int, int]]
    source: list[tuple[int, int]]

    def begin(self, place: int) -> int:
        """Where the character at ``place`` of the output begins in the input."""
        k = bisect_right(self.output, (place, 1 << 62)) - 1
        if k < 0:
            return place
        return self.source[k][0] if place < self.output[k][1] else self.source[k][1] + place - self.output[k][1]

    def end(self, place: int) -> int:
        """Where the character before ``place`` of the output ends in the input."""
        k = bisect_right(self.output, (place - 1, 1 << 62)) - 1
        if k < 0:
            return place
        return self.source[k][1] if place <= self.output[k][1] else self.source[k][1] + place - self.output[k][1]


def rewritten(
    text: str, pattern: re.Pattern, output: Callable[[re.Match], list[tuple[int, int, str]]], lowered: str
) -> tuple[str, Edits]:
    """``text`` with ranges replaced: those that ``output`` gives for every match in ``lowered``, in order."""
    pieces, edits, done, length = [], Edits([], []), 0, 0
    for found in pattern.finditer(lowered):
        for begin, end, instead in output(found):
            begin = max(begin, done)
            pieces += (text[done:begin], instead)
            length += begin - done
            edits.output.append((length, length + len(instead)))
            edits.source.append((begin, end))
            length, done = length + len(instead), end
    return ("".join([*pieces, text[done:]]) if edits.source else text), edits


def whole(instead: str) -> Callable[[re.Match], list[tuple[int, int, str]]]:
    """Replaces all of a match."""
    return lambda found: [(*found.span(), instead)]


def any_of(words: tuple[str, ...]) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


# Patterns of what is in lower case. They begin with what they look for, so that a scan is quick; what
# stands before a match is looked at afterwards.
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_MARKS = re.compile(
    rf"[\[({{<] {{0,2}}(?:(?P<at>@|{any_of(AT_WORDS)})|(?P<dot>\.|{any_of(MARK_WORDS['.'])})) {{0,2}}[\])}}>] {{0,2}}"
    r"|(?P<at_code>&#64;|&#x40;|&commat;|%40)|(?P<dot_code>&#46;|&#x2e;|&period;)"
)
_DIGIT = {w: d for d, words in DIGIT_WORDS.items() for w in words}
_SPELLED = rf"(?:{any_of(tuple(_DIGIT))})(?!\w)"
_RUN = rf"{_SPELLED}(?:(?:[ -]|, ?){_SPELLED})*+"
_DIGITS = re.compile(rf"(?P<plus>plus +(?=[0-9]|{_SPELLED}))(?:{_RUN})?|{_RUN}")
_ONE = re.compile(_SPELLED)
_SPELLED_MARK = {w: mark for mark, words in MARK_WORDS.items() for w in (*words, mark)}
_MARK, _DOTS = any_of(tuple(_SPELLED_MARK)), (*MARK_WORDS["."], ".")
_DOT, _PART, _LABEL = any_of(_DOTS), rf"(?:[0-9]++|{_SPELLED})", "[a-z0-9-]++"
_SPOKEN_IP = re.compile(rf"(?<![\w.]){_PART}(?: (?:{_DOT}) {_PART}){{3}}")
_IN_IP = re.compile(rf" (?P<dot>{_DOT}) |(?P<digit>{_SPELLED})")
_SPOKEN_AT = re.compile(rf" (?:{any_of(AT_WORDS)}|@) (?=(?P<domain>{_LABEL}(?:(?:\.| (?:{_MARK}) ){_LABEL})++))")
_BETWEEN = re.compile(rf" (?P<mark>{_MARK}) ")
_LONGEST_MARK = max(map(len, _SPELLED_MARK))


def marks(found: re.Match) -> list[tuple[int, int, str]]:
    """A mark for a disguised one, with the blanks around its brackets."""
    begin, end = found.span()
    for _ in range(2 if found["at"] or found["dot"] else 0):
        begin -= begin > 0 and found.string[begin - 1] == " "
    return [(begin, end, "@" if found["at"] or found["at_code"] else ".")]


def digits(found: re.Match) -> list[tuple[int, int, str]]:
    """Digits for a run of digit words; a word alone counts between digits, or after a plus sign."""
    text, out = found.string, []
    begin, end = found.span()
    if begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
        return []
    if found["plus"]:
        out.append((begin, begin + len(found["plus"]), "+"))
        begin += len(found["plus"])
    words = [m.span() for m in _ONE.finditer(text, begin, end)]
    before = found["plus"] or text[max(0, begin - 2) : begin].rstrip(" .-")[-1:]
    inside = text[begin - 1 : begin] in " .-" and before.isdigit() and text[end : end + 2].lstrip(" .-")[:1].isdigit()
    if len(words) > 1 or found["plus"] or before == "+" or inside:
        # What lies between two words goes with the first of them.
        ends = [b for b, _ in words[1:]] + [end]
        out += [(b, stop, _DIGIT[text[b:e]]) for (b, e), stop in zip(words, ends)]
    return out


def spoken_ip(found: re.Match) -> list[tuple[int, int, str]]:
    return [(*m.span(), "." if m["dot"] else _DIGIT[m["digit"]]) for m in _IN_IP.finditer(found.string, *found.span())]


def namelike(name: str) -> bool:
    """Whether a name is no word: it has a letter, and a digit or mark before its last character."""
    return name[-1:].isalnum() and bool(re.search("[A-Za-z]", name) and re.search("[0-9._]", name[:-1]))


def spoken_address() -> Callable[[re.Match], list[tuple[int, int, str]]]:
    """Joins what stands before and after a spoken ``at``.

    That makes an address if some other mark is spoken too, or if the name is no plain word:
    `look at example.org` is none.
    """
    done = 0

    def output(found: re.Match) -> list[tuple[int, int, str]]:
        nonlocal done
        text, out = found.string, [(*found.span(), "@")]
        begin = found.start()
        while True:
            end = begin
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            space = text.rfind(" ", max(done, begin - _LONGEST_MARK - 2), max(begin - 1, 0)) if begin < end else -1
            mark = _SPELLED_MARK.get(text[space + 1 : begin - 1]) if space > 0 and text[begin - 1] == " " else None
            if mark is None or text[space - 1] not in _LOCAL:
                break
            out.append((space, begin, mark))
            begin = space
        name = text[begin : found.start()]
        done = found.start()
        parts = [(*m.span(), _SPELLED_MARK[m["mark"]]) for m in _BETWEEN.finditer(text, found.end(), found.end("domain"))]
        if begin == end or not (parts or len(out) > 1 or namelike(name)):
            return []
        done = found.end("domain")
        return sorted(out + parts)

    return output


def normalised(text: str) -> tuple[str, list[Edits]]:
    """The text that all transducers leave, and their edits in the order they were made."""
    made = []

    def then(pattern: re.Pattern, output: Callable[[re.Match], list[tuple[int, int, str]]]) -> None:
        nonlocal text
        lowered = text.lower()
        # A few letters take more room in lower case; places must be the text's own.
        lowered = lowered if len(lowered) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        text, edits = rewritten(text, pattern, output, lowered)
        if edits.source:
            made.append(edits)

    if not text.isascii():
        held, table = set(text), lookalikes()
        if not table.keys().isdisjoint(map(ord, held)):
            text = text.translate(table)  # one character for each, so all places stay
        if not held.isdisjoint(INVISIBLE):
            then(_INVISIBLE, whole(""))
    then(_MARKS, marks)
    then(_DIGITS, digits)
    if any(f" {word} " in text.lower() for word in _DOTS):
        then(_SPOKEN_IP, spoken_ip)
    then(_SPOKEN_AT, spoken_address())
    return text, made


def spans(text: str) -> list[tuple[str, int, int, bool, str]]:
    """``(kind, start, end, base, value)`` of what a text holds; ``value`` is the identifier without disguise."""
    base = {kind: list(find(text)) for kind, find in FINDERS.items()}
    out = [(kind, *span, True, text[slice(*span)]) for kind in KINDS for span in base[kind]]
    plain, made = normalised(text)
    if plain is not text:
        for kind, find in FINDERS.items():
            held = base[kind]
            for begin, end in find(plain):
                start, stop = begin, end
                for edits in reversed(made):
                    start, stop = edits.begin(start), edits.end(stop)
                at = bisect_right(held, (start, 1 << 62)) - 1
                if at < 0 or held[at][1] < stop:
                    out.append((kind, start, stop, False, plain[begin:end]))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), *s[1:]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, found)``: an array of ``SPAN`` for every row."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("found", T.ArrayType(SPAN))])
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())])
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [[dict(zip(SPAN.names, s)) for s in spans(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cells, kind)], names=schema.fieldNames())

    read = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(find, schema).withColumnRenamed("key", key)


def masked(text: str) -> str:
    """A text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    pieces, done = [], 0
    for kind, start, end, *_ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if start >= done:
            pieces += (text[done:start], f"[{kind}]")
        done = max(done, end)
    return "".join(pieces) + text[done:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data masked; null texts stay null."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: None if t is None else masked(t))

    return docs.withColumn(text, mask(F.col(text).cast("string")))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    base = F.filter("found", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
