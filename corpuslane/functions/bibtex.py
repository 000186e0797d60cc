"""BibTeX entries as rows, and their mapping to publications."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "r": "\u030a"}
SYMBOLS = {"\\ss": "ß", "\\ae": "æ", "\\oe": "œ", "\\o": "ø", "\\l": "ł", "\\aa": "å", "\\&": "&", "\\%": "%", "\\_": "_", "\\#": "#", "\\$": "$", "--": "–", "~": " "}
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
SCHEMA = "entry int, key string, type string, field string, value string"
#: Fields of a publication.
FIELDS = ("title", "author", "year", "month", "volume", "number", "pages", "publisher", "url", "booktitle", "journal")
_BLANK, _NAME, _KEY = re.compile(r"\s*"), re.compile(r"\s*([^\s=]+)\s*="), re.compile(r"\s*([^\s,{}]*)\s*,?")
_ENTRY, _FIELD, _BARE = re.compile(r"@\s*([A-Za-z]+)\s*([{(])"), re.compile(r"([A-Za-z][\w-]*)\s*="), re.compile(r"[^\s,#{}\"]+")
#: What braced() stops at, by what closes the value.
_STOPS = {"}": re.compile(r"[\\{}]"), '"': re.compile(r'[\\{}"]')}
_MARK, _LETTER, _COMMAND = re.compile(r"\\(['`^\"~=.])\s*(?:\{(\\?[A-Za-z])\}|(\\?[A-Za-z]))"), re.compile(r"\\([cvuHr])\s*(?:\{(\\?[A-Za-z])\}|(?<=\s)(\\?[A-Za-z]))"), re.compile(r"\\[A-Za-z]+\s*")
_SYMBOLS = [(re.compile(re.escape(k) + r"(?![A-Za-z])\s?" if k[-1].isalpha() else re.escape(k)), v) for k, v in SYMBOLS.items()]


def latex(text: str) -> str:
    """Accents and symbols as characters, braces dropped."""
    import unicodedata

    def accent(m: re.Match) -> str:
        base = (m[2] or m[3]).replace("\\i", "i").replace("\\j", "j")
        return unicodedata.normalize("NFC", base + ACCENTS[m[1]])

    if "\\" in text:
        text = _LETTER.sub(accent, _MARK.sub(accent, text))
        for p, v in _SYMBOLS:
            text = p.sub(v, text)
        text = _COMMAND.sub("", text)
    else:
        text = text.replace("--", SYMBOLS["--"]).replace("~", SYMBOLS["~"])
    return " ".join(text.replace("{", "").replace("}", "").split())


class _Reader:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def blank(self) -> None:
        self.i = _BLANK.match(self.s, self.i).end()

    def braced(self, close: str) -> str:
        """What stands up to close at depth 0; the opening one is behind."""
        depth, start = 0, self.i
        while m := _STOPS[close].search(self.s, self.i):
            c, self.i = m[0], m.end()
            if c == "\\":
                self.i += 1
                continue
            if depth == 0 and c == close:
                return self.s[start : self.i - 1]
            depth += (c == "{") - (c == "}")
        self.i = max(self.i, len(self.s))
        raise ValueError("unclosed value")

    def value(self, macros: dict[str, str]) -> str:
        """Parts joined by #: quoted, braced, digits, or the name of a macro."""
        out = ""
        while True:
            self.blank()
            c = self.s[self.i : self.i + 1]
            if c in ("{", '"'):
                self.i += 1
                out += self.braced("}" if c == "{" else '"')
            elif m := _BARE.match(self.s, self.i):
                self.i = m.end()
                out += macros.get(m[0].lower(), m[0])
            else:
                raise ValueError("value expected")
            self.blank()
            if self.s[self.i : self.i + 1] != "#":
                return out
            self.i += 1


def parse(text: str | None) -> list[tuple[int, str, str, str, str]]:
    """(entry, key, type, field, value) of every field; an entry with broken grammar gives the fields that can be read."""
    rows: list[tuple[int, str, str, str, str]] = []
    macros: dict[str, str] = {}
    for n, m in enumerate(_ENTRY.finditer(text or "")):
        kind = m[1].lower()
        r = _Reader(text)
        r.i = m.end()
        if kind in ("comment", "preamble"):
            continue
        if kind == "string":
            if name := _NAME.match(text, r.i):
                r.i = name.end()
                try:
                    macros[name[1].lower()] = r.value(macros)
                except ValueError:
                    pass
            continue
        key = _KEY.match(text, r.i)
        r.i = key.end()
        try:
            while True:
                r.blank()
                f = _FIELD.match(text, r.i)
                if not f:
                    break
                r.i = f.end()
                rows.append((n, key[1], kind, f[1].lower(), latex(r.value(macros))))
                r.blank()
                if text[r.i : r.i + 1] != ",":
                    break
                r.i += 1
        except ValueError:
            end = text.find("\n@", m.end())
            block = text[r.i : end if end > 0 else len(text)]
            rows += [(n, key[1], kind, a.lower(), latex(b)) for a, b in re.findall(r"(\w+)\s*=\s*[{\"]([^{}\"\n]*)[}\"]", block)]
    return rows


def authors(value: str) -> list[tuple[str, str]]:
    """(first, last) of names joined by `and`: `Last, First`, `Last, Jr, First` or `First von Last`."""
    out = []
    for name in re.split(r"\s+and\s+", value.strip()):
        parts = [p.strip() for p in name.split(",")]
        if len(parts) == 2:
            out.append((parts[1], parts[0]))
        elif len(parts) >= 3:
            out.append((parts[2], f"{parts[0]} {parts[1]}"))
        elif words := name.split():
            low = next((i for i, w in enumerate(words[:-1]) if w[:1].islower()), len(words) - 1)
            out.append((" ".join(words[:low]), " ".join(words[low:])))
    return out


def entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entry, cite_key, type, field, value) of every field in the texts."""
    data = rows.select(F.col(key).alias("id"), F.col(text).alias("t"))
    id_type = data.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, found = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in parse(t):
                    ids.append(k)
                    found.append(r)
            columns = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.string()) for c in columns[1:]]], names=["id", "entry", "cite_key", "type", "field", "value"])

    return data.mapInArrow(run, f"id {id_type}, entry int, cite_key string, type string, field string, value string").withColumnRenamed("id", key)


def wide(rows: DataFrame, key: str, text: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, entry, cite_key, type, and fields) of every entry that has a field, read as its text is: nothing is grouped.

    Of a field that stands twice in an entry the larger value holds.
    """
    data = rows.select(F.col(key).alias("id"), F.col(text).alias("t"))
    id_type = data.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, found = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                each: dict[int, dict] = {}
                for n, cite_key, kind, field, value in parse(t):
                    e = each.setdefault(n, {"entry": n, "cite_key": cite_key, "type": kind, "fields": {}})["fields"]
                    e[field] = max(value, e.get(field, value))
                ids += [k] * len(each)
                found += each.values()
            head = [pa.array([e["entry"] for e in found], pa.int32()), *[pa.array([e[c] for e in found], pa.string()) for c in ("cite_key", "type")]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *head, *[pa.array([e["fields"].get(f) for e in found], pa.string()) for f in fields]], names=["id", "entry", "cite_key", "type", *fields])

    return data.mapInArrow(run, f"id {id_type}, entry int, cite_key string, type string, " + ", ".join(f"`{f}` string" for f in fields)).withColumnRenamed("id", key)


def publications(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row an entry: title, author, year, month, volume, number, pages (first, last), publisher, url, parent title."""
    month = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in MONTHS.items() for x in p]), F.lower(F.substring("month", 1, 3))), F.expr("try_cast(month as int)"))
    page = lambda i: F.expr(f"try_cast(regexp_extract(pages, '([0-9]+)[^0-9]*([0-9]+)?', {i}) as int)")
    return wide(rows, key, text).select(key, "entry", "cite_key", "type", "title", "author", F.expr("try_cast(year as int)").alias("year"), month.alias("month"), F.expr("try_cast(volume as int)").alias("volume"), F.expr("try_cast(number as int)").alias("number"), page(1).alias("first_page"), page(2).alias("last_page"), "publisher", "url", F.coalesce("booktitle", "journal").alias("parent"))
