"""EPUB files as rows: reading the package record, and rewriting it in place.

Spark has no zip reader, so this is Arrow UDF territory: ``read_books`` takes a
``binaryFile`` frame; ``rewritten`` gives each file's new bytes. Rewriting changes only the
package document (and adds a cover): every other entry is copied as it is, in order, with
its own date, so equal input gives equal bytes.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions.text import NOTE
from bindery.operators.merge import TAG

#: Namespaces, font obfuscation methods, and covers by first bytes.
DC = "http://purl.org/dc/elements/1.1/"
OPF = "http://www.idpf.org/2007/opf"
CONTAINER = "urn:oasis:names:tc:opendocument:xmlns:container"
ENCRYPTION = "http://www.w3.org/2001/04/xmlenc#"
FONTS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
IMAGES = ((b"\xff\xd8\xff", "image/jpeg", ".jpg"), (b"\x89PNG\r\n\x1a\n", "image/png", ".png"), (b"GIF87a", "image/gif", ".gif"), (b"GIF89a", "image/gif", ".gif"))

#: Fixed value: no cover is larger.
MAX_IMAGE = 5 * 1024 * 1024

BOOK = (
    "title string, authors array<string>, isbn string, language string, description string, publisher string, "
    "date string, series string, series_number string, has_cover boolean, unverified boolean, "
    "subjects array<string>, error string"
)


class Unreadable(Exception):
    """Not a file that can be read, or one that must not be changed."""


class Package:
    """The package document of an EPUB."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
            container = ET.fromstring(self.zip.read("META-INF/container.xml"))
            self.path = container.find(f".//{{{CONTAINER}}}rootfile").get("full-path")
            self.raw = self.zip.read(self.path)
            self.root = ET.fromstring(self.raw)
        except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError) as error:
            raise Unreadable(f"not an EPUB: {error}") from None
        if "META-INF/encryption.xml" in self.zip.namelist():
            methods = ET.fromstring(self.zip.read("META-INF/encryption.xml")).iter(f"{{{ENCRYPTION}}}EncryptionMethod")
            if any(m.get("Algorithm") not in FONTS for m in methods):
                raise Unreadable("locked")
        self.meta = self.root.find(f"{{{OPF}}}metadata")
        self.manifest = self.root.find(f"{{{OPF}}}manifest")
        if self.meta is None:
            raise Unreadable("no metadata")

    def all(self, name: str) -> list:
        return [e for e in self.meta.iter(f"{{{DC}}}{name}") if (e.text or "").strip()]

    def first(self, name: str) -> str | None:
        return next(((e.text or "").strip() for e in self.all(name)), None)

    def named(self, name: str) -> list:
        return [m for m in self.meta.findall(f"{{{OPF}}}meta") if m.get("name") == name]

    def refining(self, of: str, kind: str) -> str | None:
        found = (m for m in self.meta.findall(f"{{{OPF}}}meta") if m.get("refines") == f"#{of}" and m.get("property") == kind)
        return next(((m.text or "").strip() for m in found), None)

    def collection(self):
        for m in self.meta.findall(f"{{{OPF}}}meta"):
            if m.get("property") == "belongs-to-collection" and (m.text or "").strip():
                if self.refining(m.get("id") or "", "collection-type") in (None, "series"):
                    return m
        return None

    def series(self) -> tuple[str | None, str | None]:
        name = next((m.get("content") for m in self.named("calibre:series") if m.get("content")), None)
        number = next((m.get("content") for m in self.named("calibre:series_index") if m.get("content")), None)
        if name is None and (group := self.collection()) is not None:
            name = group.text.strip()
            number = number or self.refining(group.get("id") or "", "group-position")
        return name, plain_number(number) if number else None

    def isbn(self) -> str | None:
        found = [n for e in self.all("identifier") if (n := isbn_of(e.text, e.get(f"{{{OPF}}}scheme")))]
        return next((n for n in found if len(n) == 13), found[0] if found else None)

    def has_cover(self) -> bool:
        ids = {m.get("content") for m in self.named("cover")}
        items = list(self.manifest) if self.manifest is not None else []
        return any(i.get("id") in ids or "cover-image" in (i.get("properties") or "").split() for i in items)

    def subjects(self) -> list[str]:
        return [(e.text or "").strip() for e in self.all("subject")]

    def row(self) -> dict:
        series, number = self.series()
        subjects, text = self.subjects(), self.first("description")
        return {
            "title": self.first("title"), "authors": [e.text.strip() for e in self.all("creator")], "isbn": self.isbn(),
            "language": self.first("language"), "description": text, "publisher": self.first("publisher"),
            "date": self.first("date"), "series": series, "series_number": number, "has_cover": self.has_cover(),
            "unverified": TAG in subjects or bool(text and text.endswith((NOTE, f"<p>{NOTE}</p>"))),
            "subjects": [s for s in subjects if not s.startswith(TAG.partition(":")[0] + ":")], "error": None,
        }


def plain_number(number: str) -> str:
    """A position without needless zeros; what is no number stays as it is."""
    try:
        return f"{float(number):g}"
    except ValueError:
        return number.strip()


def isbn_of(text: str | None, scheme: str | None = None) -> str | None:
    """The ISBN that an identifier states, by prefix, scheme or form."""
    bare = re.sub(r"[-\s]", "", re.sub(r"(?i)^(urn:isbn:|isbn:)", "", (text or "").strip())).upper()
    if re.fullmatch(r"97[89]\d{10}|\d{9}[\dX]", bare):
        return bare
    return bare if "isbn" in (scheme or "").lower() and len(bare) in (10, 13) else None


def image_type(body: bytes) -> tuple[str, str] | None:
    """Media type and ending of a cover by its first bytes; None for what is no image or is
    larger than any cover."""
    if len(body) > MAX_IMAGE:
        return None
    return next(((kind, ending) for start, kind, ending in IMAGES if body.startswith(start)), None)


def read_one(content: bytes) -> dict:
    try:
        return Package(content).row()
    except Unreadable as error:
        return {"error": str(error)}


def carried(rows: DataFrame, names) -> str:
    """Columns that a function of rows hands on as they are, for its schema."""
    return "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in names)


def read_books(files: DataFrame, *kept: str) -> DataFrame:
    """(path, content, ...) -> path and the fields of ``BOOK``; ``error`` where unreadable. The
    kept columns go with their rows, so that no join by path has to bring them back."""
    names = [part.split()[0] for part in re.sub(r"array<string>", "list", BOOK).split(", ")]

    def run(batches):
        for batch in batches:
            rows = [read_one(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"]} | {n: [r.get(n) for r in rows] for n in names} | {n: batch[n] for n in kept})

    return files.select("path", "content", *kept).mapInPandas(run, f"path string, {BOOK}{carried(files, kept)}")


def _new(package: Package, name: str, text: str):
    """A new element of the record, behind the last of its kind of namespace: metas follow."""
    place = max((n + 1 for n, e in enumerate(package.meta) if str(e.tag).startswith(f"{{{DC}}}")), default=0)
    element = ET.Element(f"{{{DC}}}{name}")
    element.text = text
    package.meta.insert(place, element)
    return element


def _set_first(package: Package, name: str, value: str | None) -> None:
    value = (value or "").strip()
    if not value:
        return
    held = list(package.meta.iter(f"{{{DC}}}{name}"))
    if held:
        held[0].text = value
    else:
        _new(package, name, value)


def _set_authors(package: Package, authors: list[str]) -> None:
    wanted = [a.strip() for a in authors if a and a.strip()]
    held = package.all("creator")
    if not wanted:
        return
    for element, author in zip(held, wanted):
        element.text = author
    for extra in held[len(wanted) :]:
        package.meta.remove(extra)
        for m in package.meta.findall(f"{{{OPF}}}meta"):
            if extra.get("id") and m.get("refines") == f"#{extra.get('id')}":
                package.meta.remove(m)
    for author in wanted[len(held) :]:
        _new(package, "creator", author)


def _set_isbn(package: Package, isbn: str) -> None:
    """The identifier that says it is an ISBN, or a new one, states this ISBN as a URN; one that
    states it already, in whatever form, stays as it is written."""
    scheme_of = lambda e: e.get(f"{{{OPF}}}scheme") or ""
    stating = (e for e in package.all("identifier") if re.match("(?i)urn:isbn:", e.text.strip()) or "isbn" in scheme_of(e).lower())
    target, wanted = next(stating, None), isbn_of(isbn)
    known = None if target is None else isbn_of(target.text, scheme_of(target))
    if wanted is None or known == wanted:
        return
    if target is None:
        target = _new(package, "identifier", "")
    target.attrib.pop(f"{{{OPF}}}scheme", None)
    target.text = f"urn:isbn:{wanted}"


def _state(package: Package, value: str | None, attribute: str | None = None, **marks: str) -> None:
    """Make the first meta with these marks say ``value``, as its text or an attribute; with
    None, take all of them off."""
    held = [m for m in package.meta.findall(f"{{{OPF}}}meta") if marks.items() <= m.attrib.items()]
    if value is None:
        for m in held:
            package.meta.remove(m)
        return
    one = held[0] if held else ET.SubElement(package.meta, f"{{{OPF}}}meta", marks)
    if attribute:
        one.set(attribute, value)
    else:
        one.text = value


def _named(package: Package, element) -> str:
    """An element's id, given one that no other has if it has none."""
    if not element.get("id"):
        taken = {e.get("id") for e in package.root.iter()}
        element.set("id", next(n for k in itertools.count(1) if (n := "series" if k == 1 else f"series-{k}") not in taken))
    return element.get("id")


def _set_series(package: Package, series: str | None, number: str | None, drop: bool) -> None:
    """Series and position in both encodings: the named metas, and the EPUB 3 collection, which
    is made for a series that has none."""
    group = package.collection()
    if series:
        _state(package, series, "content", name="calibre:series")
        if group is None:
            group = ET.SubElement(package.meta, f"{{{OPF}}}meta", property="belongs-to-collection")
        group.text = series
        _state(package, "series", refines=f"#{_named(package, group)}", property="collection-type")
    if number or drop:
        place = plain_number(number) if number else None
        _state(package, place, "content", name="calibre:series_index")
        if group is not None:
            _state(package, place, refines=f"#{_named(package, group)}", property="group-position")


def _set_tag(package: Package, on: bool) -> None:
    tagged = [e for e in package.all("subject") if e.text.strip() == TAG]
    if on and not tagged:
        _new(package, "subject", TAG)
    for e in tagged if not on else []:
        package.meta.remove(e)


def _add_cover(package: Package, cover: bytes) -> tuple[str, bytes] | None:
    kind = image_type(cover)
    if kind is None or package.has_cover() or package.manifest is None:
        return None
    folder = package.path.rpartition("/")[0]
    name = f"cover-{hashlib.md5(cover).hexdigest()[:8]}{kind[1]}"
    # Only manifests of EPUB 3 have properties.
    newer = {"properties": "cover-image"} if package.root.get("version", "").strip().startswith("3") else {}
    ET.SubElement(package.manifest, f"{{{OPF}}}item", {"id": name.partition(".")[0], "href": name, "media-type": kind[0]} | newer)
    ET.SubElement(package.meta, f"{{{OPF}}}meta", name="cover", content=name.partition(".")[0])
    return (f"{folder}/{name}" if folder else name), cover


def rewrite_one(content: bytes, edit: dict, genres: list[str] = (), cover: bytes | None = None) -> bytes:
    """The file with an edit applied; the same bytes if it changes nothing."""
    package = Package(content)
    before = ET.tostring(package.root)
    for name in ("title", "publisher", "date", "language", "description"):
        _set_first(package, name, edit.get(name))
    if edit.get("drop_description"):
        for e in list(package.meta.iter(f"{{{DC}}}description")):
            package.meta.remove(e)
    _set_authors(package, list(edit.get("authors") if edit.get("authors") is not None else []))
    _set_isbn(package, edit.get("isbn") or "")
    _set_series(package, edit.get("series"), edit.get("series_number"), bool(edit.get("drop_series_number")))
    if edit.get("unverified") is not None:
        _set_tag(package, bool(edit["unverified"]))
    taken = {s.casefold() for s in package.subjects()}
    for genre in (g.strip() for g in genres):
        if genre and genre.casefold() not in taken:
            _new(package, "subject", genre)
            taken.add(genre.casefold())
    image = _add_cover(package, cover) if cover else None
    if image is None and ET.tostring(package.root) == before:
        return content
    # Names keep the prefixes that the document declares; ``ns`` and a number is the writer's own.
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(package.raw), events=("start-ns",)):
        if uri and not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as target:
        for entry in package.zip.infolist():
            data = package.zip.read(entry)
            if entry.filename == package.path:
                data = ET.tostring(package.root, encoding="utf-8", xml_declaration=True)
            target.writestr(entry, data)
        if image is not None:
            target.writestr(zipfile.ZipInfo(image[0], (1980, 1, 1, 0, 0, 0)), image[1])
    return out.getvalue()


def rewritten(rows: DataFrame) -> DataFrame:
    """(path, content, edits, genres) and perhaps cover -> (path, content, error): new bytes of
    each file. A cover (binary, null for none) is added to a book that has none."""
    cover = F.col("cover") if "cover" in rows.columns else F.lit(None).cast("binary")

    def run(batches):
        for batch in batches:
            found = []
            for content, edit, genres, image in zip(batch["content"], batch["edits"], batch["genres"], batch["cover"]):
                try:
                    found.append((rewrite_one(content, edit or {}, list(genres) if genres is not None else [], image), None))
                except Unreadable as error:
                    found.append((content, str(error)))
            yield pd.DataFrame({"path": batch["path"], "content": [f[0] for f in found], "error": [f[1] for f in found]})

    chosen = rows.select("path", "content", "edits", "genres", cover.alias("cover"))
    return chosen.mapInPandas(run, "path string, content binary, error string")


def opf_values(xml, name: str):
    """All texts of an element in a package document held as a string column."""
    return F.filter(F.transform(F.xpath(xml, F.lit(f'//*[local-name()="{name}"]/text()')), lambda t: F.trim(t)), lambda t: t != "")
