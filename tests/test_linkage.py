"""Rules of the linkage engine on golden rows and small fixtures."""

import difflib
import http.server
import io
import json
import socket
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from bindery.functions import similarity as S
from bindery.functions import text as X
from bindery.operators import delivery, merge, state, walk
from bindery.operators import pool as P
from bindery.operators import ranking as R
from bindery.options import Options, load, seconds
from bindery.sources import epub
from bindery.storage import shared_dir


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i")
    return [r[0] for r in rows.select(f(F.col("v"))).collect()]


def candidate(book, pos, source, title, authors, series=None, number=None, isbn=None, date=None, publisher=None):
    return (book, pos, source, title, authors, [], series, number, None, None, isbn, None, publisher, date, None, None)


def test_comparison_keys_are_the_same_natively_and_in_python(spark):
    words = ["Brontë", "Straße", "The Wind & the Willows", "The Infirmary", "A", None, "!!!", "Война и мир", "ﬁn ½ Ĳssel", "İstanbul", "हिन्दी"]
    assert column(spark, words, X.comparison_key) == [X.comparison_text(w) for w in words]


def test_name_keys(spark):
    assert column(spark, ["Ross, L. J.", "LJ Ross", "Ursula K. Le Guin"], X.name_key) == ["lj ross", "lj ross", "ursula k le guin"]


def test_notes_come_off_as_they_went_on(spark):
    blurbs = [None, "Plain", "<p>Markup</p>", "<https://example.com>"]
    assert column(spark, blurbs, lambda c: X.unmarked(X.noted(c))) == blurbs


def test_ratio_is_difflibs(spark):
    pairs = [("cragside", "the infirmary"), ("the infirmary", "cragside"), ("", "a"), ("x" * 200, "x" * 199 + "y")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    got = [r[0] for r in rows.select(S.ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]


def test_works_keep_one_standard_record(spark):
    rows = [
        candidate(1, 0, "b", "Cragside", ["L. J. Ross"], date="2018"),
        candidate(1, 1, "a", "Cragside: A DCI Ryan Mystery", ["Ross, L. J."], date="2017", series="DCI Ryan", number="6"),
        candidate(1, 2, "a", "Cragside", ["L. K. Ross"], date="2001"),
        candidate(1, 3, "a", None, [], date="2001"),
        candidate(1, 4, "a", None, [], date="2001"),
    ]
    got = P.standard_records(spark.createDataFrame(rows, P.SCHEMA)).orderBy("pos").collect()
    assert [(r.pos, r.title, r.date) for r in got] == [
        (0, "Cragside: A DCI Ryan Mystery", "2017"), (2, "Cragside", "2001"), (3, None, "2001"), (4, None, "2001"),
    ]


def test_two_placements_are_two_works_and_the_unplaced_a_third(spark):
    rows = [candidate(1, i, "a", "T", ["A B"], *p) for i, p in enumerate([("S", "1"), ("S", "2"), (None, None), (None, None)])]
    assert P.standard_records(spark.createDataFrame(rows, P.SCHEMA)).count() == 3


def test_dedupe_by_isbn_then_key(spark):
    rows = [
        candidate(1, 0, "a", "T", ["A B"], isbn="978-0-306-40615-7"),
        candidate(1, 1, "b", "Other", ["C"], isbn="9780306406157"),
        candidate(1, 2, "b", "T", ["A B"], date="2001"),
        candidate(1, 3, "b", "T!", ["B, A"], date="2001-02"),
        candidate(1, 4, "b", "", ["B"]),
        candidate(1, 5, "b", "", ["B"]),
    ]
    assert [r.pos for r in P.dedupe(spark.createDataFrame(rows, P.SCHEMA)).orderBy("pos").collect()] == [0, 2, 4, 5]


def test_the_walk_stops_early_and_holds_what_failed(spark):
    books = spark.createDataFrame([(i, "Cragside", ["LJ Ross"], None, None) for i in (1, 2, 3)], "book_id long, title string, authors array<string>, language string, date string")
    one = spark.createDataFrame([candidate(1, 0, "a", "Cragside", ["LJ Ross"]), candidate(2, 0, "a", "Else", ["LJ Ross"])], P.SCHEMA)
    two = spark.createDataFrame([candidate(i, 0, "b", "Cragside", ["LJ Ross"]) for i in (1, 2, 3)], P.SCHEMA)
    errors = spark.createDataFrame([(3, "a", "timeout")], walk.ERRORS)
    got = {r.book_id: r for r in walk.routed(walk.gather(books, [("a", one), ("b", two)], errors)).collect()}
    assert got[1].exited and got[1].route == "write" and got[1].source == "a"
    assert not got[2].exited and got[2].title == "Cragside"
    assert got[3].route == "hold"


def test_isbn_walk(spark):
    books = spark.createDataFrame([(1, "Cragside", "9780306406157"), (2, "Other", "9780306406157"), (3, "X", "9780306406157"), (4, "Y", None)], "book_id long, title string, isbn string")
    hits = spark.createDataFrame([candidate(1, 0, "a", "Cragside", ["L"]), candidate(2, 0, "a", "Cragside", ["L"])], P.SCHEMA)
    got = {r.book_id: r.outcome for r in walk.by_isbn(books, [("a", hits)]).collect()}
    assert got == {1: "match", 2: "contradicted", 3: "missed"}


def test_bands_refuse_a_low_singleton_bar():
    with pytest.raises(ValueError):
        R.Bands(strong=0.9, singleton=0.8)


def test_matches_best_wins(spark):
    old = spark.createDataFrame([("k", "a", 0.9, "t0", "x")], state.MATCHES)
    new = spark.createDataFrame([("k", "b", 0.9, "t1", "y"), ("n", "b", 0.1, "t1", "z")], state.MATCHES)
    assert {(r.book_key, r.source) for r in state.best_matches(old, new, ["a", "b"]).collect()} == {("k", "a"), ("n", "b")}
    assert {(r.book_key, r.source) for r in state.best_matches(old, new, ["b", "a"]).collect()} == {("k", "b"), ("n", "b")}


def test_state_versions_are_idempotent_by_batch(spark):
    kept = state.StateTable(spark, shared_dir(spark, "state"), state.GENRES)
    assert kept.read().count() == 0
    assert kept.replace(spark.createDataFrame([("a", "g", "G", "g")], state.GENRES), 7)
    assert not kept.replace(spark.createDataFrame([], state.GENRES), 7)
    assert kept.read().count() == 1
    kept.reset()
    assert kept.read().count() == 0


def test_genres_add_only(spark):
    rows = spark.createDataFrame([(["Crime"], ["crime ", "Thriller", "thriller", ""])], "own array<string>, wanted array<string>")
    assert rows.select(merge.genres_to_add(F.col("own"), F.col("wanted"))).first()[0] == ["Thriller"]


def test_free_names(spark):
    wanted = spark.createDataFrame([(1, "a.epub"), (2, "a.epub"), (3, "b.epub")], "id int, name string")
    taken = spark.createDataFrame([("a.epub",), ("a (3).epub",)], "name string")
    got = {r.id: r.free for r in delivery.free_names(wanted, taken, order=["id"]).collect()}
    assert got == {1: "a (2).epub", 2: "a (4).epub", 3: "b.epub"}


def test_free_names_where_numbered_names_are_wanted(spark):
    names = ["a.epub", "a.epub", "a (2).epub", "a (2).epub", "a (2) (2).epub", "a.epub", "b", "b", "b (2)", ".epub", ".epub", "a (02).epub"]
    wanted = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    taken = spark.createDataFrame([("a (4).epub",), ("b",), ("c.epub",)], "name string")
    got = {r.id: r.free for r in delivery.free_names(wanted, taken, order=["id"]).collect()}
    assert got == {
        0: "a.epub", 1: "a (3).epub", 2: "a (2).epub", 3: "a (2) (3).epub", 4: "a (2) (2).epub", 5: "a (5).epub",
        6: "b (3)", 7: "b (4)", 8: "b (2)", 9: ".epub", 10: " (2).epub", 11: "a (02).epub",
    }
    assert len(set(got.values())) == len(names)


def test_quota_is_by_utc_day(spark):
    import datetime as dt

    at = [dt.datetime(2024, 3, 1, 23, 0, k) for k in range(3)] + [dt.datetime(2024, 3, 2, 0, 0, k) for k in range(3)]
    rows = spark.createDataFrame(list(enumerate(at)), "id int, at timestamp")
    try:
        for zone in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert {r.id for r in state.quota(rows, 2).filter("granted").collect()} == {0, 1, 3, 4}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_options(tmp_path):
    file = tmp_path / "o.toml"
    file.write_text("strong_score = 0.9\n[rules]\ntitle = 'skip'\n")
    got = load(str(file), {"BINDERY_DAILY_CALLS": "7"})
    assert (got.strong_score, got.daily_calls, got.rules["title"], got.rules["isbn"]) == (0.9, 7, "skip", "fill")
    assert seconds("2d") == 172800 and seconds("0") == 0
    file.write_text("confidence = 0.9\n")
    with pytest.raises(ValueError):
        load(str(file), {})
    with pytest.raises(ValueError):
        Options(rules={"title": "never"})


OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:title>Cragside</dc:title><dc:creator id="c1">L. J. Ross</dc:creator><dc:creator id="c2">X</dc:creator><meta refines="#c2" property="role">aut</meta>
<dc:identifier>urn:isbn:0306406152</dc:identifier><dc:subject>Crime</dc:subject><meta name="calibre:series" content="DCI Ryan"/><meta name="calibre:series_index" content="6.0"/>
</metadata><manifest><item id="x" href="x.html" media-type="text/html"/></manifest></package>"""


def sample(opf=OPF, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def test_epub_reading_and_rewriting(spark):
    locked = sample(extra=[("META-INF/encryption.xml", '<e xmlns:enc="http://www.w3.org/2001/04/xmlenc#"><enc:EncryptionMethod Algorithm="drm"/></e>')])
    rows = spark.createDataFrame([("a", bytearray(sample())), ("b", bytearray(b"no zip")), ("c", bytearray(locked))], "path string, content binary")
    got = {r.path: r for r in epub.read_books(rows).collect()}
    book = got["a"]
    assert (book.title, book.isbn, book.series, book.series_number, book.authors) == ("Cragside", "0306406152", "DCI Ryan", "6", ["L. J. Ross", "X"])
    assert got["b"].error and got["c"].error == "locked"
    edit = {"title": "Cragside!", "authors": ["LJ Ross"], "unverified": True, "drop_series_number": True, "isbn": "9780306406157"}
    once = epub.rewrite_one(sample(), edit, ["Crime", "Mystery"], b"\xff\xd8\xff0")
    assert once == epub.rewrite_one(sample(), edit, ["Crime", "Mystery"], b"\xff\xd8\xff0")
    again = epub.read_one(once)
    assert again["title"] == "Cragside!" and again["authors"] == ["LJ Ross"] and again["unverified"] and again["has_cover"]
    assert again["subjects"] == ["Crime", "Mystery"] and again["series_number"] is None and again["isbn"] == "9780306406157"
    assert epub.rewrite_one(once, {}) == once


def test_series_are_written_in_both_encodings():
    collection = '<meta property="belongs-to-collection" id="g">Old</meta><meta refines="#g" property="collection-type">series</meta><meta refines="#g" property="group-position">3</meta>'
    calibre = '<meta name="calibre:series" content="DCI Ryan"/><meta name="calibre:series_index" content="6.0"/>'
    for metas in (calibre + collection, calibre, collection, ""):
        book = sample(OPF.replace(calibre, metas))
        told = epub.Package(epub.rewrite_one(book, {"series": "New", "series_number": "7.0"}))
        assert [m.get("content") for m in told.named("calibre:series")] == ["New"]
        assert [m.get("content") for m in told.named("calibre:series_index")] == ["7"]
        group = told.collection()
        assert group.text == "New" and told.refining(group.get("id"), "group-position") == "7"
        assert told.refining(group.get("id"), "collection-type") == "series"
        gone = epub.Package(epub.rewrite_one(book, {"series": "New", "drop_series_number": True}))
        assert gone.series() == ("New", None) and gone.refining(gone.collection().get("id"), "group-position") is None


def test_isbn_goes_to_the_identifier_that_states_one(spark):
    cases = {
        "<dc:identifier>urn:isbn:0306406152</dc:identifier>": (["urn:isbn:9780306406157"], True),
        '<dc:identifier xmlns:opf="http://www.idpf.org/2007/opf" opf:scheme="ISBN">978-0-306-40615-7</dc:identifier>': (["978-0-306-40615-7"], False),
        '<dc:identifier xmlns:opf="http://www.idpf.org/2007/opf" opf:scheme="ISBN">none</dc:identifier>': (["urn:isbn:9780306406157"], True),
        "<dc:identifier>uuid:1</dc:identifier>": (["uuid:1", "urn:isbn:9780306406157"], True),
    }
    for stated, (want, changed) in cases.items():
        book = sample(OPF.replace("<dc:identifier>urn:isbn:0306406152</dc:identifier>", stated))
        new = epub.rewrite_one(book, {"isbn": "9780306406157"})
        assert [e.text for e in epub.Package(new).all("identifier")] == want and (new != book) == changed


def test_covers_are_added_from_a_frame(spark):
    kind = "struct<title:string,authors:array<string>,isbn:string,series:string,series_number:string,unverified:boolean>"
    big = b"\xff\xd8\xff" + b"0" * epub.MAX_IMAGE
    rows = spark.createDataFrame(
        [(p, bytearray(sample()), None, [], c and bytearray(c)) for p, c in (("a", b"\xff\xd8\xff0"), ("b", None), ("c", b"text"), ("d", big))],
        f"path string, content binary, edits {kind}, genres array<string>, cover binary",
    )
    got = {r.path: epub.read_one(bytes(r.content))["has_cover"] for r in epub.rewritten(rows).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_registered_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import os

    from bindery.plans import catalogue, golden, tables  # noqa: F401

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in catalogue.ORACLES.items():
        rows = catalogue.QUERIES[name](spark, sf)
        cols = sorted(rows.columns)
        ours = sorted(repr(tuple(r)) for r in rows.select(*cols).collect())
        theirs = sorted(repr(r) for r in con.sql(f"select {', '.join(cols)} from ({sql})").fetchall())
        assert ours == theirs, name


def test_the_change_log_has_a_line_for_each_size(spark, tmp_path):
    from bindery.plans import catalogue

    def told(size):
        for unit in ("B", "KB", "MB", "GB", "TB"):
            if size < 1024 or unit == "TB":
                return f"{size} B" if unit == "B" else f"{size:.1f} {unit}"
            size /= 1024

    sizes = [None, 0, 1023, 1024, 1280, 1792, 2304, 1024**2 - 1, 1024**2, 5 * 1024**2 // 4, 7 * 1024**3, 3 * 1024**4, 2 * 1024**5]
    spark.createDataFrame([(k, "s", n) for k, n in enumerate(sizes)], "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (2, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    outcome = {1: "held", 2: "written"}
    got = {r.doc_id: r.line for r in catalogue.change_log_whole(spark, str(tmp_path)).collect()}
    assert got == {k: " | ".join([outcome.get(k, "left"), "s", *([] if n is None else [told(n)])]) for k, n in enumerate(sizes)}


def test_notes_on_blank_texts_come_off_to_nothing(spark):
    blank = [None, "", " ", "  \n\t "]
    assert column(spark, blank, X.noted) == [X.NOTE] * 4
    assert column(spark, blank, lambda c: X.noted(X.noted(c))) == [X.NOTE] * 4
    assert column(spark, blank, lambda c: X.unmarked(X.noted(c))) == [None] * 4


def book(title, author="L. J. Ross", isbn=None, extra=""):
    number = f"<dc:identifier>urn:isbn:{isbn}</dc:identifier>" if isbn else ""
    return sample(
        '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f"<dc:title>{title}</dc:title><dc:creator>{author}</dc:creator>{number}{extra}</metadata><manifest/></package>"
    )


def test_a_pass_from_files_to_files(spark, tmp_path):
    from bindery.plans import correction
    from bindery.sources import files

    ingest, output, backups = (tmp_path / n for n in ("in", "out", "kept"))
    for folder in (ingest, ingest / ".hidden", output, backups):
        folder.mkdir()
    one, two = "9780306406157", "9780306406164"
    books = {
        "isbn.epub": book("Cragside", isbn=one), "stale.epub": book("Belsay", isbn=two), "title.epub": book("The Infirmary"),
        "none.epub": book("Nobody Knows It"), "held.epub": book("Held Back"), "asked.epub": book("Heavenfield (The DCI Ryan Mysteries Book 3)"),
        "same.epub": b"just bytes", "broken.epub": b"no zip", "note.txt": b"x",
    }
    for name, content in books.items():
        (ingest / name).write_bytes(content)
    (ingest / "half.epub.part").write_bytes(b"x")
    (ingest / ".hidden" / "h.epub").write_bytes(b"x")
    (output / "same.epub").write_bytes(b"just bytes")
    (output / "title.epub").write_bytes(b"another book")
    listed = delivery.candidates(files.contents(spark, str(ingest)), str(ingest))
    assert sorted(r.name for r in listed.collect()) == sorted(books)
    titles = {"isbn.epub": "Cragside", "stale.epub": "Belsay", "title.epub": "The Infirmary", "asked.epub": "Heavenfield", "held.epub": "Held Back"}

    def record(source, title, **more):
        row = dict.fromkeys(c.split(" ")[0] for c in P.SCHEMA.replace("genre:string,seen", "").split(", "))
        return row | {"source": source, "pos": 0, "title": title, "authors": ["LJ Ross"], "author_ids": ["7"], "genres": [("crime", "Crime")]} | more

    def frame(rows_by_title, asked, by="title"):
        keyed = [(k, *[r[c.split(" ")[0]] for c in P.SCHEMA.replace("genre:string,seen", "").split(", ")][1:]) for k, r in rows_by_title]
        kind = P.SCHEMA.replace("book_id long", "key string")
        rows = spark.createDataFrame(keyed, kind)
        return asked.select("book_id", F.col(by).alias("key")).join(rows, "key").select("book_id", *rows.columns[1:])

    def by_isbn(asked):
        rows = [(one, record("catalogue_a", "Cragside", publisher="Dark Skies", isbn=one, cover="u")), (two, record("catalogue_a", "Something Else"))]
        return [("catalogue_a", frame(rows, asked, "isbn"))], None

    def by_title(asked):
        first = [("The Infirmary", record("catalogue_a", "The Infirmary", series="DCI Ryan", series_number="0.5", series_id="4"))]
        second = [("Belsay", record("catalogue_b", "Belsay")), ("Heavenfield (The DCI Ryan Mysteries Book 3)", record("catalogue_b", "Heavenfield", series_number="4"))]
        errors = asked.filter("title = 'Held Back'").select("book_id", F.lit("catalogue_b").alias("source"), F.lit("timeout").alias("reason"))
        return [("catalogue_a", frame(first, asked)), ("catalogue_b", frame(second, asked))], errors

    reply = catalogue_chat('{"pick": 1, "confidence": 0.93, "reason": "same"}')
    catalogues = correction.Catalogues(
        by_isbn, by_title, choose=lambda calls: calls.select("id", F.lit(reply).alias("reply")),
        map_genre=lambda calls: calls.select("id", F.lit(catalogue_chat('{"genre": "CRIME FICTION"}')).alias("reply")),
        covers=spark.createDataFrame([("u", bytearray(b"\xff\xd8\xff0"))], "url string, body binary"),
    )
    memory = correction.Memory(
        spark.createDataFrame([("author", "catalogue_a", "7", "L J Ross", "x")], state.NAMES), spark.createDataFrame([], state.GENRES),
        spark.createDataFrame([("Crime Fiction",)], "genre string"),
    )
    dry, _, _ = correction.correct(listed, catalogues, memory, Options(dry_run=True))
    rows, names, mapped = correction.correct(listed, catalogues, memory)
    got = {r.name: r for r in rows.collect()}
    assert {k: r.route for k, r in got.items()} == {
        "isbn.epub": "match", "stale.epub": "match", "title.epub": "match", "none.epub": "unverified", "held.epub": "waiting",
        "asked.epub": "match", "same.epub": "unread", "broken.epub": "unread", "note.txt": None,
    }
    dried = {r.name: r for r in dry.collect()}
    assert all(bytes(dried[k].content) == v for k, v in books.items())
    # A dry run asks nobody about genres, so it can't tell of them.
    assert {k: r.line for k, r in dried.items()} == {k: r.line.replace("; genres=Crime Fiction", "").replace("genres=Crime Fiction; ", "") for k, r in got.items()}
    assert got["isbn.epub"].line == "isbn.epub | match | source=catalogue_a | score=1.0000 | authors=L J Ross; publisher=Dark Skies; genres=Crime Fiction; cover=added"
    new = {k: epub.read_one(bytes(r.content)) for k, r in got.items()}
    assert new["title.epub"]["series"] == "DCI Ryan" and new["title.epub"]["series_number"] == "0.5" and new["title.epub"]["authors"] == ["L J Ross"]
    assert new["stale.epub"]["authors"] == ["LJ Ross"] and new["stale.epub"]["isbn"] == two
    assert new["asked.epub"]["title"] == "Heavenfield" and got["asked.epub"].score == 0.93
    assert new["none.epub"]["unverified"] and new["isbn.epub"]["has_cover"] and new["isbn.epub"]["subjects"] == ["Crime Fiction"]
    assert bytes(got["held.epub"].content) == books["held.epub"]
    assert {(r.source, r.genre, r.mapped) for r in mapped.collect()} == {(s, "crime", "Crime Fiction") for s in ("catalogue_a", "catalogue_b")}
    assert {r.standard for r in names.collect() if r.kind == "series"} == {"DCI Ryan"}

    present = files.at_top(files.listing(spark, str(output)), str(output))
    done = {r.path.rpartition("/")[2]: r for r in correction.deliver(spark, rows, str(output), str(backups), present, spark.createDataFrame([("isbn.epub",)], "name string")).collect()}
    assert {k: (r.name, r.route, r.error, r.stuck) for k, r in done.items()} == {
        k: ("title (2).epub" if k == "title.epub" else k, {"title.epub": "collision", "same.epub": "duplicate"}.get(k, "moved"), None, None)
        for k in books if k != "held.epub"
    }
    assert sorted(p.name for p in ingest.iterdir()) == [".hidden", "half.epub.part", "held.epub"]
    assert (output / "title.epub").read_bytes() == b"another book" and epub.read_one((output / "title (2).epub").read_bytes())["series"] == "DCI Ryan"
    assert (backups / "isbn (2).epub").read_bytes() == books["isbn.epub"] and (backups / "same.epub").exists()
    assert not [p for folder in (output, backups) for p in folder.iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def catalogue_chat(content):
    from bindery.plans import catalogue

    return catalogue._chat(content)


def test_requests_are_answered_from_a_table(spark):
    from bindery.sources import requests

    books = spark.createDataFrame(
        [(1, 'The "Big" Sleep: A Novel', [" ", 'R "Ray" C']), (2, "Cragside", []), (3, None, ["A"]), (4, "Belsay", ["A"])], "book_id long, title string, authors array<string>"
    )
    asked = books.select("book_id", requests.title_request(F.col("title"), F.col("authors")).alias("request"))
    told = {r.book_id: r.request for r in asked.collect()}
    assert told == {1: 'intitle:"The  Big  Sleep" OR intitle:"The  Big  Sleep: A Novel" inauthor:"R  Ray  C"', 2: 'intitle:"Cragside"', 3: None, 4: 'intitle:"Belsay" inauthor:"A"'}
    recorded = spark.createDataFrame([(told[1], 200, "{}", None), (told[2], 429, "slow", None), ("x", 200, "", None)], requests.RECORDED)
    got = {r.book_id: r for r in requests.answers(asked, recorded).collect()}
    assert got[1].reply == "{}" and got[1].failed is None and got[2].failed.kind == "temporary" and got[4].failed.reason == "unreadable reply"
    assert {(r.book_id, r.source) for r in requests.errors(requests.answers(asked, recorded), "b").collect()} == {(2, "b"), (4, "b")}


class Told(http.server.BaseHTTPRequestHandler):
    """Answers by path; ``asked`` keeps (path, key, body) of each request."""

    asked: list = []
    image = b"\x89PNG\r\n\x1a\n" + b"x"

    def answer(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        self.asked.append((self.path, self.headers.get("X-Key"), body))
        whole = {"/ok": (200, b'{"totalItems": 0}'), "/text": (200, b"<html>"), "/slow": (429, b"wait"), "/image": (200, self.image), "/page": (200, b"no image"), "/none": (200, b"")}
        status, said = whole.get(self.path.partition("?")[0], (302, b""))
        self.send_response(status)
        if status == 302:
            self.send_header("Location", "/ok")
        self.end_headers()
        self.wfile.write(said)

    do_GET = do_POST = answer

    def log_message(self, *_):
        pass


@pytest.fixture
def served():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Told)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Told.asked = []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def test_live_services_fill_the_tables(spark, served, tmp_path):
    from bindery.sources import live, replies, requests

    (tmp_path / "key").write_text("Bearer s&cret\n")
    key = {"key_file": str(tmp_path / "key"), "headers": {"X-Key": "{key}"}}
    asked = spark.createDataFrame([(n, r) for n, r in enumerate(["a b&c", "a b&c", "{key}", None])], "book_id long, request string")
    got = requests.answers(asked, live.transport(live.Service(f"{served}/ok?q={{request}}&key={{key}}", **key)))
    assert {r.book_id: r.reply for r in got.collect()} == dict.fromkeys(range(3), '{"totalItems": 0}')
    got.count()
    assert sorted(Told.asked) == [("/ok?q=%7Bkey%7D&key=s%26cret", "s&cret", b""), ("/ok?q=a%20b%26c&key=s%26cret", "s&cret", b"")]
    reason = lambda path, **more: requests.answers(asked.limit(1), live.transport(live.Service(served + path, **more))).first().failed.reason
    assert reason("/text") == replies.UNREADABLE and reason("/slow") == "rate limiting, HTTP 429" and reason("/moved") == "HTTP 302"
    assert not any(path == "/ok" for path, _, _ in Told.asked)
    with socket.socket() as idle:
        idle.bind(("127.0.0.1", 0))
        closed = live.Service(f"http://127.0.0.1:{idle.getsockname()[1]}/")
        assert live.exchange(closed, "x", "") == (None, None, "refused")
        idle.listen()
        assert live.exchange(live.Service(closed.address, timeout=0.2), "x", "") == (None, None, "timeout")
    with pytest.raises(ValueError):
        live.Service("file:///etc/hosts")


def test_a_live_model_and_covers(spark, served):
    from bindery.sources import live

    Told.asked = []
    calls = spark.createDataFrame([(7, 'Pick "one"\n{key}')], "id long, prompt string")
    body = {"messages": [{"role": "user", "content": "{request}"}], "max_tokens": 256}
    assert live.model(live.Service(f"{served}/ok", body))(calls).first().asDict() == {"id": 7, "reply": '{"totalItems": 0}'}
    assert json.loads(Told.asked[0][2]) == {"messages": [{"role": "user", "content": 'Pick "one"\n{key}'}], "max_tokens": 256}
    assert live.model(live.Service(f"{served}/slow", lambda q: {"q": q}))(calls).first().reply is None
    urls = spark.createDataFrame([(f"{served}/{p}",) for p in ("image", "page", "none", "gone")] + [("file:///etc/hosts",)], "url string")
    got = {r.url.rpartition("/")[2]: r.body for r in live.images()(urls).collect()}
    assert {n: b if b is None else bytes(b) for n, b in got.items()} == {"image": Told.image, "page": None, "none": None, "gone": None}


def test_services_are_read_from_a_file(tmp_path):
    from bindery import __main__ as command

    told = tmp_path / "s.toml"
    told.write_text('[catalogue_b]\naddress = "https://x.invalid/?q={request}"\npause = 1.5\n[choose]\naddress = "https://y.invalid"\n[choose.body]\nmodel = "m"\n')
    got = command.services(str(told))
    assert (got["catalogue_b"].pause, got["choose"].body) == (1.5, {"model": "m"}) and command.services(None) == {}
    for wrong in ('[other]\naddress = "https://x"\n', '[choose]\naddress = "https://x"\nkey = "k"\n'):
        told.write_text(wrong)
        with pytest.raises(ValueError):
            command.services(str(told))


def test_secrets_listings_and_stuck_files(spark, tmp_path):
    from bindery.sources import files

    for name, text, want in (("a", " Bearer  tok \n", "tok"), ("b", "tok", "tok"), ("c", " \n", None)):
        (tmp_path / name).write_text(text)
        assert files.secret(spark, str(tmp_path / name)) == want
    assert files.secret(spark, str(tmp_path / "absent")) is None
    first = files.listing(spark, str(tmp_path))
    assert [r.name for r in first.collect()] == ["a", "b", "c"]
    stuck = spark.createDataFrame(first.filter("name <> 'c'").select("path", "mark").collect(), "path string, mark string")
    (tmp_path / "a").write_text("changed")
    second = files.listing(spark, str(tmp_path))
    assert sorted(r.name for r in delivery.not_stuck(second, stuck).collect()) == ["a", "c"]
    assert [r.path[-2:] for r in delivery.still_stuck(stuck, second).collect()] == ["/b"]


def test_daily_calls_of_a_stream(spark):
    spend = state.DailyCalls(spark, shared_dir(spark, "calls"), 5)
    calls = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    got = lambda rows: sorted(r.id for r in rows.collect())
    assert got(spend.grant(calls(3, 1, 2), "2024-01-01", 1, "id")) == [1, 2, 3]
    assert got(spend.grant(calls(3, 1, 2), "2024-01-01", 1, "id")) == []
    assert got(spend.grant(calls(4, 5, 6), "2024-01-01", 2, "id")) == [4, 5]
    assert got(spend.grant(calls(7, 8), "2024-01-02", 3, "id")) == [7, 8] and spend.spent("2024-01-01") == 5


def test_a_watched_folder(spark, tmp_path):
    import os

    from bindery.plans import catalogue, correction
    from bindery.plans.relay import Relay

    ingest, output, backups, root = (tmp_path / n for n in ("in", "out", "kept", "state"))
    for folder in (ingest, output, backups):
        folder.mkdir()
    (ingest / "a.epub").write_bytes(book("Cragside"))
    (ingest / "held.epub").write_bytes(book("Held Back"))
    (backups / "old.epub").write_bytes(b"old")
    (backups / ".calls").write_bytes(b"kept")
    os.utime(backups / "old.epub", (0, 0))
    os.utime(backups / ".calls", (0, 0))

    def by_title(asked):
        rows = catalogue._hits(asked.filter("title = 'Cragside'").withColumn("pos", F.lit(0).cast("long")), "book_id", "catalogue_a", F.lit("Cragside"))
        rows = rows.withColumns({"authors": F.array(F.lit("LJ Ross")), "publisher": F.lit("Dark Skies")})
        return [("catalogue_a", rows)], asked.filter("title = 'Held Back'").select("book_id", F.lit("catalogue_a").alias("source"), F.lit("timeout").alias("reason"))

    def by_isbn(asked):
        none = catalogue._hits(asked.limit(0).withColumn("pos", F.lit(0).cast("long")), "book_id", "catalogue_a", F.lit(""))
        return [("catalogue_a", none)], None

    make = lambda **o: Relay(spark, str(ingest), str(output), str(backups), str(root), correction.Catalogues(by_isbn, by_title), Options(genres=("Crime",), **o))
    relay = make()
    relay.start()
    assert relay.scan_once("2024-03-01", "2024-03-01T10:00:00Z") == []  # nothing has settled
    assert not (backups / "old.epub").exists() and (backups / ".calls").exists()
    (ingest / "late.epub").write_bytes(book("Late"))
    lines = relay.scan_once("2024-03-01", "2024-03-01T10:00:05Z")
    assert [x.split(" | ")[:2] for x in lines] == [["a.epub", "match"], ["held.epub", "waiting"]]
    assert sorted(p.name for p in ingest.iterdir()) == ["held.epub", "late.epub"] and epub.read_one((output / "a.epub").read_bytes())["publisher"] == "Dark Skies"
    assert {(r.source, r.confidence, r.matched_as) for r in relay.state["matches"].read().collect()} == {("catalogue_a", 1.0, "Cragside")}
    assert [r.standard for r in relay.state["names"].read().filter("source = ''").collect()] == ["LJ Ross"]
    again = make()  # state is on disk
    lines = again.scan_once("2024-03-01", "2024-03-01T10:00:10Z")
    assert [x.split(" | ")[:2] for x in lines] == [["late.epub", "unverified"]]
    assert again.scan_once("2024-03-01", "2024-03-01T10:00:15Z") == []
    again.scan_once("2024-03-02", "2024-03-02T10:00:00Z")
    assert [x.split(" | ")[:2] for x in again.scan_once("2024-03-02", "2024-03-02T10:00:05Z")] == [["held.epub", "waiting"]]
    dry = make(dry_run=True)
    dry.state["waiting"].reset()
    dry.scan_once("2024-03-02", "2024-03-02T10:00:10Z")
    assert len(dry.scan_once("2024-03-02", "2024-03-02T10:00:15Z")) == 1 and (ingest / "held.epub").exists()
    with pytest.raises(ValueError):
        again.reset(confirmed=False)
    again.reset(confirmed=True)
    assert again.state["names"].read().count() == 0


def test_the_command_line_over_recorded_catalogues(spark, tmp_path, capsys):
    from bindery import __main__ as command
    from bindery.plans import catalogue
    from bindery.sources import requests

    folders = {n: tmp_path / n for n in ("ingest", "output", "backups", "state", "a", "b")}
    for folder in list(folders.values())[:3]:
        folder.mkdir()
    (folders["ingest"] / "a.epub").write_bytes(book("Cragside (old)", isbn="0306406152"))
    (folders["ingest"] / "b.epub").write_bytes(book("Belsay"))
    number, titles = '{"form":"isbn","isbn":"0306406152"}', '{"form":"title","titles":["Belsay"]}'
    title = r'{"q":"intitle:\"Belsay\" inauthor:\"L. J. Ross\"","maxResults":40}'
    spark.createDataFrame([(number, 200, catalogue.REPLY_A, None), (titles, 429, "", None)], requests.RECORDED).write.parquet(str(folders["a"]))
    spark.createDataFrame([(title, 200, '{"totalItems": 0}', None)], requests.RECORDED).write.parquet(str(folders["b"]))
    options = tmp_path / "o.toml"
    options.write_text("stable_checks = 1\n")
    given = ["--options", str(options), "--catalogue_a", str(folders["a"]), "--catalogue_b", str(folders["b"])]
    given += [x for n in ("ingest", "output", "backups", "state") for x in (f"--{n}", str(folders[n]))]
    command.main(["once", "--dry-run", *given])
    dry = capsys.readouterr().out.splitlines()
    assert [x.split(" | ")[:2] for x in dry] == [["a.epub", "match"], ["b.epub", "waiting"]] and not list(folders["output"].iterdir())
    command.main(["once", *given])
    assert capsys.readouterr().out.splitlines() == dry
    told = epub.read_one((folders["output"] / "a.epub").read_bytes())
    assert (told["title"], told["series"], told["series_number"], told["authors"]) == ("Cragside", "DCI Ryan", "6", ["L.J. Ross"])
    assert [p.name for p in folders["ingest"].iterdir()] == ["b.epub"]
    with pytest.raises(ValueError):
        command.main(["reset", *given])
    command.main(["reset", "--yes", *given])


def test_sql_functions_give_what_the_columns_give(spark):
    X.register(spark)
    words = ["Brontë", "Straße & Co.", "The Wind in the Willows", "A", None, "!!!", "Война и мир", "ﬁn ½ Ĳssel", "J.R.R. Tolkien", "Ross, L. J.", "it's \\ 'so'", " en-GB ", "de_AT", ""]
    spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").createOrReplaceTempView("bindery_words")
    for name, own in (("comparison_key", X.comparison_key), ("durable_key", X.durable_key), ("squeezed", X.squeeze), ("stated", X.said), ("primary_language", X.primary_language)):
        got = [r[0] for r in spark.sql(f"SELECT {name}(w) FROM bindery_words ORDER BY k").collect()]
        assert got == column(spark, words, own), name
    plan = spark.sql("SELECT durable_key(w), squeezed(w) FROM bindery_words")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "regexp_replace" in plan


def test_covers_and_records_of_older_packages():
    old = OPF.replace('version="3.0"', 'version="2.0"')
    for opf, property in ((OPF, "cover-image"), (old, None)):
        told = epub.Package(epub.rewrite_one(sample(opf), {"publisher": "P", "unverified": True}, ["Noir"], b"\xff\xd8\xff0"))
        (cover,) = [i for i in told.manifest if i.get("media-type") == "image/jpeg"]
        assert cover.get("properties") == property and told.has_cover()
        tags = [e.tag.rpartition("}")[2] for e in told.meta]
        # The record's elements are together; the metas that refine them follow.
        assert {"publisher", "subject"} <= set(tags[: len(tags) - tags[::-1].index("subject")]) and tags[-1] == "meta"
