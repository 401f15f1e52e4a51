"""More registered queries: files and books, requests, merging, state and streams, each with
its SQL; published or hand-worked rows are given as literals."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions import similarity as S
from bindery.functions import text as X
from bindery.operators import delivery, merge, state, walk
from bindery.operators import pool as P
from bindery.operators import ranking as R
from bindery.options import Options
from bindery.plans import correction
from bindery.plans.catalogue import SCORES, _chat, _hits, golden, golden_books, golden_pool, query, table, values
from bindery.sources import epub, replies, requests
from bindery.storage import shared_dir
from bindery.streaming import settling

# ---- books ------------------------------------------------------------------------------


def opf(metadata: str, manifest: str = "") -> bytes:
    """A book with this package metadata."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr(
            zipfile.ZipInfo("META-INF/container.xml"),
            '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>',
        )
        z.writestr(
            zipfile.ZipInfo("OEBPS/c.opf"),
            '<package xmlns="http://www.idpf.org/2007/opf" xmlns:opf="http://www.idpf.org/2007/opf" version="3.0">'
            f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{metadata}</metadata><manifest>{manifest}</manifest></package>',
        )
        if "LOCKED" in metadata:
            z.writestr(
                zipfile.ZipInfo("META-INF/encryption.xml"),
                '<e xmlns:enc="http://www.w3.org/2001/04/xmlenc#"><enc:EncryptionMethod Algorithm="urn:locked"/></e>',
            )
    return out.getvalue()


COLLECTION = '<meta property="belongs-to-collection" id="g">DCI Ryan</meta><meta refines="#g" property="collection-type">series</meta><meta refines="#g" property="group-position">6.0</meta>'
CALIBRE = '<meta name="calibre:series" content="DCI Ryan"/><meta name="calibre:series_index" content="6.50"/>'
BOOKS = [
    ("plain", opf("<dc:title>Cragside</dc:title><dc:creator>L. J. Ross</dc:creator><dc:identifier>urn:isbn:978-0-306-40615-7</dc:identifier><dc:subject>Crime</dc:subject><dc:language>en</dc:language>" + CALIBRE)),
    ("collection", opf('<dc:title>Cragside</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:identifier opf:scheme="ISBN">0-306-40615-2</dc:identifier><dc:identifier>urn:uuid:1</dc:identifier>' + COLLECTION)),
    ("marked", opf(f"<dc:title>T</dc:title><dc:subject>{merge.TAG}</dc:subject><dc:subject>Own</dc:subject><dc:description>D\n\n{X.NOTE}</dc:description>" + '<meta name="cover" content="c"/>', '<item id="c" href="c.jpg" media-type="image/jpeg"/>')),
    ("covered", opf("<dc:title>T</dc:title><dc:identifier>9780306406157</dc:identifier>", '<item id="x" href="c.jpg" media-type="image/jpeg" properties="cover-image"/>')),
    ("locked", opf("<dc:title>LOCKED</dc:title>")),
    ("bytes", b"no zip"),
]
READ = [
    ("plain", "Cragside", "L. J. Ross", "9780306406157", "DCI Ryan", "6.5", False, False, "Crime", False),
    ("collection", "Cragside", "A;B", "0306406152", "DCI Ryan", "6", False, False, "", False),
    ("marked", "T", "", None, None, None, True, True, "Own", False),
    ("covered", "T", "", "9780306406157", None, None, True, False, "", False),
    ("locked", None, None, None, None, None, None, None, None, True),
    ("bytes", None, None, None, None, None, None, None, None, True),
]


def _books(spark) -> DataFrame:
    return spark.createDataFrame([(n, bytearray(c)) for n, c in BOOKS], "path string, content binary")


@golden(values(READ, "path, title, authors, isbn, series, series_number, has_cover, unverified, subjects, unread"))
def epub_fields(spark, sf_dir):
    """Package records of books: both encodings of a series, ISBN forms, covers, marks, locks."""
    return epub.read_books(_books(spark)).select(
        "path", "title", F.array_join("authors", ";").alias("authors"), "isbn", "series", "series_number", "has_cover", "unverified",
        F.array_join("subjects", ";").alias("subjects"), F.col("error").isNotNull().alias("unread"),
    )


EDITS = "struct<title:string,authors:array<string>,isbn:string,series:string,series_number:string,unverified:boolean,drop_series_number:boolean>"
REWRITES = [
    ("plain", ("New", ["X", "Y"], "9780306406157", "Other", "7.0", None, False), ["crime", "Noir"], b"\xff\xd8\xff0"),
    ("collection", (None, None, "9780306406157", "Other", None, True, True), [], b"not an image"),
    ("marked", (None, None, None, None, None, False, False), ["own"], b"\x89PNG\r\n\x1a\n0"),
    ("locked", ("New", None, None, None, None, None, False), [], None),
]
REWRITTEN = [
    ("plain", "New", "X;Y", "9780306406157", "Other", "7", "Other", "7", True, False, "Crime;Noir", False),
    ("collection", "Cragside", "A;B", "9780306406157", "Other", None, "Other", None, False, True, "", False),
    ("marked", "T", "", None, None, None, None, None, True, True, "Own", False),
    ("locked", None, None, None, None, None, None, None, None, None, None, True),
]


@golden(values(REWRITTEN, "path, title, authors, isbn, series, series_number, collection, position, has_cover, unverified, subjects, refused"))
def epub_rewrite(spark, sf_dir):
    """Books rewritten and read again: texts, names, ISBN, both encodings of a series, tag,
    genres, cover. (A note in a description is taken off by the description's own edit.)"""
    content = dict(BOOKS)
    rows = [(n, bytearray(content[n]), e, g, c and bytearray(c)) for n, e, g, c in REWRITES]
    done = epub.rewritten(spark.createDataFrame(rows, f"path string, content binary, edits {EDITS}, genres array<string>, cover binary"))
    package = _package(done)
    found = epub.read_books(done).drop("error").join(package, "path").join(done.select("path", F.col("error").isNotNull().alias("refused")), "path")
    return found.select(
        "path", "title", F.array_join("authors", ";").alias("authors"), "isbn", "series", "series_number", "collection", "position",
        "has_cover", "unverified", F.array_join("subjects", ";").alias("subjects"), "refused",
    )


def _package(files: DataFrame, *kept: str) -> DataFrame:
    """(path, collection, position) of the EPUB 3 encoding alone, and the kept columns."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            told = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    package = epub.Package(content)
                    group = package.collection()
                    told.append((path, group.text, package.refining(group.get("id"), "group-position")) if group is not None else (path, None, None))
                except epub.Unreadable:
                    told.append((path, None, None))
            yield pd.DataFrame(told, columns=["path", "collection", "position"]).assign(**{n: batch[n] for n in kept})

    return files.select("path", "content", *(n for n in kept if n != "content")).mapInPandas(run, f"path string, collection string, position string{epub.carried(files, kept)}")


PASSED = [
    ("a.epub", "match", "Cragside", "DCI Ryan", "6.5", "a.epub | match | source=catalogue_a | score=1.0000 | publisher=Dark Skies; genres=Crime Fiction"),
    ("b.epub", "match", "The Infirmary", "DCI Ryan", "0.5", "b.epub | match | source=catalogue_b | score=1.0000 | model=candidate 1, 1.00: same | title=The Infirmary; authors=L. J. Ross; series=DCI Ryan; series_number=0.5"),
    ("c.epub", "unverified", "Nobody Knows It", None, None, f"c.epub | unverified | sought=Nobody Knows It | tried=catalogue_a, catalogue_b | description={X.NOTE}; tag=added"),
    ("d.epub", "waiting", "Held Back", None, None, "d.epub | waiting | reason=catalogue_a could not be asked: timeout | no change"),
    ("e.epub", "unread", None, None, None, "e.epub | unread | problem=not an EPUB: File is not a zip file | no change"),
    ("f.epub", "untouched", None, None, None, "f.epub | untouched | no change"),
]


@golden(values(PASSED, "name, route, title, series, series_number, line"))
def correction_pass(spark, sf_dir):
    """The whole pass over six books, from their bytes to the corrected files read again."""
    titled = lambda t, a="L. J. Ross": opf(f"<dc:title>{t}</dc:title><dc:creator>{a}</dc:creator>")
    given = [("a.epub", BOOKS[0][1]), ("b.epub", titled("Infirmary, The: a novel", "LJ Ross")), ("c.epub", titled("Nobody Knows It")), ("d.epub", titled("Held Back")), ("e.epub", b"no zip"), ("f.epub", opf("<dc:creator>A</dc:creator>"))]
    listed = spark.createDataFrame([(f"/in/{n}", n, bytearray(c)) for n, c in given], "path string, name string, content binary")

    def record(books, wanted, source, **stated):
        rows = _hits(books.filter(wanted).withColumn("pos", F.lit(0).cast("long")), "book_id", source, F.lit(stated.pop("title")))
        return rows.withColumns({k: v.cast(rows.schema[k].dataType) for k, v in stated.items()})

    def by_isbn(books):
        genres = F.array(F.struct(F.lit("crime"), F.lit("Crime")))
        return [("catalogue_a", record(books, F.col("isbn").isNotNull(), "catalogue_a", title="Cragside", publisher=F.lit("Dark Skies"), authors=F.array(F.lit("L. J. Ross")), genres=genres))], None

    def by_title(books):
        errors = books.filter("title = 'Held Back'").select("book_id", F.lit("catalogue_a").alias("source"), F.lit("timeout").alias("reason"))
        none = record(books, F.lit(False), "catalogue_a", title="x")
        ryan = {"authors": F.array(F.lit("L. J. Ross")), "series": F.lit("DCI Ryan"), "series_number": F.lit("0.5")}
        asked = F.col("title").startswith("Infirmary")
        same = record(books, asked, "catalogue_b", title="The Infirmary", **ryan)
        return [("catalogue_a", none), ("catalogue_b", same)], errors

    # The file's title is the record's turned round, so a model picks it.
    pick = F.lit(_chat('{"pick": 1, "confidence": 1.0, "reason": "same"}'))
    genre = F.lit(_chat('{"genre": "crime fiction"}'))
    by = correction.Catalogues(by_isbn, by_title, lambda c: c.select("id", pick.alias("reply")), lambda c: c.select("id", genre.alias("reply")))
    memory = correction.Memory(
        spark.createDataFrame([], state.NAMES), spark.createDataFrame([], state.GENRES), spark.createDataFrame([("Crime Fiction",)], "genre string")
    )
    done, _, _ = correction.correct(listed, by, memory, Options(full_scan=True))
    again = epub.read_books(done).select("path", "title", "series", "series_number")
    return done.select("path", "name", "route", "line").join(again, "path").drop("path")


# ---- folders and requests ---------------------------------------------------------------


@query(
    r"""
WITH f AS (SELECT doc_id, '/in/' || CASE doc_id % 7 WHEN 1 THEN '.hidden/' WHEN 2 THEN 'sub/' ELSE '' END || CASE WHEN doc_id % 11 = 5 THEN '.' ELSE '' END || doc_id
  || CASE doc_id % 5 WHEN 0 THEN '.epub' WHEN 1 THEN '.KEPUB' WHEN 2 THEN '.epub.part' WHEN 3 THEN '.TMP' ELSE '.txt' END AS path FROM documents)
SELECT path, doc_id % 5 < 2 AS book FROM f WHERE doc_id % 7 <> 1 AND doc_id % 11 <> 5 AND doc_id % 5 NOT IN (2, 3)
"""
)
def folder_candidates(spark, sf_dir):
    """Files worth a look, and which of them are books."""
    k = F.col("doc_id")
    folder = F.when(k % 7 == 1, ".hidden/").when(k % 7 == 2, "sub/").otherwise("")
    ending = F.when(k % 5 == 0, ".epub").when(k % 5 == 1, ".KEPUB").when(k % 5 == 2, ".epub.part").when(k % 5 == 3, ".TMP").otherwise(".txt")
    path = F.concat(F.lit("file:/in/"), folder, F.when(k % 11 == 5, ".").otherwise(""), k.cast("string"), ending)
    files = delivery.candidates(table(spark, sf_dir, "documents").select(path.alias("path")), "/in")
    return files.select(F.regexp_replace("path", "^file:", "").alias("path"), delivery.is_book(F.col("path")).alias("book"))


@query("WITH e AS (SELECT user_id AS path, event_type AS mark, event_id % 3 = 0 AS old FROM events), s AS (SELECT DISTINCT path, mark FROM e WHERE old), p AS (SELECT DISTINCT path, mark FROM e WHERE NOT old) SELECT path::VARCHAR AS path, mark, (path, mark) IN (SELECT (path, mark) FROM s) AS stuck FROM p")
def stuck_files(spark, sf_dir):
    """Files as seen now, and which of them are stuck as they were; the others are looked at."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("mark"), (F.col("event_id") % 3 == 0).alias("old"))
    stuck, now = seen.filter("old").select("path", "mark").distinct(), seen.filter("not old").select("path", "mark").distinct()
    fresh = delivery.not_stuck(now, stuck).withColumn("stuck", F.lit(False))
    return fresh.unionByName(delivery.still_stuck(stuck, now).withColumn("stuck", F.lit(True)))


ASKED = [
    (1, 'The "Big" Sleep: A Novel', 'R "Ray" C', 'intitle:"The  Big  Sleep" OR intitle:"The  Big  Sleep: A Novel" inauthor:"R  Ray  C"', "held", "unreadable reply"),
    (2, "Cragside", None, 'intitle:"Cragside"', "temporary", "rate limiting, HTTP 429"),
    (3, "Belsay", "A", 'intitle:"Belsay" inauthor:"A"', None, None),
]


@golden(values([(a[0], *a[3:]) for a in ASKED], "book_id, request, kind, reason"))
def title_requests(spark, sf_dir):
    """What a catalogue is asked about books, and how a recorded one answers."""
    books = spark.createDataFrame([(k, t, [a] if a else []) for k, t, a, *_ in ASKED], "book_id long, title string, authors array<string>")
    asked = books.select("book_id", requests.title_request(F.col("title"), F.col("authors")).alias("request"))
    recorded = spark.createDataFrame([(ASKED[1][3], 429, "slow", None), (ASKED[2][3], 200, "{}", None)], requests.RECORDED)
    return requests.answers(asked, recorded).select("book_id", "request", "failed.kind", "failed.reason")


# ---- texts and scores -------------------------------------------------------------------


@query("WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS line FROM documents) SELECT doc_id, CASE WHEN length(line) > 120 THEN left(line, 120) || '...' ELSE line END AS reason FROM d")
def short_reasons(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.short_reason(F.col("text")).alias("reason"))


@query("SELECT doc_id, md5(replace(replace(text, 'secret12', '***'), 'et12', '***')) AS hidden FROM (SELECT doc_id, coalesce(text, '') || ' secret12 et12 ' || doc_id AS text FROM documents)")
def redactions(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" secret12 et12 "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.redacted(text, "secret12")).alias("hidden"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN printf('978%010d', p_partkey) END AS isbn, CASE WHEN p_partkey % 3 < 2 THEN printf(CASE WHEN p_partkey % 3 = 0 THEN '978%010d' ELSE '%010d' END, p_partkey) END AS stated FROM part")
def isbn_forms(spark, sf_dir):
    """ISBN-13s of written forms, and what an identifier states: by form or prefix, not a serial."""
    k = F.col("p_partkey")
    written = F.when(k % 3 == 0, F.format_string("978-%010d", k)).when(k % 3 == 1, F.format_string("urn:isbn:%010d", k)).otherwise(F.format_string("urn:uuid:%05d", k))
    return table(spark, sf_dir, "part").select("p_partkey", X.isbn13(written).alias("isbn"), X.isbn_of(written).alias("stated"))


SEARCHED = [("Cragside: A DCI Ryan Mystery (The DCI Ryan Mysteries Book 6)", "Cragside|Cragside: A DCI Ryan Mystery"), ("Cragside", "Cragside"), ("The Lord: The Ring", "The Lord: The Ring"), ("", None), (" (X Book 1)", None)]


@golden(values(SEARCHED, "title, asked"))
def search_titles_golden(spark, sf_dir):
    rows = spark.createDataFrame([s[:1] for s in SEARCHED], "title string")
    return rows.select("title", F.array_join(X.search_titles(F.col("title")), "|").alias("asked"))


LETTERS = [("1", "lj ross;m j porter", "jm porter|lj ross"), ("2", "ross lj", "lj ross"), ("3", "", None)]


@golden("SELECT * FROM (VALUES ('1', 'j m porter|lj ross'), ('2', 'lj ross'), ('3', NULL)) v(id, letters)")
def letters_golden(spark, sf_dir):
    """Letters of authors' keys: equal for the same names in any order."""
    rows = spark.createDataFrame([r[:2] for r in LETTERS], "id string, keys string")
    keys = F.filter(F.split("keys", ";"), lambda k: k != "")
    return rows.select("id", X.letters(keys).alias("letters"))


AGREES = [("Cragside: A DCI Ryan Mystery", "Cragside", True), ("Cragside", "The Infirmary", False), ("", "Anything", True), ("The Rock Pool", "Rock", True), ("Rocks", "Rock", True), ("Cragsde", "Cragside", True), ("A", "", False)]


@golden(values(AGREES, "file, record, agrees"))
def title_agreement(spark, sf_dir):
    rows = spark.createDataFrame([a[:2] for a in AGREES], "file string, record string")
    heads = rows.select("file", "record", *(X.parted(F.col(c))["head"].alias(f"{c}_head") for c in ("file", "record")))
    keyed = heads.select("file", "record", *(X.comparison_key(F.col(f"{c}_head")).alias(f"{c}_key") for c in ("file", "record")))
    return keyed.select("file", "record", S.heads_agree(F.col("file_key"), F.col("record_key")).alias("agrees"))


@golden(values([(r[0], r[0] <= 6) for r in SCORES], "book_id, agrees"))
def agreement_golden(spark, sf_dir):
    """Which records of the published score table agree on title and author."""
    return R.score(golden_pool(spark), golden_books(spark)).select("book_id", "agrees")


@query(
    """
WITH s AS (SELECT user_id, event_id, round(least(value / 100, 1.0), 4) AS score, event_type <> 'view' AS agrees FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rk FROM s)
SELECT user_id, arg_min(event_id, rk) AS event_id FROM r WHERE agrees GROUP BY user_id
"""
)
def nearest_agreeing(spark, sf_dir):
    """The best-ranked event of each user that agrees."""
    scored = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_id").alias("pos"), F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4).alias("score"),
        (F.col("event_type") != "view").alias("agrees"),
    )
    return R.nearest_agreeing(R.rank(scored, ["user_id"]), "user_id").select("user_id", "event_id")


@query(
    """
WITH c AS (SELECT o_custkey AS book_id, o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 0 THEN printf('978%010d', o_custkey % 7) END AS isbn,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title, strftime(o_orderdate, '%Y') AS year FROM orders),
k AS (SELECT *, CASE WHEN isbn IS NOT NULL THEN isbn WHEN title IS NOT NULL THEN title || '/' || year ELSE '#' || pos END AS identity FROM c)
SELECT book_id, min(pos) AS pos FROM k GROUP BY book_id, identity
"""
)
def record_identity(spark, sf_dir):
    """Orders as candidates of their customer, the first of each ISBN or title, author and year."""
    orders = table(spark, sf_dir, "orders")
    pool = orders.select(
        F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderkey") % 4 == 0, F.format_string("978-%010d", F.col("o_custkey") % 7)).alias("isbn"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"), F.array(F.lit("Ross, L. J.")).alias("authors"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )
    return P.dedupe(pool).select("book_id", "pos")


OFFERED = [(1, "Cragside", "L", 1), (1, "Belsay", "L", 2), (2, "Heavenfield", "L", 1)]
CONTRADICTED = [(1, "Belsay", "L"), (2, "Belsay", "L"), (3, "Belsay", "L")]


@golden(values([*OFFERED, (2, "Belsay", "L", 2), (3, "Belsay", "L", 1)], "book_id, title, publisher, rk"))
def contradicted_records(spark, sf_dir):
    """A contradicted record goes to the end of what a model is offered, once."""
    offered = spark.createDataFrame(OFFERED, "book_id long, title string, publisher string, rk int")
    extra = spark.createDataFrame(CONTRADICTED, "book_id long, title string, publisher string")
    return walk.with_contradicted(offered, extra)


KNOWN_WORKS = [("Cragside", "en", "eng", 0), ("Cragside", "de", "deu", 1), ("Cragside: A DCI Ryan Mystery", "en", "eng", 2), ("cragside", "en", "eng", 3)]


@golden("SELECT * FROM (VALUES (1, 'en', 0), (1, 'en', 1), (2, 'de', 0), (3, 'en', 0), (3, 'de', 1), (3, 'en', 2)) v(book_id, code2, pos)")
def title_lookup(spark, sf_dir):
    """Works under any of a book's search titles, exact, in its language where it has one."""
    title = "Cragside: A DCI Ryan Mystery"
    books = spark.createDataFrame([(1, title, "en-GB"), (2, title, "deu"), (3, title, None), (4, "Belsay", "en")], "book_id long, title string, language string")
    works = spark.createDataFrame(KNOWN_WORKS, "work_title string, code2 string, code3 string, record_pos long")
    return walk.title_lookup(books, works).select("book_id", "code2", "pos")


# ---- merging and state ------------------------------------------------------------------


@query("SELECT doc_id, source || '=' || coalesce(lang, '') AS told, quality IS NOT NULL AND coalesce(toxic, 0) = 0 AS cover, CASE WHEN quality = 1 THEN 'publisher:' || source || ':' || lang ELSE '' END AS changes FROM documents LEFT JOIN labels USING (doc_id)")
def attribution(spark, sf_dir):
    """Who each change is credited to, whether a cover is wanted, and a book told for a prompt."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    null = F.lit(None).cast("string")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    told = rows.select(
        "doc_id", "lang", F.concat(F.col("source"), F.lit("="), F.coalesce("lang", F.lit(""))).alias("told"),
        *(null.alias(f"file_{n}") for n in merge.FIELDS if n != "authors"), F.array().cast("array<string>").alias("file_authors"), F.lit(False).alias("file_unverified"),
        *(null.alias(f"found_{n}") for n in merge.FIELDS if n not in ("authors", "publisher")), F.array().cast("array<string>").alias("found_authors"),
        F.when(good, F.col("source")).alias("found_publisher"), F.when(F.col("quality").isNotNull(), "url").alias("found_cover"), (F.col("toxic") == 1).alias("file_has_cover"),
    )
    done = merge.changes(merge.edits(told), F.col("lang"))
    written = F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["field"], c["value"], c["source"])), ";")
    return done.select("doc_id", "told", merge.wants_cover().alias("cover"), written.alias("changes"))


@query("SELECT doc_id, 'description;tag' AS fields, TRUE AS unverified, TRUE AS noted FROM documents")
def marking(spark, sf_dir):
    """Books that nothing matched: the note and the tag, and nothing else."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", *(F.lit(None).cast("string").alias(f"file_{n}") for n in merge.FIELDS if n not in ("authors", "description")),
        F.array().cast("array<string>").alias("file_authors"), F.col("text").alias("file_description"), F.lit(False).alias("file_unverified"),
    )
    done = merge.changes(merge.mark(rows))
    fields = F.array_join(F.transform("changes", lambda c: c["field"]), ";")
    return done.select("doc_id", fields.alias("fields"), "edits.unverified", X.has_note(F.col("edits.description")).alias("noted"))


@query("WITH o AS (SELECT p_brand AS genre, min(p_name) AS mapped, min(p_type) AS seen FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), n AS (SELECT p_brand AS genre, max(p_name) AS mapped, max(p_type) AS seen FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT genre, coalesce(n.mapped, o.mapped) AS mapped, coalesce(o.seen, n.seen) AS seen FROM o FULL JOIN n USING (genre)")
def genre_upsert(spark, sf_dir):
    """New mappings over known ones: the new target, the first spelling seen; as a stable dump."""
    part = table(spark, sf_dir, "part")
    row = lambda pick, of: part.filter(of).groupBy(F.lit("a").alias("source"), F.col("p_brand").alias("genre")).agg(pick("p_name").alias("mapped"), pick("p_type").alias("seen"))
    merged = state.save_genres(row(F.min, "p_partkey % 2 = 0"), row(F.max, "p_partkey % 3 = 0"))
    return state.ordered_genres(merged).select("genre", "mapped", "seen")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN printf('978%010d', c_custkey) ELSE lower(c_mktsegment) || '|' || 'lj ross;ann lee' END AS key FROM customer")
def book_keys(spark, sf_dir):
    """What names a book in the match table."""
    customers = table(spark, sf_dir, "customer")
    isbn = F.when(F.col("c_custkey") % 2 == 0, F.format_string("978-%010d", F.col("c_custkey")))
    return customers.select("c_custkey", state.book_key(isbn, F.col("c_mktsegment"), F.array(F.lit("L. J. Ross"), F.lit("Ann Lee"))).alias("key"))


@query(
    """
SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), '^(The|A|An) ', '')) AS key,
  'lj ' || lower(p_brand[:5]) || ' ' || p_brand[7:] AS name, 'cafe ' || p_name AS accented, p_name || ' ' || p_type AS squeezed FROM part
"""
)
def registered_functions(spark, sf_dir):
    """The key functions as SQL users call them: the plan has no Python but for other scripts."""
    X.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("bindery_parts")
    return spark.sql(
        """
        SELECT p_partkey, comparison_key(p_name) AS key, durable_key('L. J. ' || p_brand) AS name, comparison_key('The Café ' || p_name || '!') AS accented,
          squeezed('  ' || p_name || '\t\n ' || p_type || ' ') AS squeezed FROM bindery_parts
        """
    )


# ---- streams ----------------------------------------------------------------------------


def _drained(spark, rows: DataFrame, through, names: list[str]) -> DataFrame:
    """What a stream over the rows gives, once."""
    folder, out = shared_dir(spark, "stream-in"), shared_dir(spark, "stream-out")
    rows.write.parquet(folder)
    stream = through(spark.readStream.schema(rows.schema).parquet(folder))
    settling.drain(stream, shared_dir(spark, "stream-progress"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).select(*names)


@query("SELECT DISTINCT user_id::VARCHAR AS path, event_type AS mark FROM events")
def stream_once(spark, sf_dir):
    """News of a file is told once for each of its marks."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("mark"))
    return _drained(spark, rows, settling.once_per_mark, ["path", "mark"])


@query(
    """
WITH e AS (SELECT user_id::VARCHAR AS path, event_id, event_id // 40 AS day, event_id % 5 = 0 AS failed FROM events),
f AS (SELECT *, coalesce(max(failed::INT) OVER (PARTITION BY path, day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM e)
SELECT path, event_id, failed FROM f WHERE held = 0
"""
)
def stream_hold(spark, sf_dir):
    """After an attempt that failed, a book is left until the next UTC day."""
    at = F.timestamp_seconds(F.floor(F.col("event_id") / 40) * 86400 + F.col("event_id") % 40)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), at.alias("at"), (F.col("event_id") % 5 == 0).alias("failed"))
    made = _drained(spark, rows, settling.hold_until_tomorrow, ["path", "at", "failed"])
    second = F.unix_seconds("at")
    return made.select("path", (F.floor(second / 86400) * 40 + second % 86400).cast("long").alias("event_id"), "failed")


@query("WITH n AS (SELECT n_nationkey AS id, n_regionkey AS batch FROM nation) SELECT id FROM (SELECT *, row_number() OVER (ORDER BY batch, id) AS k FROM n) WHERE k <= 12")
def stream_quota(spark, sf_dir):
    """A day's twelve calls, spent by the batches of a stream in turn; a repeated batch gets none."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("batch"))
    spend = state.DailyCalls(spark, shared_dir(spark, "calls"), 12)
    granted = None
    for number in range(5):
        calls = nations.filter(F.col("batch") == number).select("id")
        own = spend.grant(calls, "2024-01-01", number, "id")
        granted = own if granted is None else granted.unionByName(own)
        granted = granted.unionByName(spend.grant(calls, "2024-01-01", number, "id"))
    return granted


@query("SELECT c_custkey::VARCHAR AS key, c_mktsegment AS matched FROM customer WHERE c_custkey % 4 <> 0")
def delivered_then_remembered(spark, sf_dir):
    """Of a batch, only what was delivered is remembered, and a repeat changes nothing."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("matched"), (F.col("c_custkey") % 4 != 0).alias("delivered"))
    kept = state.StateTable(spark, shared_dir(spark, "remembered"), "key string, matched string")
    out = shared_dir(spark, "delivered")
    for _ in range(2):
        settling.deliver(rows, 3, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), lambda b, n: kept.replace(b.select("key", "matched"), n))
    return kept.read()


@query(
    """
SELECT p_partkey, '1. title=' || p_name || '; author=LJ Ross, Ann Lee' || CASE WHEN p_partkey % 2 = 0 THEN '; series=' || p_brand || '; position=' || p_size ELSE '' END
  || CASE WHEN p_partkey % 3 = 0 THEN '; year=' || (1990 + p_size) ELSE '' END || '; publisher=' || p_type || '; isbn=' || printf('978%010d', p_partkey) || '; language=en'
  || chr(10) || '2. title=' || p_type AS prompt FROM part
"""
)
def prompts(spark, sf_dir):
    """What a prompt says of a book's candidates, as numbered lines; their source is withheld."""
    even = F.col("p_partkey") % 2 == 0
    date = F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_size") + 1990).cast("string"), F.lit("-05"))).otherwise("20")
    told = {
        "source": F.lit("catalogue_a"), "title": F.col("p_name"), "authors": F.array(F.lit("LJ Ross"), F.lit("Ann Lee")), "series": F.when(even, F.col("p_brand")),
        "series_number": F.when(even, F.col("p_size").cast("string")), "date": date, "publisher": F.col("p_type"), "isbn": F.format_string("978%010d", "p_partkey"), "language": F.lit("en"),
    }
    part = table(spark, sf_dir, "part").withColumns(told)
    first = part.withColumn("first", correction.shown())
    bare = first.withColumns({n: F.lit(None).cast(first.schema[n].dataType) for n in told} | {"title": F.col("p_type")})
    return bare.select("p_partkey", replies.numbered(F.array("first", correction.shown())).alias("prompt"))
