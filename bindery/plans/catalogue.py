"""Registered queries of the linkage engine and their SQL counterparts.

Books are not among the driver's tables, so each operator runs on a table whose columns
play its part; golden rows (published results of the rules) are given as literals.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import similarity as S
from bindery.functions import text as X
from bindery.operators import delivery, merge, state, walk
from bindery.operators import pool as P
from bindery.operators import ranking as R
from bindery.sources import epub, replies

QUERIES: dict = {}
ORACLES: dict = {}
GOLDEN: dict = {}


def query(sql: str | None = None):
    """Register a query, and its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def golden(sql: str):
    """Keep a function of published or hand-worked rows, with those rows as SQL, for the tests;
    queries of the same names do the same over tables."""

    def add(f):
        GOLDEN[f.__name__] = (f, sql)
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple], names: str) -> str:
    """Literal rows as SQL."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


# ---- text -------------------------------------------------------------------------------

TITLE = "<title>([^<]*)</title>"


@query(
    f"""
WITH t AS (SELECT page_id, regexp_extract(html, '{TITLE}', 1) AS title FROM pages),
k AS (SELECT page_id, trim(left(trim(regexp_replace(replace(replace(strip_accents(lower(title)), 'ß', 'ss'), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), 200)) AS key FROM t)
SELECT page_id, CASE WHEN regexp_matches(key, '^(the|a|an) [^ ]+ [^ ]') THEN regexp_replace(key, '^(the|a|an) ', '') ELSE key END AS key FROM k
"""
)
def comparison_key(spark, sf_dir):
    """Comparison keys of page titles."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", X.comparison_key(F.regexp_extract("html", TITLE, 1)).alias("key"))


@query(
    r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed, nullif(trim(lang), '') AS lang FROM documents"
)
def squeeze_nullify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("squeezed"), X.said(F.col("lang")).alias("lang"))


KEYS = [
    ("L. J. Ross", "lj ross"), ("Ross, L. J.", "ross lj"), ("Ursula K. Le Guin", "ursula k le guin"),
    ("J.R.R. Tolkien", "jrr tolkien"), ("Brontë", "brontë"), ("Müller", "müller"), ("LJ Ross", "lj ross"),
    ("The Waste Land", "the waste land"), ("1.0.0", "1 0 0"), ("Straße", "strasse"),
]


@golden(values(KEYS, "name, key"))
def durable_key_golden(spark, sf_dir):
    return spark.createDataFrame([(k,) for k, _ in KEYS], "name string").select("name", X.durable_key(F.col("name")).alias("key"))


TITLES = [
    ("Cragside: A DCI Ryan Mystery (The DCI Ryan Mysteries Book 6)", "Cragside", "Cragside: A DCI Ryan Mystery", "The DCI Ryan Mysteries", "6"),
    ("Belsay: A DCI Ryan Mystery", "Belsay", "Belsay: A DCI Ryan Mystery", None, None),
    ("Cragside (2019)", "Cragside (2019)", None, None, None),
    ("The Lord of the Rings: The Fellowship of the Ring", "The Lord of the Rings: The Fellowship of the Ring", None, None, None),
    ("Berwick (The DCI Ryan Mysteries Book 24)", "Berwick", None, "The DCI Ryan Mysteries", "24"),
    ("A Novella (The DCI Ryan Mysteries Book 6.5)", "A Novella", None, "The DCI Ryan Mysteries", "6.5"),
    ("Cragside: A 1930s murder mystery", "Cragside", "Cragside: A 1930s murder mystery", None, None),
    ("  Normal   People ", "Normal People", None, None, None),
]


@golden(values(TITLES, "title, search, also, series, series_number"))
def clean_title_golden(spark, sf_dir):
    rows = spark.createDataFrame([(t[0],) for t in TITLES], "title string")
    return rows.select("title", X.clean_title(F.col("title")).alias("c")).select("title", "c.*")


PAIRS = [("L. J. Ross", "LJ Ross", 1.0), ("L. J. Ross", "Ross, L. J.", 1.0), ("L. J. Ross", "L. J. Riss", 0.6814), ("L. J. Ross", "L. K. Ross", 0.6814), ("L. J. Ross", "L. J. Ros", 0.8308), ("L.J. Ross", "M.J. Porter", 0.02), ("L.J. Ross", "Carly Reagon", 0.0568)]


@golden(values(PAIRS, "one, other, similarity"))
def name_pairs_golden(spark, sf_dir):
    rows = spark.createDataFrame([p[:2] for p in PAIRS], "one string, other string")
    raw = S.ratio(X.name_key(F.col("one")), X.name_key(F.col("other")))
    return rows.withColumn("raw", raw).select("one", "other", F.round(1.0 - S.penalty(F.col("raw")), 4).alias("similarity"))


MESSY = TITLES[0][0]
SCORES = [
    (1, MESSY, "L. J. Ross", "2017-07-07", "Cragside", "L.J. Ross", "6", "2017-07-07", 1.0, "strong"),
    (2, MESSY, "L. J. Ross", None, "Cragside", "L.J. Ross", "6", None, 1.0, "strong"),
    (3, MESSY, "L. J. Ross", "2017-07-07", "Cragside", "L.J. Ross", "11", "2018", 0.8372, "medium"),
    (4, MESSY, "L. J. Ross", "2017-07-07", "Cragside", "L.J. Ross", "11", "2017", 0.907, "medium"),
    (5, MESSY, "L. J. Ross", "2017-07-07", "Cragside: A DCI Ryan Mystery", "L.J. Ross", "11", "2017", 0.907, "medium"),
    (6, MESSY, "L. J. Ross", None, "Cragside", "L. J. Ross", None, None, 1.0, "strong"),
    (7, MESSY, "L. J. Ross", None, "Cragside: A DCI Ryan Mystery", "M.J. Porter", None, None, 0.7, "low"),
    (8, MESSY, "L. J. Ross", None, "The Infirmary", "L.J. Ross", None, None, 0.4444, "low"),
    (9, MESSY, "L. J. Ross", None, "The Infirmary", "Carly Reagon", None, None, 0.0, "none"),
    (10, MESSY, None, "2017-07-07", "Cragside", "L.J. Ross", "6", "2017", 0.7, "low"),
    (11, MESSY, "L. J. Ross", None, "Cragside: A 1930s murder mystery", "M.J. Porter", None, None, 0.4134, "low"),
]


def golden_books(spark) -> DataFrame:
    rows = [(r[0], r[1], [r[2]] if r[2] else [], None, r[3]) for r in SCORES]
    return spark.createDataFrame(rows, "book_id long, title string, authors array<string>, language string, date string")


def golden_pool(spark) -> DataFrame:
    none = (None,) * 5
    rows = [(r[0], 0, "catalogue_a", r[4], [r[5]], [], None, r[6], *none, r[7], None, None) for r in SCORES]
    return spark.createDataFrame(rows, P.SCHEMA)


@golden(values([(r[0], r[8], r[9]) for r in SCORES], "book_id, score, band"))
def score_golden(spark, sf_dir):
    """The published score table, each candidate alone in its pool."""
    return R.leaders(R.rank(R.score(golden_pool(spark), golden_books(spark)))).select("book_id", "score", "band")


BANDS = [(1, [0.96], True, "strong"), (2, [0.94], True, "medium"), (3, [0.9, 0.8], True, "strong"), (4, [0.9, 0.85], True, "medium"), (5, [0.79, 0.1], True, "low"), (6, [0.7], False, "low"), (7, [0.0], True, "none"), (8, [0.89, 0.81], True, "strong")]


@golden(values([(b[0], b[3]) for b in BANDS], "book_id, band"))
def band_golden(spark, sf_dir):
    rows = [(b, p, s, agrees) for b, scores, agrees, _ in BANDS for p, s in enumerate(scores)]
    scored = spark.createDataFrame(rows, "book_id long, pos long, score double, author_agrees boolean")
    return R.leaders(R.rank(scored)).select("book_id", "band")


def flagship(spark, sf_dir):
    """Title walk over the golden books: pools gathered, reduced, scored, ranked and routed."""
    pools = walk.gather(golden_books(spark), [("catalogue_a", golden_pool(spark))])
    return walk.routed(pools).select("book_id", "title", "score", "gap", "band", "route")


# ---- scores, ranks, pools ---------------------------------------------------------------

_PENALTY = """CASE WHEN x >= 0.97 THEN 0.0 WHEN x < 0.35 THEN 1.0
  WHEN x <= 0.5 THEN 1.0 + ((x - 0.35) / (0.5 - 0.35)) * (0.88 - 1.0) WHEN x <= 0.6 THEN 0.88 + ((x - 0.5) / (0.6 - 0.5)) * (0.78 - 0.88)
  WHEN x <= 0.7 THEN 0.78 + ((x - 0.6) / (0.7 - 0.6)) * (0.63 - 0.78) WHEN x <= 0.8 THEN 0.63 + ((x - 0.7) / (0.8 - 0.7)) * (0.45 - 0.63)
  WHEN x <= 0.9 THEN 0.45 + ((x - 0.8) / (0.9 - 0.8)) * (0.22 - 0.45) ELSE 0.22 + ((x - 0.9) / (1.0 - 0.9)) * (0.0 - 0.22) END"""


@query(f"SELECT l_orderkey, l_linenumber, round({_PENALTY.replace('x', '(l_quantity / 50)')}::DOUBLE, 6) AS penalty FROM lineitem")
def penalty_curve(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.round(S.penalty(F.col("l_quantity") / 50), 6).alias("penalty"))


@query(
    """
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity / 53 AS title, l_extendedprice / 110000 AS author,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'R' END AS series, CASE WHEN l_linestatus = 'F' THEN l_tax > 0.04 END AS years FROM lineitem),
w AS (SELECT *, 1.0::DOUBLE + CASE WHEN author >= 0.5 THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN series IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN years IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END AS weight,
  title + CASE WHEN author >= 0.5 THEN 0.8::DOUBLE * (1 - author) ELSE 0 END + CASE WHEN series THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN years THEN 0.15::DOUBLE ELSE 0 END AS cost FROM p)
SELECT l_orderkey, l_linenumber, round(CASE WHEN author >= 0.5 THEN least(1 - cost / weight, 1.0) ELSE least(1 - cost / weight, 0.7) END, 4)::DOUBLE AS score FROM w
"""
)
def weighted_score(spark, sf_dir):
    series = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    years = F.when(F.col("l_linestatus") == "F", F.col("l_tax") > 0.04)
    score = S.weighted_score(F.col("l_quantity") / 53, F.col("l_extendedprice") / 110000, series, years)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@query(
    """
WITH s AS (SELECT user_id, event_id, round(least(value / 100, 1.0), 4) AS score, event_type <> 'view' AS agrees FROM events),
r AS (SELECT *, row_number() OVER w AS rk, round(score - lead(score) OVER w, 4) AS gap, count(*) OVER (PARTITION BY user_id) AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_id))
SELECT user_id, event_id, score, gap, CASE WHEN agrees AND (CASE WHEN n = 1 THEN score >= 0.95 ELSE score >= 0.89 AND coalesce(gap, 0) >= 0.08 END) THEN 'strong'
  WHEN agrees AND score >= 0.8 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS band FROM r WHERE rk = 1
"""
)
def bands_per_group(spark, sf_dir):
    """Leaders and bands of users' events, the value as a score."""
    scored = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_id").alias("pos"),
        F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4).alias("score"), (F.col("event_type") != "view").alias("author_agrees"),
    )
    return R.leaders(R.rank(scored, ["user_id"])).select("user_id", "event_id", "score", "gap", "band")


@query("SELECT min(doc_id) AS doc_id, lang FROM documents WHERE text IS NOT NULL GROUP BY lang, text UNION ALL SELECT doc_id, lang FROM documents WHERE text IS NULL")
def dedupe_first_wins(spark, sf_dir):
    """The first document of equal texts in a language; the key is a digest, not the text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "lang", F.sha2("text", 256).alias("digest"))
    return P.first_in_group(docs, ["lang"], F.col("digest"), [F.col("pos").asc()]).select(F.col("pos").alias("doc_id"), "lang")


@query(
    """
WITH r AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS source_rank FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d'), source_rank, (CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END) DESC, o_orderstatus, o_orderkey) AS n FROM r)
SELECT o_custkey, o_orderkey FROM k WHERE n = 1
"""
)
def standard_record(spark, sf_dir):
    """The order that stands for a customer: by date, source rank, completeness, payload, place."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("source"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.nullif("o_orderstatus", F.lit("O")).alias("publisher"),
    )
    ranked = orders.withColumn("__source_rank", P.source_ranks())
    order = P.standard_record_order(("publisher",))
    return P.first_in_group(ranked, ["book_id"], F.lit("one"), order).select("o_custkey", "o_orderkey")


@query(
    """
WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'supplier ' || (l_suppkey % 3) || chr(31) || (l_suppkey % 2) END AS own FROM lineitem),
d AS (SELECT l_partkey, l_returnflag <> 'N' AS told, count(DISTINCT own) AS n, min(own) AS one FROM g GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, 'part ' || g.l_partkey || chr(31) || CASE WHEN told THEN 'ab' ELSE 'cd' END AS work,
  coalesce(own, CASE WHEN n = 1 THEN one END) AS placement
FROM g JOIN d ON g.l_partkey = d.l_partkey AND (g.l_returnflag <> 'N') = told
"""
)
def placement_groups(spark, sf_dir):
    """Works and placements of lines as candidates titled by their part; a sole placement is
    everyone's in its group."""
    lines = table(spark, sf_dir, "lineitem")
    placed = F.col("l_returnflag") == "R"
    pool = lines.select(
        "l_orderkey", "l_linenumber", F.lit(1).cast("long").alias("book_id"),
        F.concat(F.lit("The Part "), "l_partkey", F.when(placed, ": a novel").otherwise("")).alias("title"),
        F.array(F.when(F.col("l_returnflag") != "N", "B., A.").otherwise("D., C.")).alias("authors"),
        F.when(placed, F.concat(F.lit("The Supplier, "), F.col("l_suppkey") % 3)).alias("series"),
        F.when(placed, (F.col("l_suppkey") % 2).cast("string")).alias("series_number"),
    )
    return P.work_groups(pool).select("l_orderkey", "l_linenumber", F.col("group").alias("work"), "placement")


@query(
    """
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rk FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY rk) AS n FROM r) SELECT lang, source, doc_id FROM k WHERE n <= 5
"""
)
def topk_per_source(spark, sf_dir):
    """At most five documents of each source, by rank within the language."""
    docs = table(spark, sf_dir, "documents")
    ranked = docs.withColumn("rk", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")))
    return R.offer(ranked.select("lang", "source", "doc_id", "rk"), by="lang").select("lang", "source", "doc_id")


TAGS = ["en-GB", "eng", "fr", "de_AT", "und-x", ""]


@query(
    f"""
WITH t AS (SELECT doc_id, lang, unnest({TAGS}) AS tag FROM documents), p AS (SELECT *, lower(trim(regexp_extract(tag, '^[^-_]*'))) AS b FROM t)
SELECT doc_id, tag FROM p WHERE lang = b OR NOT regexp_matches(lang, '^[a-z]{{2,3}}$') OR NOT regexp_matches(b, '^[a-z]{{2,3}}$') OR length(lang) <> length(b)
"""
)
def language_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array(*map(F.lit, TAGS))).alias("tag"))
    return docs.filter(X.same_language(F.col("lang"), F.col("tag"))).select("doc_id", "tag")


# ---- walks and joins --------------------------------------------------------------------


def _hits(rows: DataFrame, book: str, source: str, title) -> DataFrame:
    """Rows as candidates of a source, a book's in the order of ``pos``."""
    given = {"book_id": F.col(book), "pos": F.col("pos"), "source": F.lit(source), "title": title}
    columns = [c.split(" ", 1) for c in re.split(r", (?=\w+ \w)", P.SCHEMA)]
    return rows.select(*(given[n].alias(n) if n in given else F.lit(None).cast(kind).alias(n) for n, kind in columns))


@query(
    """
WITH s AS (SELECT s_nationkey AS n, min(s_suppkey) AS k FROM supplier WHERE s_acctbal > 9000 GROUP BY 1), c AS (SELECT c_nationkey AS n, min(c_custkey) AS k FROM customer GROUP BY 1)
SELECT n_nationkey AS book_id, CASE WHEN n_regionkey = 1 THEN 'held' WHEN s.k % 2 = 0 THEN 'match' WHEN s.k IS NOT NULL THEN 'contradicted' WHEN n_regionkey = 2 THEN 'held'
    WHEN c.k % 2 = 0 THEN 'match' WHEN c.k IS NOT NULL THEN 'contradicted' ELSE 'missed' END AS outcome,
  CASE WHEN n_regionkey = 1 THEN NULL WHEN s.k IS NOT NULL THEN 'supplier' WHEN n_regionkey = 2 THEN NULL WHEN c.k IS NOT NULL THEN 'customer' END AS source
FROM nation LEFT JOIN s ON s.n = n_nationkey LEFT JOIN c ON c.n = n_nationkey
"""
)
def priority_fallthrough(spark, sf_dir):
    """The ISBN walk of nations over rich suppliers, then customers: the first source that has
    one decides; its title agrees or contradicts; failed sources hold."""
    nations = table(spark, sf_dir, "nation")
    books = nations.select(F.col("n_nationkey").cast("long").alias("book_id"), F.lit("Cragside").alias("title"), F.lit("9780306406157").alias("isbn"))
    title = F.when(F.col("pos") % 2 == 0, "Cragside: a novel").otherwise("Infirmary")
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").cast("long").alias("n"), F.col("s_suppkey").cast("long").alias("pos"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("n"), F.col("c_custkey").cast("long").alias("pos"))
    sources = [("supplier", _hits(suppliers, "n", "supplier", title)), ("customer", _hits(customers, "n", "customer", title))]
    failed = lambda region, source: nations.filter(F.col("n_regionkey") == region).select(F.col("n_nationkey").cast("long").alias("book_id"), F.lit(source).alias("source"), F.lit("timeout").alias("reason"))
    errors = failed(1, "supplier").unionByName(failed(2, "customer"))
    return walk.by_isbn(books, sources, errors).select("book_id", "outcome", "found.source")


@query(
    """
WITH one AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal > 9000), two AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 9000)
SELECT n_nationkey AS book_id, one.n IS NOT NULL AND n_regionkey <> 3 AS exited, n_regionkey IN (0, 3) AND NOT (one.n IS NOT NULL AND n_regionkey <> 3) AS held,
  CASE WHEN one.n IS NOT NULL AND n_regionkey <> 3 THEN 'supplier' ELSE 'customer' END AS source
FROM nation LEFT JOIN one ON one.n = n_nationkey LEFT JOIN two ON two.n = n_nationkey
WHERE (one.n IS NOT NULL AND n_regionkey <> 3) OR (two.n IS NOT NULL AND n_regionkey <> 0)
"""
)
def fold_early_exit(spark, sf_dir):
    """The title walk of nations over two sources: a nation that is strong after rich suppliers
    does not ask customers; a failed source (region 3's first, region 0's second) holds those
    that did not stop."""
    nations = table(spark, sf_dir, "nation")
    schema = "book_id long, title string, authors array<string>, language string, date string"
    book = {"title": F.lit("Cragside"), "authors": F.array(F.lit("L. J. Ross")), "language": F.lit(None).cast("string"), "date": F.lit(None).cast("string")}
    books = nations.select(F.col("n_nationkey").cast("long").alias("book_id"), *(c.alias(n) for n, c in book.items()))
    assert books.columns == [c.split(" ")[0] for c in schema.split(", ")]
    authors = F.array(F.lit("Ross, L. J."))
    found = lambda name, key, nation, balance, source: _hits(
        table(spark, sf_dir, name).filter(f"{balance} > 9000").select(F.col(nation).cast("long").alias("n"), F.col(key).cast("long").alias("pos")),
        "n", source, F.lit("Cragside"),
    ).withColumn("authors", authors)
    sources = [("supplier", found("supplier", "s_suppkey", "s_nationkey", "s_acctbal", "supplier")), ("customer", found("customer", "c_custkey", "c_nationkey", "c_acctbal", "customer"))]
    failed = lambda region, source: nations.filter(F.col("n_regionkey") == region).select(F.col("n_nationkey").cast("long").alias("book_id"), F.lit(source).alias("source"), F.lit("timeout").alias("reason"))
    errors = failed(3, "supplier").unionByName(failed(0, "customer"))
    return walk.gather(books, sources, errors).filter("rk = 1").select("book_id", "exited", "held", "source")


@golden(values([(r[0], {"strong": "write", "medium": "ask"}.get(r[9], "unverified")) for r in SCORES], "book_id, route"))
def title_walk_golden(spark, sf_dir):
    return flagship(spark, sf_dir).select("book_id", "route")


@query(
    "SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey OR p_partkey = l_suppkey"
)
def or_key_join(spark, sf_dir):
    """A key that equals either of two columns, by equality."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return walk.any_key_join(table(spark, sf_dir, "part").select("p_partkey"), lines, "p_partkey", ["l_partkey", "l_suppkey"]).select(
        "p_partkey", "l_orderkey", "l_linenumber"
    )


# ---- merge ------------------------------------------------------------------------------


@query(
    """
SELECT doc_id, CASE WHEN toxic IS NOT NULL THEN toxic::VARCHAR END AS overwritten,
  CASE WHEN coalesce(lang, '') = '' THEN source END AS filled, NULL::VARCHAR AS skipped FROM documents LEFT JOIN labels USING (doc_id)
"""
)
def field_rules(spark, sf_dir):
    """The three rules: a label overwrites, a source fills what is blank, nothing is skipped."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.col("toxic").cast("string")
    return docs.select(
        "doc_id",
        merge.by_rule("overwrite", "title", F.col("source"), label).alias("overwritten"),
        merge.by_rule("fill", "title", F.col("lang"), F.col("source")).alias("filled"),
        merge.by_rule("skip", "title", F.col("lang"), F.col("source")).alias("skipped"),
    )


def merge_rows(spark, rows: list[dict]) -> DataFrame:
    """Book and record pairs with the fields of a merge, absent ones null."""
    names = [n for n in merge.FIELDS if n != "authors"]
    kind = ", ".join(["id long", *(f"{s}_{n} string" for s in ("file", "found") for n in names), "file_authors array<string>", "found_authors array<string>", "file_unverified boolean", "found_cover string", "file_has_cover boolean"])
    order = [c.rpartition(" ")[0] for c in kind.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in order) for r in rows], kind)


MERGES = [
    {"id": 1, "file_title": "cragside", "found_title": "Cragside!", "found_publisher": "P", "file_series": "Old", "file_series_number": "2", "found_series": "New"},
    {"id": 2, "file_title": "Cragsde", "found_title": "Cragside", "found_isbn": "9780306406157", "file_series": "s", "found_series": "S", "found_series_number": "6"},
    {"id": 3, "file_title": "A", "found_title": "A", "file_description": X.NOTE, "file_unverified": True},
    {"id": 4, "file_title": "A", "found_title": "A", "file_description": "Blurb\n\n" + X.NOTE, "file_unverified": True, "found_series_number": "3"},
]
MERGED = [
    (1, None, "New", None, True, False, "publisher=P;series=New;series_number="),
    (2, "Cragside", "S", "6", False, False, "title=Cragside;series=S;series_number=6"),
    (3, None, None, None, False, True, "description=;tag=removed"),
    (4, None, None, None, False, False, "description=Blurb;tag=removed"),
]


@golden(values(MERGED, "id, title, series, series_number, drop_series_number, drop_description, changes"))
def merge_golden(spark, sf_dir):
    """Same-value guard, ISBN gate, series and number, unmarking, and the change list."""
    rows = merge.changes(merge.edits(merge_rows(spark, MERGES)), F.lit("catalogue_a"))
    told = F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit("="), c["value"])), ";")
    return rows.select("id", "edits.title", "edits.series", "edits.series_number", "edits.drop_series_number", "edits.drop_description", told.alias("changes"))


@query(
    rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS bare FROM documents)
SELECT doc_id, md5(CASE WHEN bare = '' THEN '{X.NOTE}' WHEN regexp_matches(bare, '<[a-zA-Z][a-zA-Z0-9-]*(\s[^>]*)?/?>') THEN bare || '<p>{X.NOTE}</p>' ELSE bare || chr(10) || chr(10) || '{X.NOTE}' END) AS marked,
  md5(nullif(bare, '')) AS unmarked, true AS stable FROM d
"""
)
def mark_unmark_idempotent(spark, sf_dir):
    """A note put on twice is there once, and comes off again; a blank text is the note alone."""
    once = table(spark, sf_dir, "documents").select("doc_id", X.noted(F.col("text")).alias("once"))
    return once.select(
        "doc_id", F.md5("once").alias("marked"), F.md5(X.unmarked(F.col("once"))).alias("unmarked"),
        (X.noted(F.col("once")) == F.col("once")).alias("stable"),
    )


@query(
    """
WITH b AS (SELECT d.*, toxic, quality, CASE WHEN toxic = 1 THEN 'held' WHEN quality = 1 THEN 'written' WHEN quality = 0 THEN 'unverified' ELSE 'left' END AS outcome FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, concat_ws(' | ', CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0)
    WHEN n_chars < 1073741824 THEN printf('%.1f MB', n_chars / 1048576.0) WHEN n_chars < 1099511627776 THEN printf('%.1f GB', n_chars / 1073741824.0)
    WHEN n_chars IS NOT NULL THEN printf('%.1f TB', n_chars / 1099511627776.0) END,
  outcome, 'source=' || source, CASE WHEN quality IS NOT NULL THEN printf('score=%.4f', quality * 0.75) END,
  CASE WHEN quality = 1 THEN 'publisher=' || source || '; language=' || lang WHEN toxic = 1 THEN 'tag=removed' ELSE 'no change' END) AS line FROM b
"""
)
def change_log(spark, sf_dir):
    """The audit line of each book: its size, outcome, source, score and changes."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good, bad = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    null = F.lit(None).cast("string")
    book = rows.select(
        "doc_id", "source", "quality", "toxic", X.human_size(F.col("n_chars")).alias("size"),
        *(null.alias(f"file_{n}") for n in merge.FIELDS if n != "authors"), F.array().cast("array<string>").alias("file_authors"),
        (bad & ~good).alias("file_unverified"),
        *(null.alias(f"found_{n}") for n in merge.FIELDS if n not in ("authors", "language", "publisher")),
        F.array().cast("array<string>").alias("found_authors"),
        F.when(good, F.col("lang")).alias("found_language"), F.when(good, F.col("source")).alias("found_publisher"),
    )
    told = merge.changes(merge.edits(book), F.col("source"))
    outcome = F.when(bad, "held").when(good, "written").when(F.col("quality") == 0, "unverified").otherwise("left")
    # A book without its mark's note keeps its description: the tag alone comes off.
    kept = F.filter("changes", lambda c: c["field"] != "description")
    return told.withColumn("changes", kept).select(
        "doc_id", merge.audit_line(F.col("size"), outcome, F.col("source"), F.col("quality") * 0.75).alias("line")
    )


@query(
    """
SELECT doc_id, concat_ws(' | ', CASE WHEN toxic = 1 THEN 'held' WHEN quality = 1 THEN 'written' WHEN quality = 0 THEN 'unverified' ELSE 'left' END, coalesce(source, ''),
  CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0)
    WHEN n_chars < 1073741824 THEN printf('%.1f MB', n_chars / 1048576.0) WHEN n_chars < 1099511627776 THEN printf('%.1f GB', n_chars / 1073741824.0)
    WHEN n_chars IS NOT NULL THEN printf('%.1f TB', n_chars / 1099511627776.0) END) AS line FROM documents LEFT JOIN labels USING (doc_id)
"""
)
def change_log_whole(spark, sf_dir):
    """A line for each book, of any size; one of unknown size ends in its source."""
    return log_lines(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def log_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, line): the outcome, source and size of each book."""
    outcome = F.when(F.col("toxic") == 1, "held").when(F.col("quality") == 1, "written").when(F.col("quality") == 0, "unverified").otherwise("left")
    line = F.concat_ws(" | ", outcome, F.coalesce("source", F.lit("")), X.human_size(F.col("n_chars")))
    return docs.join(labels, "doc_id", "left").select("doc_id", line.alias("line"))


# ---- genres, names, matches -------------------------------------------------------------


@query("SELECT p_partkey, trim(g) AS genre FROM (SELECT p_partkey, unnest(string_split(replace(p_type, ' ', ';') || ': ' || p_brand, ';')) AS x FROM part), unnest(string_split(x, ':')) AS t(g) WHERE trim(g) <> ''")
def genre_split_explode(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    packed = F.concat(F.replace("p_type", F.lit(" "), F.lit(";")), F.lit(": "), F.col("p_brand"))
    return part.select("p_partkey", F.explode(X.genre_parts(packed)).alias("genre"))


@query(
    """
WITH known AS (SELECT 'a' AS source, p_brand AS genre, CASE WHEN min(p_size) < 2 THEN '' ELSE upper(min(p_name)) END AS mapped FROM part GROUP BY p_brand HAVING min(p_partkey) % 3 <> 0),
allowed AS (SELECT DISTINCT p_name AS own FROM part WHERE length(p_name) % 2 = 0), wanted AS (SELECT DISTINCT p_brand AS genre FROM part)
SELECT wanted.genre, CASE WHEN mapped IS NULL THEN 'miss' WHEN mapped = '' THEN 'unfit' WHEN own IS NULL THEN 'gone' ELSE 'mapped' END AS state, own AS target
FROM wanted LEFT JOIN known USING (genre) LEFT JOIN allowed ON lower(trim(own)) = lower(trim(mapped))
"""
)
def genre_allow_map(spark, sf_dir):
    """Genres against what is known and allowed; a miss, an unfit and a lost one differ."""
    part = table(spark, sf_dir, "part")
    known = part.groupBy(F.col("p_brand").alias("genre")).agg(F.min("p_size").alias("s"), F.min("p_name").alias("n"), F.min("p_partkey").alias("k")).filter("k % 3 <> 0")
    known = known.select(F.lit("a").alias("source"), "genre", F.when(F.col("s") < 2, "").otherwise(F.upper("n")).alias("mapped"))
    allowed = part.filter(F.length("p_name") % 2 == 0).select(F.col("p_name").alias("genre")).distinct()
    wanted = part.select(F.lit("a").alias("source"), F.col("p_brand").alias("genre")).distinct()
    return state.map_genres(wanted, known, allowed).select("genre", "state", "target")


@query("SELECT p_partkey, CASE WHEN lower(p_brand) = lower(string_split(p_type, ' ')[1]) THEN '' ELSE p_brand END AS added FROM part")
def add_only_union(spark, sf_dir):
    """Genres added to those a part carries, whatever their case."""
    own = F.split("p_type", " ")
    wanted = F.array(F.upper(F.get(own, 0)), F.col("p_brand"), F.lower("p_brand"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(merge.genres_to_add(own, wanted), ",").alias("added"))


@query("SELECT lower(c_mktsegment) AS key, arg_min(c_mktsegment, c_custkey) AS standard FROM customer GROUP BY 1")
def first_spelling(spark, sf_dir):
    """The first spelling of each name is its standard."""
    names = table(spark, sf_dir, "customer").select(
        F.lit("author").alias("kind"), F.lit("a").alias("source"), F.col("c_mktsegment").alias("name"),
        F.lit(None).cast("string").alias("identity"), F.col("c_custkey").alias("pos"),
    )
    known = spark.createDataFrame([], state.NAMES)
    return state.learn_names(known, state.resolve_names(names, known)).select("key", "standard")


@query(
    """
SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'machinery' THEN 'Machines' WHEN c_custkey % 5 = 0 AND c_custkey <= 50 THEN 'By Id' WHEN lower(c_mktsegment) = 'building' THEN 'Buildings' ELSE c_mktsegment END AS spelling,
  lower(c_mktsegment) <> 'machinery' AND c_custkey % 5 = 0 AND c_custkey <= 50 AS by_id, lower(c_mktsegment) = 'machinery' AS overridden FROM customer
"""
)
def name_resolve(spark, sf_dir):
    """Overrides, then the source's own id, then the key, then the name itself."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.lit("author").alias("kind"), F.lit("a").alias("source"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").cast("string").alias("identity"))
    ids = [("author", "a", str(k), "By Id", "x") for k in range(0, 51, 5)]
    known = spark.createDataFrame([*ids, ("author", "", "building", "Buildings", "x")], state.NAMES)
    over = spark.createDataFrame([("author", "MACHINERY", "Machines")], "kind string, name string, spelling string")
    return state.resolve_names(names, known, over).select("c_custkey", "spelling", "by_id", "overridden")


@query(
    """
WITH e AS (SELECT user_id::VARCHAR AS book_key, event_type AS source, round(value / 1000, 2) AS confidence, event_id::VARCHAR AS at_, event_id % 2 AS fresh FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY confidence DESC, CASE source WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, fresh, at_) AS n FROM e)
SELECT book_key, source, confidence, at_ AS matched_as FROM r WHERE n = 1
"""
)
def match_best_wins(spark, sf_dir):
    """The more confident match stays; a tie goes to the better source, then to the older."""
    events = table(spark, sf_dir, "events")
    # As SQL rounds doubles, by the product and not by the decimal digits: 0.285 * 100 is below 28.5.
    sure = F.round(F.col("value") / 1000 * 100) / 100
    rows = events.select(F.col("user_id").cast("string").alias("book_key"), F.col("event_type").alias("source"), sure.alias("confidence"), F.col("event_id").cast("string").alias("matched_at"), F.col("event_id").cast("string").alias("matched_as"), (F.col("event_id") % 2).alias("fresh"))
    old, new = rows.filter("fresh = 0").drop("fresh"), rows.filter("fresh = 1").drop("fresh")
    return state.best_matches(old, new, ["purchase", "click"]).select("book_key", "source", "confidence", "matched_as")


@query("SELECT string_agg(g, chr(10) ORDER BY g) AS fingerprint FROM (SELECT DISTINCT lower(trim(p_type)) AS g FROM part) WHERE g <> ''")
def list_fingerprint(spark, sf_dir):
    return state.genre_fingerprint(table(spark, sf_dir, "part").select("p_type").distinct(), "p_type")


@query("SELECT p_brand AS genre, CASE WHEN min(p_size) < 2 THEN '' ELSE min(p_name) END AS mapped FROM part GROUP BY 1 HAVING min(p_size) >= 2")
def fingerprint_sweep(spark, sf_dir):
    """Refusals go when the allowed list has changed."""
    known = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("genre")).agg(F.when(F.min("p_size") < 2, "").otherwise(F.min("p_name")).alias("mapped"))
    return state.sweep_genres(known, "old list", "new list")


# ---- folders, quota, replies ------------------------------------------------------------

SETTLE = """
WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS x FROM events),
r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c),
s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS streak FROM r)
"""


@query(SETTLE + "SELECT event_id, streak, streak >= 2 AS settled FROM s")
def settle_runs(spark, sf_dir):
    """How often in a row a user's events are of one type."""
    events = table(spark, sf_dir, "events")
    return delivery.settled(events, 2, "user_id", "event_id", "event_type").select("event_id", "streak", "settled")


@query("SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 200 AS granted FROM events")
def daily_quota(spark, sf_dir):
    return state.quota(table(spark, sf_dir, "events"), 200, "ts", ["event_id"]).select("event_id", "granted")


@query("SELECT o_orderkey FROM orders, (SELECT max(o_orderdate) AS m FROM orders) WHERE o_orderdate < m - INTERVAL 30 DAY AND NOT starts_with(o_orderpriority, '.')")
def retention(spark, sf_dir):
    """What is older than thirty days at the last date."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("/b/"), F.col("o_orderpriority")).alias("path"))
    now = orders.agg(F.max("o_orderdate")).first()[0]
    return delivery.expired(orders, F.lit(now), 30, "o_orderdate").select("o_orderkey")


@query(
    r"""
WITH w AS (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN lang || ' (' || (doc_id % 7 + 2) || ').epub' ELSE lang || '.epub' END AS name FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS place FROM w),
t AS (SELECT unnest(['en.epub', 'fr (3).epub', 'fr (12).epub', 'de (x).epub']) AS name),
n AS (SELECT DISTINCT name FROM (SELECT name FROM t UNION ALL SELECT name FROM w) WHERE regexp_matches(name, ' \([0-9]+\)\.epub$')),
u AS (SELECT name AS base, 1 AS n FROM t UNION SELECT regexp_replace(name, ' \([0-9]+\)\.epub$', '.epub'), regexp_extract(name, ' \(([0-9]+)\)\.epub$', 1)::INT FROM n),
d AS (SELECT base, n - row_number() OVER (PARTITION BY base ORDER BY n) AS below FROM u),
f AS (SELECT doc_id, name, place + (SELECT count(*) FROM d WHERE base = name AND below < place) AS k FROM p)
SELECT doc_id, CASE WHEN k = 1 THEN name ELSE left(name, length(name) - 5) || ' (' || k || ').epub' END AS free FROM f
"""
)
def collision_names(spark, sf_dir):
    """Free names for documents named by their language, some of them numbered already, where
    the folder has some names."""
    numbered = F.concat("lang", F.lit(" ("), (F.col("doc_id") % 7 + 2).cast("string"), F.lit(").epub"))
    name = F.when(F.col("doc_id") % 9 == 4, numbered).otherwise(F.concat("lang", F.lit(".epub")))
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    taken = spark.createDataFrame([("en.epub",), ("fr (3).epub",), ("fr (12).epub",), ("de (x).epub",)], "name string")
    return delivery.free_names(docs, taken, order=["doc_id"]).select("doc_id", "free")


@query(
    """
WITH d AS (SELECT min(doc_id) AS k, text FROM documents GROUP BY text)
SELECT doc_id, CASE WHEN doc_id = k THEN 'moved' WHEN doc_id % 7 = 0 THEN 'collision' ELSE 'duplicate' END AS route FROM documents JOIN d ON documents.text IS NOT DISTINCT FROM d.text
"""
)
def duplicate_digest(spark, sf_dir):
    """Later copies of a text are duplicates of the delivered first; altered ones collide."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("name"))
    first = docs.groupBy("name").agg(F.min("doc_id").alias("k"), F.min("text").alias("content"))
    later = docs.join(first.select("name", "k"), "name")
    altered = F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") != F.col("k")), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    files = later.select("doc_id", "name", altered.cast("binary").alias("content"), (F.col("doc_id") == F.col("k")).alias("first"))
    there = first.select("name", F.col("content").cast("binary").alias("content"))
    fresh = delivery.destinations(files.filter("first"), there.limit(0))
    return fresh.unionByName(delivery.destinations(files.filter("not first"), there)).select("doc_id", "route")


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, (json_extract_string(props, '$.dur'))::BIGINT AS dur FROM events")
def json_props(spark, sf_dir):
    """Properties read by a declared schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "page string, dur bigint").alias("p")).select("event_id", "p.page", "p.dur")


def _chat(content: str, finish: str = "stop") -> str:
    return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content}}]})


CHOICES = [
    (1, _chat('{"pick": 2, "confidence": 0.9, "reason": "same"}'), True, 2, 0.9),
    (2, _chat('{"pick": null, "confidence": 1.0, "reason": "none"}'), True, None, 1.0),
    (3, _chat('{"pick": 4, "confidence": 0.9}'), False, None, None),
    (4, _chat('{"pick": true, "confidence": 0.9}'), False, None, None),
    (5, _chat('{"pick": 1}'), False, None, None),
    (6, _chat("I think it is the second."), False, None, None),
    (7, _chat('{"pick": 1, "confidence": 0.9}', "length"), False, None, None),
    (8, _chat('{"pick": 1, "confidence": "0.9"}'), False, None, None),
    (9, _chat('{"pick": 1, "confidence": 1.5}'), False, None, None),
]


@golden(values([(c[0], *c[2:]) for c in CHOICES], "id, valid, pick, confidence"))
def json_contract(spark, sf_dir):
    """A chooser's replies, by the strict contract."""
    rows = spark.createDataFrame([c[:2] for c in CHOICES], "id long, reply string")
    return rows.withColumn("c", replies.chosen(F.col("reply"), F.lit(3))).select("id", F.col("c").isNotNull().alias("valid"), "c.pick", "c.confidence")


#: Published kinds and reasons of refusals.
STATUSES = [
    ("message", 200, None, None, None),
    ("message", 400, "API key not valid. Please pass a valid API key.", "held", "rejected the key"),
    ("message", 400, "reason: keyInvalid", "held", "rejected the key"),
    ("message", 403, "The caller is not authorized", "held", "rejected the key"),
    ("message", 403, "Books API has not been used in project 1 before or it is disabled", "held", "configuration problem, HTTP 403"),
    ("message", 400, "invalidParameter", "held", "configuration problem, HTTP 400"),
    ("message", 401, "API key not valid", "held", "configuration problem, HTTP 401"),
    ("message", 404, None, "held", "configuration problem, HTTP 404"),
    ("message", 408, None, "temporary", "HTTP 408"),
    ("message", 429, None, "temporary", "rate limiting, HTTP 429"),
    ("message", 503, None, "temporary", "HTTP 503"),
    ("message", 302, None, "held", "HTTP 302"),
    ("status", 401, None, "held", "rejected the key"),
    ("status", 403, None, "held", "rejected the key"),
    ("status", 402, None, "held", "configuration problem, HTTP 402"),
    ("model", 402, None, "temporary", "out of balance, HTTP 402"),
    ("model", 403, None, "held", "rejected the key"),
]
LOST = [("timeout", "temporary", "timeout"), ("refused", "temporary", "connection refused"), ("reset", "temporary", "connection reset"), ("dns", "temporary", "DNS failure"), ("certificate", "held", "TLS certificate failure"), ("unreadable", "held", "unreadable reply")]


@golden(values([(i, *s[3:]) for i, s in enumerate(STATUSES)] + [(100 + i, *x[1:]) for i, x in enumerate(LOST)], "id, kind, reason"))
def failure_kinds(spark, sf_dir):
    """What each refusal and each lost exchange is, by who was asked."""
    rows = spark.createDataFrame([(i, *s[:3]) for i, s in enumerate(STATUSES)], "id long, by string, status int, message string")
    asked = (rows.filter(F.col("by") == by).withColumn("f", replies.failure(F.col("status"), F.col("message"), by)) for by in ("message", "status", "model"))
    lost = spark.createDataFrame([(100 + i, x[0]) for i, x in enumerate(LOST)], "id long, error string")
    told = [x.select("id", "f.kind", "f.reason") for x in (*asked, lost.withColumn("f", replies.network_failure(F.col("error"))))]
    return reduce(DataFrame.unionByName, told)


REPLY_A = json.dumps({"data": {"editions": [
    {"title": "Cragside (ed)", "isbn_13": None, "isbn_10": "0306406152", "reading_format_id": 1, "publisher": None, "release_date": "2017-07-07", "language": {"code2": "en"},
     "book": {"id": 1, "title": "Cragside", "release_date": "2016", "image": {"url": "u"}, "cached_tags": {"Genre": [{"tag": "Crime: Mystery"}, {"tag": "Mystery"}]},
              "contributions": [{"contribution": "Narrator", "author": {"id": 9, "name": "N"}}, {"contribution": "Author", "author": {"id": 7, "name": "L.J. Ross"}}],
              "book_series": [{"featured": False, "position": 1.0, "series": {"id": 3, "name": "Other"}}, {"featured": True, "position": 6.0, "series": {"id": 4, "name": "DCI Ryan"}}]}},
    {"title": "Cragside (audio)", "reading_format_id": 2, "book": {"id": 1, "title": "Cragside"}}]}})
REPLY_B = json.dumps({"totalItems": 2, "items": [
    {"volumeInfo": {"title": "Cragside", "authors": ["LJ Ross", " "], "publishedDate": "2017-07", "industryIdentifiers": [{"type": "ISBN_10", "identifier": "0306406152"}, {"type": "ISBN_13", "identifier": "978-0-306-40615-7"}], "categories": ["Fiction; Crime"], "imageLinks": {"smallThumbnail": "s"}, "language": "en"}},
    {"volumeInfo": {"title": "Other", "industryIdentifiers": [{"type": "ISBN_13", "identifier": "9781111111111"}]}}]})


@golden(
    values(
        [
            ("catalogue_a", 0, "Cragside", "L.J. Ross", "DCI Ryan", "6", "0306406152", "2017-07-07", "u", "Crime<Crime: Mystery,Mystery<Crime: Mystery"),
            ("catalogue_b", 0, "Cragside", "LJ Ross", None, None, "9780306406157", "2017-07", "s", "Fiction<Fiction; Crime,Crime<Fiction; Crime"),
        ],
        "source, pos, title, authors, series, series_number, isbn, date, cover, genres",
    )
)
def replies_golden(spark, sf_dir):
    """Replies of both catalogues as candidates."""
    rows = spark.createDataFrame([(1, REPLY_A, REPLY_B, "9780306406157")], "book_id long, a string, b string, isbn string")
    one = replies.catalogue_a(rows.withColumn("reply", F.col("a")))
    two = replies.catalogue_b(rows.withColumn("reply", F.col("b")), isbn="isbn")
    seen = F.array_join(F.transform("genres", lambda g: F.concat(g["genre"], F.lit("<"), g["seen"])), ",")
    return one.unionByName(two).select("source", "pos", "title", F.array_join("authors", ";").alias("authors"), "series", "series_number", "isbn", "date", "cover", seen.alias("genres"))


@query(f"SELECT page_id, trim(regexp_extract(html, '{TITLE}', 1)) AS title, CASE WHEN trim(regexp_extract(html, '{TITLE}', 1)) <> '' THEN 1 ELSE 0 END AS n FROM pages")
def html_meta(spark, sf_dir):
    """Titles of pages, read as elements of a package document."""
    pages = table(spark, sf_dir, "pages")
    escaped = F.replace(F.replace(F.regexp_extract("html", TITLE, 1), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    document = F.concat(F.lit('<package xmlns:dc="urn:dc"><dc:title>'), escaped, F.lit("</dc:title><dc:title> </dc:title></package>"))
    found = pages.select("page_id", epub.opf_values(document, "title").alias("titles"))
    return found.select("page_id", F.coalesce(F.get("titles", 0), F.lit("")).alias("title"), F.size("titles").alias("n"))


@query(SETTLE + "SELECT user_id::VARCHAR AS path, event_type AS mark, streak FROM s WHERE streak >= 2")
def stream_settle(spark, sf_dir):
    """The settle state as a stream over the events there are."""
    from bindery.storage import shared_dir
    from bindery.streaming import settling

    folder = shared_dir(spark, "sightings")
    events = table(spark, sf_dir, "events")
    second = F.timestamp_seconds(F.col("event_id"))
    events.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("mark"), second.alias("at")).write.parquet(folder)
    out = shared_dir(spark, "settled")
    stream = settling.settle_stream(spark.readStream.schema(settling.SIGHTINGS).parquet(folder), 2)
    settling.drain(stream, shared_dir(spark, "settle-progress"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).select("path", "mark", "streak")
