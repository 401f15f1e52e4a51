"""Who is asked about what, what calls a day has, and what is learned from which book."""

import threading

import pytest
from pyspark.sql import functions as F

from bindery.operators import pool as P
from bindery.operators import state, walk
from bindery.options import Options
from bindery.plans import catalogue, correction
from bindery.sources import epub, requests
from bindery.storage import create_text, names, shared_dir
from test_linkage import book, catalogue_chat

BOOK = "book_id long, title string, authors array<string>, isbn string, language string, date string, path string"
FIELDS = [c.split(" ")[0] for c in P.SCHEMA.replace("genre:string,seen", "").split(", ")]


def record(spark, asked, titles, source="catalogue_a", **more):
    """A candidate for each asked book whose title is a key of ``titles``."""
    row = dict.fromkeys(FIELDS[2:]) | {"source": source, "authors": ["LJ Ross"], "author_ids": []} | more
    rows = [(k, *[(row | {"title": t})[n] for n in FIELDS[2:]]) for k, t in titles.items()]
    known = spark.createDataFrame(rows, "key string, " + ", ".join(P.SCHEMA.split(", ")[2:]))
    return asked.select("book_id", F.col("title").alias("key")).join(known, "key").select("book_id", F.lit(0).cast("long").alias("pos"), *FIELDS[2:])


class Catalogue:
    """A transport that answers by request and keeps what it was asked."""

    def __init__(self, spark, answers):
        self.spark, self.answers, self.asked = spark, answers, []

    def __call__(self, wanted):
        self.asked.append(sorted(r.request for r in wanted.collect()))
        rows = [(q, *self.answers.get(q, (200, '{"data": {"editions": []}}', None))) for q in self.asked[-1]]
        return self.spark.createDataFrame(rows, requests.RECORDED)


def edition(title, isbn=None):
    said = f'"isbn_13": "{isbn}", ' if isbn else ""
    return 200, f'{{"data": {{"editions": [{{{said}"book": {{"title": "{title}", "contributions": [{{"contribution": "Author", "author": {{"id": 7, "name": "LJ Ross"}}}}]}}}}]}}}}', None


def test_a_catalogue_is_asked_about_open_books_only(spark):
    number = "9780306406157"
    books = spark.createDataFrame(
        [
            (1, "Cragside", ["LJ Ross"], number, "en-GB", None, "a"),  # found by its number
            (2, "Belsay", ["LJ Ross"], None, "eng", None, "b"),  # strong by its title in the first
            (3, "Heavenfield", ["LJ Ross"], None, None, None, "c"),  # in neither
            (4, "Holy Island", ["LJ Ross"], "9780306406164", None, None, "d"),  # its number fails
        ],
        BOOK,
    )
    isbn = lambda n: f'{{"form":"isbn","isbn":"{n}"}}'
    one = Catalogue(spark, {isbn(number): edition("Cragside", number), isbn("9780306406164"): (429, "slow", None),
                            '{"form":"title_code3","titles":["Belsay"],"language":"eng"}': edition("Belsay")})
    two = Catalogue(spark, {r'{"q":"intitle:\"Heavenfield\" inauthor:\"LJ Ross\"","maxResults":40}': (200, '{"totalItems": 0}', None)})
    by = correction.Catalogues(*requests.lookups({"catalogue_a": one, "catalogue_b": two}))
    got = {r.book_id: r for r in correction.decide(books, by, Options()).collect()}
    assert {k: r.route for k, r in got.items()} == {1: "match", 2: "match", 3: "unverified", 4: "waiting"}
    assert one.asked == [[isbn(number), isbn("9780306406164")], ['{"form":"title","titles":["Heavenfield"]}', '{"form":"title_code3","titles":["Belsay"],"language":"eng"}']]
    assert two.asked == [[r'{"q":"intitle:\"Heavenfield\" inauthor:\"LJ Ross\"","maxResults":40}']]
    assert got[4].outcome.reason == "catalogue_a could not be asked: rate limiting, HTTP 429" and got[3].outcome.tried == ["catalogue_a", "catalogue_b"]


def test_a_catalogue_with_nothing_left_is_not_asked(spark):
    books = spark.createDataFrame([(1, "Cragside", ["LJ Ross"], "9780306406157", None, None, "a")], BOOK)
    one = Catalogue(spark, {'{"form":"isbn","isbn":"9780306406157"}': edition("Cragside")})
    two = Catalogue(spark, {})
    correction.decide(books, correction.Catalogues(*requests.lookups({"catalogue_a": one, "catalogue_b": two})), Options()).collect()
    assert len(one.asked) == 1 and two.asked == []


def test_replies_without_what_was_asked_for_are_no_answers(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "book_id long, request string")
    told = spark.createDataFrame([("x", 200, '{"data": {}}', None), ("y", 200, '{"data": {"editions": []}}', None)], requests.RECORDED)
    got = {r.book_id: r for r in requests.answers(asked, told, "status", requests.DIALECTS["catalogue_a"].answers).collect()}
    assert got[1].failed.reason == "unreadable reply" and got[2].failed is None
    with pytest.raises(ValueError):
        requests.lookups({"catalogue_z": told})


def test_values_of_a_request_fill_the_service():
    from bindery.sources import live

    told = '{"form":"title_code2","titles":["A \\"b\\"","C"],"language":"en"}'
    service = live.Service("https://x.invalid/", forms={"title_code2": {"query": "q {titles}", "variables": {"titles": "{titles}", "language": "{language}", "none": "{none}"}}})
    asked = service.request(told, "")
    assert __import__("json").loads(asked.data) == {"query": "q {titles}", "variables": {"titles": ['A "b"', "C"], "language": "en"}}
    search = live.Service("https://x.invalid/v?key={key}", query={"q": "{q}", "langRestrict": "{langRestrict}", "maxResults": "{maxResults}"})
    assert search.request('{"q":"isbn:1&2","maxResults":40}', "k y").full_url == "https://x.invalid/v?key=k%20y&q=isbn%3A1%262&maxResults=40"


def test_a_day_has_its_calls_whoever_makes_them(spark):
    root, calls = shared_dir(spark, "calls"), []
    books = spark.createDataFrame([(k, t, ["LJ Ross"], None, None, None, f"/in/{k}") for k, t in ((1, "Heavenfield (The Ryan Mysteries Book 3)"), (2, "Heavenfield (The Ryan Mysteries Book 5)"))], BOOK)
    titles = {r.title: "Heavenfield" for r in books.collect()}
    by_title = lambda asked: ([("catalogue_a", lambda open_: (record(spark, open_, titles, series="R", series_number="9", genres=[("crime", "Crime")]), None))], None)

    def model(asked):
        rows = asked.collect()
        calls.extend(r.prompt for r in rows)
        return spark.createDataFrame([(r.id, catalogue_chat('{"pick": 1, "confidence": 0.95, "reason": "same"}')) for r in rows], "id long, reply string")

    by = correction.Catalogues(lambda asked: ([], None), by_title, choose=model, map_genre=model)
    for _ in range(3):
        take = state.DailyCalls(spark, root, 1).on("2024-03-01")  # a restart each time
        got = {r.book_id: r for r in correction.decide(books, by, Options(), take).collect()}
    assert len(calls) == 1 and calls[0].startswith("file=1; title=Heavenfield (The Ryan") and "catalogue_a" not in calls[0]
    assert {k: (r.route, r.outcome.reason) for k, r in got.items()} == {1: ("waiting", correction.SPENT), 2: ("waiting", correction.SPENT)}
    memory = correction.Memory(*(spark.createDataFrame([], s) for s in (state.NAMES, state.GENRES)), spark.createDataFrame([("Crime Fiction",)], "genre string"))
    stated = spark.createDataFrame([(1, "/in/1", ("catalogue_a", [("crime", "Crime")]))], "book_id long, path string, found struct<source:string,genres:array<struct<genre:string,seen:string>>>")
    wanted, mapped = correction.genres(stated, memory, model, Options(), state.DailyCalls(spark, root, 1).on("2024-03-01"))
    assert len(calls) == 1 and wanted.count() == mapped.count() == 0
    wanted, mapped = correction.genres(stated, memory, model, Options(dry_run=True), state.DailyCalls(spark, root, 0).on("2024-03-02"))
    assert len(calls) == 1 and mapped.count() == 0
    assert state.DailyCalls(spark, root, 1).spent("2024-03-01") == 1


def test_those_who_take_calls_at_once_take_turns(spark):
    root, given = shared_dir(spark, "calls"), []

    def take():
        calls = state.DailyCalls(spark, root, 7)
        given.extend(calls.take("2024-03-01", 2) for _ in range(3))

    threads = [threading.Thread(target=take) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(given) == 7 and sorted(given)[-3:] == [2, 2, 2]
    assert create_text(spark, f"{root}/x", "1") and not create_text(spark, f"{root}/x", "2")


def test_state_is_a_log_of_deltas(spark):
    kept = state.StateTable(spark, shared_dir(spark, "genres"), state.GENRES, state.merged_genres)
    row = lambda *r: spark.createDataFrame([r], state.GENRES)
    for k in range(state.MOST_DELTAS + 2):
        assert kept.append(row("a", "crime", f"to {k}", f"Crime {k}"), k) and not kept.append(row("a", "crime", "again", "x"), k)
        assert [tuple(r) for r in kept.read().collect()] == [("a", "crime", f"to {k}", "Crime 0")]
    folders = [n for n in names(spark, kept.root) if n.startswith("rows-")]
    assert len(names(spark, f"{kept.root}/log")) == state.KEPT_COMMITS and len(folders) <= state.MOST_DELTAS + 2
    # Another writer's commit between reading and writing is seen, not lost.
    other = state.StateTable(spark, kept.root, state.GENRES, state.merged_genres)
    seen = []

    def change(rows):
        if not seen:
            other.append(row("b", "new", "N", "n"))
        seen.append(rows.count())
        return rows.filter("genre <> 'crime'")

    kept.update(change)
    assert seen == [1, 2] and [r.genre for r in kept.read().collect()] == ["new"]


@pytest.fixture
def relay(spark, tmp_path):
    from bindery.plans.relay import Relay

    folders = {n: tmp_path / n for n in ("in", "out", "kept", "state")}
    for folder in list(folders.values())[:3]:
        folder.mkdir()
    titles = {"Cragside": "Cragside", "Belsay": "Belsay"}

    def by_title(asked):
        more = {"publisher": "Dark Skies", "genres": [("crime", "Crime")]}
        one = record(spark, asked, {"Cragside": "Cragside"}, **more)
        return [("catalogue_a", one.unionByName(record(spark, asked, {"Belsay": "Belsay"}, series="Only Here", authors=["L J  Ross"], **more)))], None

    def make(**more):
        answer = catalogue_chat('{"genre": "Crime"}')
        by = correction.Catalogues(lambda asked: ([], None), by_title, map_genre=lambda calls: calls.select("id", F.lit(answer).alias("reply")))
        return Relay(spark, *(str(folders[n]) for n in ("in", "out", "kept", "state")), by, Options(stable_checks=1, genres=("Crime",), **more))

    for n, title in (("a.epub", "Belsay"), ("b.epub", "Cragside")):
        (folders["in"] / n).write_bytes(book(title))
    return make, folders


def test_only_what_arrived_is_learned_and_a_retry_keeps_one_original(relay):
    make, at = relay
    (at["out"] / "a.epub").mkdir()  # nothing can be put there
    (at["out"] / "a.epub" / "x").write_bytes(b"x")
    one = make()
    one.start()
    lines = one.scan_once("2024-03-01", "2024-03-01T10:00:00Z")
    assert "not delivered" in lines[0] and "not delivered" not in lines[1]
    assert sorted(p.name for p in at["in"].iterdir()) == ["a.epub"] and epub.read_one((at["out"] / "b.epub").read_bytes())["publisher"] == "Dark Skies"
    learned = {(r.kind, r.standard, r.seen) for r in one.state["names"].read().collect()}
    assert learned == {("author", "LJ Ross", "LJ Ross")} and [r.matched_as for r in one.state["matches"].read().collect()] == ["Cragside"]
    assert [r.mapped for r in one.state["genres"].read().collect()] == ["Crime"] and one.state["journal"].read().isEmpty()
    again = make()
    again.scan_once("2024-03-01", "2024-03-01T10:00:05Z")
    assert sorted(p.name for p in at["kept"].iterdir() if not p.name.startswith(".")) == ["a.epub", "b.epub"]
    (at["out"] / "a.epub" / "x").unlink()
    (at["out"] / "a.epub").rmdir()
    again.scan_once("2024-03-01", "2024-03-01T10:00:10Z")
    assert not list(at["in"].iterdir()) and {r.standard for r in again.state["names"].read().collect()} == {"LJ Ross", "Only Here"}
    assert again.state["backed"].read().isEmpty() and sorted(p.name for p in at["kept"].iterdir() if not p.name.startswith(".")) == ["a.epub", "b.epub"]


def test_a_book_whose_original_cannot_be_kept_is_delivered_as_it_came(relay):
    make, at = relay
    came = (at["in"] / "a.epub").read_bytes()
    (at["kept"] / ".a.epub.bindery-tmp").mkdir()
    lines = make().scan_once("2024-03-01", "2024-03-01T10:00:00Z")
    assert "nothing written: the original could not be backed up" in lines[0] and "nothing written" not in lines[1]
    assert (at["out"] / "a.epub").read_bytes() == came and (at["kept"] / "b.epub").exists()
    assert {r.standard for r in make().state["names"].read().collect()} == {"LJ Ross"}


def test_a_pass_that_ended_early_is_learned_from_by_the_next(relay, monkeypatch):
    make, at = relay
    one = make()
    learn = type(one)._learn
    monkeypatch.setattr(type(one), "_learn", lambda self, rows: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        one.scan_once("2024-03-01", "2024-03-01T10:00:00Z")
    assert not list(at["in"].iterdir()) and one.state["names"].read().isEmpty()
    monkeypatch.setattr(type(one), "_learn", learn)
    assert make().scan_once("2024-03-01", "2024-03-01T10:00:05Z") == []
    # The first file of the folder tells the spelling.
    assert {r.standard for r in one.state["names"].read().collect()} == {"L J  Ross", "Only Here"} and one.state["journal"].read().isEmpty()


def test_a_dry_run_tells_of_each_version_once(relay):
    make, at = relay
    dry = make(dry_run=True)
    assert len(dry.scan_once("2024-03-01", "2024-03-01T10:00:00Z")) == 2
    assert make(dry_run=True).scan_once("2024-03-01", "2024-03-01T10:00:05Z") == []
    (at["in"] / "b.epub").write_bytes(book("Cragside", "L. J. R."))
    assert [x.split(" | ")[0] for x in dry.scan_once("2024-03-01", "2024-03-01T10:00:10Z")] == ["b.epub"]
    assert dry.calls.spent("2024-03-01") == 0 and len(list(at["in"].iterdir())) == 2


def test_a_stopped_loop_makes_no_further_pass(relay, monkeypatch):
    make, _ = relay
    one, passes = make(), []
    monkeypatch.setattr(type(one), "scan_once", lambda self, day, now: (passes.append(now), self.stop.set() if len(passes) == 2 else None, [])[2])
    one.poll(rest=lambda seconds: None)
    assert len(passes) == 2
