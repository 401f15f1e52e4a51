"""A folder as a stream: what is told when, over restarts."""

import time

from bindery.streaming import folder


def test_marks_are_told_once_a_day_after_they_settled():
    seen = lambda *marks, day="1": [(m, day) for m in marks]
    state, told = folder.step(None, seen("a", "b", "b", "b"), 2)
    assert told == ["b"] and state == ("b", 3, "1")
    state, told = folder.step(state, seen("b"), 2)
    assert told == []
    state, told = folder.step(state, seen("b", "b", day="2"), 2)
    assert told == ["b"]  # still there on the next day
    assert folder.step(state, seen("c", "b", "b", day="2"), 2)[1] == ["b"]
    assert folder.step(None, seen("a"), 1)[1] == ["a"]
    assert folder.midnight(0) == 86_400_000 == folder.midnight(86_399_999)


def test_listings_are_read_again_as_they_were(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a b.epub").write_bytes(b"1")
    reader = folder.FolderSightings({"path": str(tmp_path / "in"), "log": str(tmp_path / "log")}).streamReader(None)
    first = reader.latestOffset()
    (tmp_path / "in" / "b").write_bytes(b"2")
    second = folder._Reader(str(tmp_path / "in"), str(tmp_path / "log")).latestOffset()
    assert (first, second) == ({"listing": 0}, {"listing": 1})
    told = [[r[:2] for r in reader.read(p)] for p in reader.partitions({"listing": -1}, second)]
    assert told == [[(0, f"file:{tmp_path}/in/sub/a b.epub")], [(1, f"file:{tmp_path}/in/b"), (1, f"file:{tmp_path}/in/sub/a b.epub")]]
    reader.commit(second)
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["000000000001.json"]
    assert folder.listed(str(tmp_path / "none")) == []


def until(what, seconds=60):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.3)
    assert what()


def test_a_watched_folder_tells_of_each_file_once_over_restarts(spark, tmp_path):
    from bindery.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"1")
    told = []

    def handle(batch, number):
        told.extend((r.path.rpartition("/")[2], r.mark, number) for r in batch.collect())

    start = lambda: folder.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), handle, checks=2, every=0.5)
    query = start()
    until(lambda: told)
    listed = files.listing(spark, str(tmp_path / "in")).first()
    query.stop()
    assert [t[:2] for t in told] == [("a", listed.mark)] and query.exception() is None
    (tmp_path / "in" / "b").write_bytes(b"2")
    query = start()
    until(lambda: len(told) > 1)
    (tmp_path / "in" / "a").write_bytes(b"changed")
    until(lambda: len(told) > 2)
    query.stop()
    assert [t[0] for t in told] == ["a", "b", "a"] and told[2][1] != told[0][1]


def test_a_path_that_left_is_forgotten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"1")
    told = []
    query = folder.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda batch, n: told.extend(batch.collect()), checks=1, every=0.5, forget_after=3.0)
    until(lambda: told)
    kept = (tmp_path / "in" / "a").stat()
    (tmp_path / "in" / "a").unlink()
    time.sleep(12)
    (tmp_path / "in" / "a").write_bytes(b"1")
    __import__("os").utime(tmp_path / "in" / "a", ns=(kept.st_atime_ns, kept.st_mtime_ns))
    until(lambda: len(told) > 1)  # the same mark, and told again
    query.stop()
    assert told[0] == told[1]


def test_the_relay_on_the_stream(spark, tmp_path):
    import threading

    from bindery.options import Options
    from bindery.plans import correction
    from bindery.plans.relay import Relay

    for n in ("in", "out", "kept"):
        (tmp_path / n).mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"1")
    (tmp_path / "in" / "y.part").write_bytes(b"1")
    relay = Relay(spark, *(str(tmp_path / n) for n in ("in", "out", "kept", "state")), correction.Catalogues(lambda b: ([], None), lambda b: ([], None)), Options(stable_checks=1, poll_seconds=1))
    lines = []
    thread = threading.Thread(target=lambda: relay.watch(lines.append))
    thread.start()
    until(lambda: lines, 120)
    relay.stop.set()
    thread.join(60)
    assert not thread.is_alive() and lines == ["x.bin | no book | no change"]
    assert [p.name for p in (tmp_path / "in").iterdir()] == ["y.part"] and (tmp_path / "out" / "x.bin").read_bytes() == b"1"
