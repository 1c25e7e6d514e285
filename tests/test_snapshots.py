"""Shadows that become active in one step, and listings in pages."""

import random
import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quernstone.sources import listing, manifest, snapshots


def table(spark, n, of):
    return spark.createDataFrame([(i, of) for i in range(n)], "id int, of string")


def test_a_shadow_becomes_active_in_one_step(spark, tmp_path):
    root = str(tmp_path)
    a = snapshots.shadow(spark, root, "units", table(spark, 3, "a"))
    with pytest.raises(KeyError):
        snapshots.read(spark, root, ["units"])
    snapshots.activate(spark, root, {"units": (None, a)})
    old = manifest.latest(spark, root)
    b = snapshots.shadow(spark, root, "units", table(spark, 4, "b"))
    assert {r["of"] for r in snapshots.read(spark, root, ["units"])["units"].collect()} == {"a"}
    snapshots.activate(spark, root, {"units": (a, b)})
    assert snapshots.read(spark, root, ["units"])["units"].count() == 4
    assert snapshots.read(spark, root, ["units"], old)["units"].count() == 3  # a reader of before
    with pytest.raises(manifest.Conflict):
        snapshots.activate(spark, root, {"units": ("someone else's", a)})
    with pytest.raises(KeyError):
        snapshots.activate(spark, root, {"units": (b, "none such")})


def test_the_same_rows_make_no_version(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.replace(spark, root, "acl", table(spark, 5, "x"))
    n = manifest.latest(spark, root).number
    assert not snapshots.replace(spark, root, "acl", table(spark, 5, "x").repartition(3).orderBy(F.desc("id")))
    assert manifest.latest(spark, root).number == n
    assert snapshots.replace(spark, root, "acl", table(spark, 5, "y"))
    assert len(manifest.latest(spark, root).entries["acl"]["tables"]) == 1


def test_of_two_writers_one_meets_a_conflict_and_readers_see_pairs(spark, tmp_path):
    root = str(tmp_path)
    slots = ("units", "vectors")
    names = {w: {s: snapshots.shadow(spark, root, s, table(spark, 2, w)) for s in slots} for w in ("old", "one", "two")}
    snapshots.activate(spark, root, {s: (None, names["old"][s]) for s in slots})
    outcome, pairs, barrier = {}, [], threading.Barrier(3)

    def write(w):
        barrier.wait()
        try:
            snapshots.activate(spark, root, {s: (names["old"][s], names[w][s]) for s in slots})
            outcome[w] = "active"
        except manifest.Conflict:
            outcome[w] = "conflict"

    def read():
        barrier.wait()
        for _ in range(6):
            both = snapshots.read(spark, root, list(slots))
            pairs.append(tuple(both[s].first()["of"] for s in slots))

    threads = [threading.Thread(target=write, args=(w,)) for w in ("one", "two")] + [threading.Thread(target=read)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcome.values()) == ["active", "conflict"]
    assert all(a == b for a, b in pairs)


@pytest.mark.parametrize("order", [("-day", "id"), ("name", "-id")])
def test_pages_are_the_whole_listing(spark, tmp_path, order):
    rnd = random.Random(3)
    rows = [(i, date(2024, 1, 1) + timedelta(days=rnd.randrange(60)), rnd.choice(["a", "b", None, "c"])) for i in range(700)]
    kind = "id long, day date, name string"
    own = listing.Listing(spark, str(tmp_path), order)
    listing.add(own, spark.createDataFrame(rows[:600], kind), per_file=50)
    listing.add(own, spark.createDataFrame(rows[600:], kind), per_file=50)
    want = [tuple(r) for r in spark.createDataFrame(rows, kind).orderBy(*own.by()).collect()]
    got, after, files = [], None, []
    while True:
        found, after = listing.page(own, 90, after)
        got += [tuple(r) for r in found.collect()]
        files.append(len(found.inputFiles()))
        if after is None:
            break
    assert got == want
    assert max(files) <= 2 * (2 + 90 // 30)  # of 14 files, some of them short


def test_added_rows_move_no_page_and_filters_fill_pages(spark, tmp_path):
    own = listing.Listing(spark, str(tmp_path), ("id",))
    listing.add(own, spark.range(0, 1000, 2), per_file=40)
    first, after = listing.page(own, 100)
    assert [r["id"] for r in first.collect()] == list(range(0, 200, 2))
    listing.add(own, spark.createDataFrame([(i,) for i in (1, 3, 201, 203)], "id long"))
    second, after = listing.page(own, 100, after)
    assert [r["id"] for r in second.collect()] == sorted([*range(200, 396, 2), 201, 203])
    some, after = listing.page(own, 10, None, F.col("id") % 100 == 0)
    assert [r["id"] for r in some.collect()] == list(range(0, 1000, 100)) and listing.page(own, 10, after, F.col("id") % 100 == 0)[0].count() == 0
