"""The dossier sink: all or nothing."""

import os
from pathlib import Path

import pytest

from rallyframe.plans import bind, dossier
from rallyframe.sources import dossier_sink
from rallyframe.sources.store import shared_folder


def local(path):
    return Path(path.removeprefix("file://"))


def texts(path):
    now = dossier_sink.current(path)
    return {str(f.relative_to(local(now))): f.read_text() for f in local(now).rglob("*") if f.is_file()} if now else None


def test_a_bad_dossier_leaves_no_file_and_a_good_batch_replaces_all(spark):
    path = shared_folder(spark, "sink")
    frame = lambda rows: spark.createDataFrame(rows, "directory string, text string").repartition(3)
    for bad in (("../x", "# a"), ("a", "no heading"), ("a", None), (None, "# a"), ("a", "# a\x00"), ("A b", "# a"), ("", "# a")):
        with pytest.raises(Exception):
            dossier_sink.write(frame([("b", "# b"), bad]).coalesce(1), path)
        assert texts(path) is None and not (local(path).exists() and [f for f in local(path).rglob("*") if f.is_file()])
    dossier_sink.write(frame([("a", "# one"), ("b", "# two\n\ttext"), ("c-1", "<!doctype html>\n")]), path)
    first = {"a/dossier.md": "# one", "b/dossier.md": "# two\n\ttext", "c-1/dossier.md": "<!doctype html>\n"}
    assert texts(path) == first
    with pytest.raises(Exception, match="several dossiers for a/dossier.md"):
        dossier_sink.write(frame([("a", "# x"), ("a", "# y"), ("b", "# z")]), path)
    with pytest.raises(Exception, match="heading"):
        dossier_sink.write(frame([("a", "# x"), ("b", "z")]), path)
    assert texts(path) == first
    named = spark.createDataFrame([("d", "index.html", "<!DOCTYPE html>x"), ("d", "dossier.md", "# d")], "directory string, name string, text string")
    dossier_sink.write(named, path)
    assert texts(path) == {"d/index.html": "<!DOCTYPE html>x", "d/dossier.md": "# d"}
    dossier_sink.write(frame([]), path)
    assert texts(path) == {}
    assert sorted(f for f in os.listdir(local(path)) if not f.startswith(".")) == sorted(["CURRENT", local(dossier_sink.current(path)).name])


def test_dossiers_of_the_tables_are_written(spark):
    sf = "/root/testdata/sf0.001"
    teams = bind.teams(spark, sf)
    none = spark.createDataFrame([], "team_id int, wins long, losses long")
    said = dossier.markdown(teams, none, bind.players(spark, sf), spark.createDataFrame([], "player_id long, wins long, losses long, undecided long"))
    path = shared_folder(spark, "sink")
    dossier.write(said, dossier.directory_names(teams), path)
    got = texts(path)
    assert len(got) == 25 and all(t.startswith("# ") for t in got.values())
