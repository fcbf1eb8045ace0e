"""Folders, missing files, formats of one's own, options and output names against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from cueflow.functions.names import FORMATS, Format, format_by_extension, matches_extension
from cueflow.operators import loss, paths
from cueflow.operators.detect import Signature
from cueflow.plans.convert import Options, convert, convert_to_files, without
from cueflow.plans.formats import register_format, unregister_format
from cueflow.plans.parse import parse_sbv
from cueflow.plans.write import write_sbv
from cueflow.sources import files
from cueflow.streaming import ingest

SRT = "1\n00:00:01,000 --> 00:00:02,000\nHello\n"


@pytest.fixture
def folder(tmp_path):
    for name in ("b.srt", "A.Srt", "c.SRT", "d.txt", "noext", "e.SubRip"):
        (tmp_path / name).write_text(SRT)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.srt").write_text(SRT)
    return tmp_path


def test_folders_and_files_together(spark, folder):
    given = [f" {folder}/noext ", "", str(folder), f"{folder}/gone.srt", f"{folder}/d.txt", f"{folder}/b.srt"]
    got = [r.path.rsplit("/", 1)[1] for r in files.expand_paths(spark, given).orderBy("pos").collect()]
    assert got == ["noext", "A.Srt", "b.srt", "c.SRT", "e.SubRip", "gone.srt", "d.txt", "b.srt"]
    assert files.is_folder(spark, str(folder)) and not files.is_folder(spark, f"{folder}/b.srt") and not files.is_folder(spark, f"{folder}/none")
    read = {(r.pos, r.path.rsplit("/", 1)[1]): r.content for r in files.read_paths(spark, given).collect()}
    assert {k[1] for k in read} == {"noext", "A.Srt", "b.srt", "c.SRT", "e.SubRip", "gone.srt"} and len(read) == 7
    assert [k[1] for k, v in read.items() if v is None] == ["gone.srt"]
    assert files.read_folder(spark, str(folder)).count() == 4
    picked = files.type_filters()
    assert files.read_folder(spark, str(folder), *picked["All files"]).count() == 6 and "*.srt" in picked["Subtitles and lyrics"] and len(picked["Subtitles and lyrics"]) == 6
    assert files.read_paths(spark, [f"{folder}/gone.srt"]).count() == 1


def test_batch_with_a_missing_file(spark, folder, tmp_path):
    given = files.read_paths(spark, [f"{folder}/b.srt", f"{folder}/gone.srt"])
    there = spark.createDataFrame([(str(folder),)], "path string")
    existing = given.select("path")
    rows = {r.pos: r for r in convert(given, Options(target="vtt"), existing, there).collect()}
    assert rows[0].status == "succeeded" and rows[0].output_path.endswith("/b.vtt") and bytes(rows[0].output).startswith(b"WEBVTT")
    assert (rows[1].status, rows[1].failure) == ("failed", "readFailed")
    gone = convert(given, Options(target="vtt", directory="/no/such"), existing, there).collect()
    assert {r.failure for r in gone} == {"targetPathUnavailable", "readFailed"}
    out = tmp_path / "out.vtt"
    written = files.write_files(spark.createDataFrame([(str(out), b"x"), ("/no/such/folder/x", b"x")], "output_path string, output binary")).collect()
    assert out.read_bytes() == b"x" and {r.path: r.failure for r in written} == {str(out): None, "/no/such/folder/x": "readFailed"}
    assert [r.pos for r in without(given, spark.createDataFrame([(1,)], "pos bigint")).collect()] == [0]


def test_files_as_they_arrive(spark, folder, tmp_path_factory):
    out, checkpoint = (str(tmp_path_factory.mktemp("stream") / x) for x in ("out", "checkpoint"))
    run = lambda: ingest.convert_folder(spark, str(folder), out, checkpoint, Options(target="vtt")).awaitTermination(300)
    run()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 4 and all(r.content.startswith("WEBVTT") and r.source_format == "srt" for r in rows)
    (folder / "late.lrc").write_text("[00:01.00]one\n[00:02.00]two\n")
    run()
    late = [r for r in spark.read.parquet(out).collect() if r.source_format == "lrc"]
    assert len(late) == 1 and late[0].cue_count == 2


def test_names_over_batches(spark, tmp_path, tmp_path_factory):
    """Two batches that ask for one name get it and its first form, also after a restart, and no table is left."""
    out, checkpoint = (str(tmp_path_factory.mktemp("stream") / x) for x in ("out", "checkpoint"))
    run = lambda: ingest.convert_folder(spark, str(tmp_path), out, checkpoint, Options(target="vtt", directory="/o", bom=True), existing=spark.createDataFrame([("/o/z.vtt",)], "path string")).awaitTermination(300)
    wanted = []
    for name, text in (("x.srt", SRT), ("x.lrc", "[00:01.00]one\n[00:02.00]two\n"), ("x.sbv", "0:00:01.000,0:00:02.000\nx\n"), ("z.srt", SRT)):
        (tmp_path / name).write_text(text)
        run()
        wanted.append(name)
    rows = spark.read.parquet(out).collect()
    got = {r.source_path.rsplit("/", 1)[1]: r.output_path for r in rows}
    assert got == {"x.srt": "/o/x.vtt", "x.lrc": "/o/x (1).vtt", "x.sbv": "/o/x (2).vtt", "z.srt": "/o/z (1).vtt"}
    assert all(r.content.startswith("WEBVTT") and bytes(r.output).startswith(b"\xef\xbb\xbf") for r in rows)


def _parts(folder):
    return [p.name for p in folder.rglob("*") if p.name.startswith(".")]


def test_written_files_and_progress(spark, folder, tmp_path):
    """Every file of a batch under its name, the last one where all overwrite, none half written, and progress on the way."""
    out, told = tmp_path / "o", []
    out.mkdir()
    (out / "b.vtt").write_text("old")
    given = files.read_paths(spark, [f"{folder}/b.srt", f"{folder}/A.Srt", f"{folder}/gone.srt", f"{folder}/b.srt", f"{folder}/noext"])
    rows = {r.pos: r for r in convert_to_files(given, Options(target="vtt", directory=str(out)), progress=lambda *x: told.append(x)).collect()}
    assert [rows[i].output_path and rows[i].output_path.rsplit("/", 1)[1] for i in range(5)] == ["b (1).vtt", "A.vtt", None, "b (2).vtt", "noext.vtt"]
    assert rows[2].failure == "readFailed" and all(rows[i].elapsed_ms >= 0 for i in rows)
    assert sorted(p.name for p in out.iterdir()) == ["A.vtt", "b (1).vtt", "b (2).vtt", "b.vtt", "noext.vtt"]
    assert (out / "b.vtt").read_text() == "old" and (out / "b (2).vtt").read_text().startswith("WEBVTT")
    assert told[-1] == (5, 5, 1)
    both = spark.createDataFrame([(0, f"{folder}/q.srt", SRT.encode()), (1, f"{folder}/q.sbv", b"0:00:01.000,0:00:02.000\nlast\n")], "pos bigint, path string, content binary")
    both = both.withColumn("length", F.lit(1).cast("bigint"))
    rows = convert_to_files(both, Options(target="vtt", directory=str(out), policy="overwrite")).collect()
    assert {r.status for r in rows} == {"succeeded"} and "last" in (out / "q.vtt").read_text()
    skipped = convert_to_files(both, Options(target="vtt", directory=str(out), policy="skip")).collect()
    assert {r.status for r in skipped} == {"skipped"} and not _parts(out)
    gone = convert_to_files(both, Options(target="vtt", directory=f"{out}/none")).collect()
    assert {r.failure for r in gone} == {"targetPathUnavailable"}


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "o"
    out.mkdir()
    df = spark.range(40, numPartitions=4).select(F.concat(F.lit(f"{out}/f"), F.col("id").cast("string")).alias("output_path"), F.when(F.col("id") == 37, F.raise_error(F.lit("killed"))).otherwise(F.lit("x")).cast("binary").alias("output"))
    with pytest.raises(Exception, match="killed"):
        files.write_files(df)
    assert list(out.iterdir()) == []
    written = files.write_files(df.filter("output_path NOT LIKE '%/f37'")).collect()
    assert len(written) == 39 and {r.failure for r in written} == {None} and not _parts(out) and len(list(out.iterdir())) == 39
    # Of rows that share a path the last one stays.
    same = spark.createDataFrame([(i, f"{out}/same", bytes([65 + i])) for i in range(5)], "pos int, output_path string, output binary").repartition(5)
    files.write_files(same, order="pos")
    assert (out / "same").read_bytes() == b"E" and not _parts(out)


def test_many_folders_are_listed_by_tasks(spark, tmp_path):
    given = []
    for i in range(600):
        if i % 3 == 0:
            (tmp_path / f"d{i}").mkdir()
            for n in ("B.srt", "a.vtt", "x.txt"):
                (tmp_path / f"d{i}" / n).write_text(SRT)
        given.append(f"{tmp_path}/d{i}" if i % 3 == 0 else f"{tmp_path}/no{i}.srt")
    want = [p for i, g in enumerate(given) for p in ([f"{g}/a.vtt", f"{g}/B.srt"] if i % 3 == 0 else [g])]
    listed = files.expand_paths(spark, given)
    assert [r.path for r in listed.orderBy("pos").collect()] == want and [r.pos for r in listed.orderBy("pos").collect()] == list(range(len(want)))
    assert files.expand_paths(spark, []).count() == 0 and files.expand_paths(spark, [" "]).count() == 0


def test_format_of_ones_own(spark):
    mine = Format("qsv", "QSV", ("quick",))
    register_format(mine, parse_sbv, write_sbv, [Signature("qsv", "qsv.mark", 500, "contains", "quick-mark")])
    try:
        with pytest.raises(ValueError):
            register_format(mine, parse_sbv, write_sbv)
        body = b"0:00:01.000,0:00:02.000\nquick-mark\n"
        given = spark.createDataFrame([(0, "/in/a.quick", len(body), body), (1, "/in/b", 5, b"hello")], "pos bigint, path string, length bigint, content binary")
        none = spark.sql("SELECT '' AS path WHERE false")
        rows = {r.pos: r for r in convert(given, Options(target="srt"), none).collect()}
        assert (rows[0].status, rows[0].source_format, rows[0].output_path) == ("succeeded", "qsv", "/in/a.srt")
        assert rows[1].failure == "unsupportedFormat"
    finally:
        unregister_format("qsv")
    assert "qsv" not in FORMATS


def test_clock_values_that_raise(spark):
    from cueflow.functions.timecode import parse_ms_or_raise

    df = spark.createDataFrame([("00:00:01,5",), (None,)], "raw string")
    assert [r.ms for r in df.select(parse_ms_or_raise(F.col("raw")).alias("ms")).collect()] == [1500, None]
    with pytest.raises(Exception, match="no clock value: 1:2"):
        spark.createDataFrame([("1:2",)], "raw string").select(parse_ms_or_raise(F.col("raw"))).collect()


def test_options_are_kept(tmp_path):
    path, options = str(tmp_path / "options.json"), Options(target="ass", offset_ms=-5, strip_media=True)
    options.save(path)
    assert Options.load(path) == options and Options.load(str(tmp_path / "none.json")) == Options()
    assert Options.from_settings({"target": "xyz", "offset_ms": True, "bom": True, "other": 1}) == Options(bom=True)
    for bad in ({"target": "xyz"}, {"policy": "maybe"}, {"directory": " "}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_labels_and_extensions(spark):
    kinds = [*loss.LOSSES, *loss.FAILURES]
    df = spark.createDataFrame([(k,) for k in [*kinds, "odd", None]], "kind string")
    got = {r.kind: r.label for r in df.select("kind", loss.label(F.col("kind")).alias("label")).collect()}
    assert got[None] is None and got["odd"] == loss.FAILURES["unknown"] and len({got[k] for k in kinds}) == len(kinds)
    df = spark.createDataFrame([("/a/x.WebVTT",), ("vtt",), (".Srt",), ("x.txt",)], "name string")
    rows = df.select("name", matches_extension(F.col("name"), "vtt").alias("vtt"), format_by_extension(F.col("name")).alias("own")).collect()
    assert [(r.vtt, r.own) for r in rows] == [(True, None), (True, "vtt"), (False, "srt"), (False, None)]


def _plain(rows, existing, policy):
    taken, out = set(existing), {}
    for pos, source, want in sorted(rows):
        own = source == want
        base, ext = want.rsplit(".", 1)
        if not own and (policy == "overwrite" or want not in taken):
            name = want
        elif policy == "skip":
            name = None
        else:
            name = next((c for c in (f"{base} ({i}).{ext}" for i in range(1, 501)) if c not in taken and c != source), None)
        out[pos] = name
        taken.add(name)
    return out


@pytest.mark.parametrize("policy", ["autoRename", "overwrite", "skip"])
def test_names_one_after_another(spark, policy):
    rng = random.Random(4)
    stems = ["a", "a (1)", "a (2)", "a (499)", "a (500)", "a (501)", "b", "b (3) (2)", "b (3)"]
    rows = []
    for pos in range(2600):
        stem = "a" if rng.random() < 0.5 else rng.choice(stems)
        rows.append((pos, f"/in/{stem}.{rng.choice(['srt', 'vtt', 'sbv', 'lrc'])}", f"/in/{stem}.srt"))
    rows += [(3000 + i, f"/in/a ({i}).srt", "/in/a.srt") for i in (1, 7, 501)]
    existing = ["/in/a (4).srt", "/in/b.srt", "/in/unrelated.srt", "/in/a (499) (1).srt"]
    df = spark.createDataFrame(rows, "pos bigint, path string, requested string")
    got = {r.pos: r.output_path for r in paths.assign(df, spark.createDataFrame([(p,) for p in existing], "path string"), policy).collect()}
    assert got == _plain(rows, existing, policy)


def test_repeated_sources_and_spellings(spark):
    """A source that is asked for twice is never replaced, however it is spelt."""
    rows = [(0, "/in/a.srt", "/in/a.srt"), (1, "/in/a.srt", "/in/a.srt"), (2, "/in/x/../b.srt", "/in//b.srt"), (3, "c.srt", "/work/c.srt"), (4, "/in/./d.srt", "/in/d.srt"), (5, "/in/e.srt", "/in/f.srt"), (6, "/in/g (1).srt", "/in/g.srt"), (7, "/in/h.srt", "/in/g.srt")]
    df = spark.createDataFrame(rows, "pos bigint, path string, requested string")
    there = spark.createDataFrame([("/in/g.srt",), ("/in/f.srt",)], "path string")
    for policy in ("overwrite", "autoRename"):
        got = {r.pos: (r.output_path, r.renamed) for r in paths.assign(df, there, policy, folder="/work").collect()}
        assert [got[i] for i in range(5)] == [("/in/a (1).srt", True), ("/in/a (2).srt", True), ("/in//b (1).srt", True), ("/work/c (1).srt", True), ("/in/d (1).srt", True)]
        assert got[5] == (("/in/f.srt", False) if policy == "overwrite" else ("/in/f (1).srt", True))
        assert [got[i][0] for i in (6, 7)] == (["/in/g.srt"] * 2 if policy == "overwrite" else ["/in/g (2).srt", "/in/g (1).srt"])
    assert {r.reason for r in paths.assign(df, there, "skip", folder="/work").collect() if r.pos < 5} == {paths.WOULD_OVERWRITE}
