import hashlib
import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from frames import landing
from ruletrace.functions import cells, labels
from ruletrace.plans import candidates
from ruletrace.sources import integrity
from ruletrace.sources.integrity import manifest_state
from ruletrace.sources.load import EmptyExport, RepeatedKeys, load
from ruletrace.sources.landing import TABLES, loads, read_landing, repeated_keys, write_landing
from ruletrace.sources.mapping import DEFAULT_MAP, load_map, table_ids, wanted_columns
from ruletrace.sources.profiles import PROFILES, get_profile, thin
from ruletrace.sources.json_records import records
from ruletrace.sources.reader import carried_columns, read_table, write_table
from ruletrace.sources.screen import DeniedSource, check_names
from ruletrace.sources.sink import write_ordered

A, B = "rec" + "A" * 14, "rec" + "B" * 14


def evaluate(spark, values, sql):
    df = cells.with_cells(spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                                                "i int, c string"), ["c"])
    return [r.x for r in df.selectExpr("i", f"{sql} AS x").orderBy("i").collect()]


def test_link_cells(spark):
    shapes = ['[{"id":"a","name":"x"},{"name":"y"},{"id":""}]', '["a","b",""]', " a , b,, ", "[]", "", None,
              "null", f"{A}, {B}", "[broken, b", "[1, 2.5]"]
    assert evaluate(spark, shapes, cells.links("c")) == [
        ["a"], ["a", "b"], ["a", "b"], [], [], [], [], [A, B], ["[broken", "b"], ["1", "2.5"]]


def test_plain_links_are_those_of_parsed_cells(spark):
    shapes = {'["a-1.b"]': ["a-1.b"], '[{"id":"a","name":"x y"}]': ["a"], '[{"id": "a", "name": ""}]': ["a"], '[{"id":"a"}]': ["a"],
              '["a", "b"]': ["a", "b"], '["a\\"b"]': ['a"b'], '["\\u0061"]': ["a"], '["{\\"id\\":\\"z\\"}"]': ["z"], '[{"id":"é"}]': ["é"],
              '[{"name":"x","id":"a"}]': ["a"], '[{"id":"a","name":"x"}': ['[{"id":"a"', '"name":"x"}'], '["a"': ['["a"'], '[""]': []}
    assert evaluate(spark, list(shapes), cells.links("c")) == list(shapes.values())
    rows = cells.with_cells(spark.createDataFrame([('["a"]',)], "c string"), ["c"]).selectExpr(f"{cells.links('c')} AS ids")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "c#json" not in plan  # nothing is parsed beforehand


def test_select_cells(spark):
    shapes = [" plain ", '{"name":"n","id":"i"}', '{"id":"i"}', '["x","y"]', '[{"name":"n"}]', "[]", "{}",
              "{broken", "", None, "null", "   ", '[["deep"]]']
    assert evaluate(spark, shapes, cells.scalar("c")) == [
        "plain", "n", "i", "x", "n", None, None, "{broken", None, None, None, None, "deep"]


def test_timestamps(spark):
    texts = ["2026-06-12T16:00:00.123Z", "2026-06-12T16:00:00Z", "2026-06-12T16:00:00",
             "2026-06-12 16:00:00", "2026-06-12 16:00", "2026-06-12", "junk", "", None]
    noon = datetime(2026, 6, 12, 16)
    assert evaluate(spark, texts, cells.parse_ts("c")) == [
        noon.replace(microsecond=123000), noon, noon, noon, noon, datetime(2026, 6, 12), None, None, None]
    assert evaluate(spark, texts[5:7], cells.parse_date("c")) == [datetime(2026, 6, 12).date(), None]


def test_whole_numbers(spark):
    assert evaluate(spark, ["12.9", "-3.7", "1e2", "abc", "nan", "inf", " 7 ", None], cells.parse_int("c")) == [
        12, -3, 100, None, None, None, 7, None]


def test_override_lines_and_labels(spark):
    lines = ["late :: ann :: 2026-06-01", "a :: b :: c :: d", "no separator"]
    got = evaluate(spark, lines, cells.override_line("c"))
    assert [tuple(r) for r in got] == [("late", "ann", "2026-06-01"), ("a", "b :: c", "d"),
                                       ("no separator", None, None)]
    assert evaluate(spark, [f"dbl-{A}-mv_{B}", "Day v12", "42", "Ä x"], cells.label_class("c")) == [
        "dbl", "day v", "unlabelled", "x"]


def test_opaque_ids_hash_a_missing_part_as_none(spark):
    digest = hashlib.sha256("x\x1fNone".encode()).hexdigest()[:12]
    assert evaluate(spark, ["x"], cells.opaque_id("c", "CAST(NULL AS STRING)", prefix="ch_")) == [f"ch_{digest}"]


def test_slugs_and_quotes(spark):
    long = "word " * 20
    text = ("word-" * 20).strip("-")
    assert evaluate(spark, ["Big Van!", "--", long], labels.slug("c")) == [
        "big-van", "unnamed", text[:40] + "-" + hashlib.sha256(text.encode()).hexdigest()[:7]]
    values = ["x", "it's", 'a"b', "it's \"q\"", "a\\b"]
    assert evaluate(spark, values, labels.quoted("c")) == [repr(v) for v in values]


def test_denied_names(spark):
    assert check_names(spark, ["Daily Ops.json", "conflict rules old.csv"]) == 2
    with pytest.raises(DeniedSource, match="2 denied"):
        check_names(spark, ["CONFIG-THRESHOLDS.CSV", "my Dispatch Board export.json", "Boats.csv"])


def test_map_helpers():
    assert wanted_columns(DEFAULT_MAP, ("Movements",))["Boats"] == ["Boat number", "Location"]
    ids = {"work": [{"table": "x", "id_prefix": "lc_", "table_id": "t1"}],
           "location_travel": [{"table": "y", "id_prefix": "lc_", "table_id": "t2"}]}
    assert table_ids(ids) == {"lc_": "t1"}
    with pytest.raises(ValueError, match="nope"):
        get_profile("nope")


@pytest.fixture()
def export(tmp_path):
    folder = tmp_path / "export"
    folder.mkdir()
    ops = [
        {"id": "rec1", "Trip start": "2026-06-01T10:00:00.000Z", "Trip end": "2026-06-01T12:00:00Z",
         "Trip type": "day", "Guest count": 12, "Lead Guide (link)": [{"id": "g1", "name": "Ann"}],
         "Vehicle": ["v1", "v2"], "Status": {"name": "Planned"}},
        {"id": "rec2", "fields": {"Date": "2026-06-02", "Lead Guide (link)": "g1, g2", "Trip type": None,
                                  "Acknowledged conflicts": "Late v1 :: ann :: 2026-06-01\nLate v2 :: ann :: 2026-06-01\n\nodd"}},
        {"Trip type": "no id"},
    ]
    (folder / "Daily Ops.json").write_text(json.dumps(ops))
    (folder / "Movements.json").write_text(json.dumps({"records": [
        {"id": "m1", "fields": {"Start": "2026-06-01 08:00", "Movement Type": ["t9"], "Origin": ["o1"],
                                "Driver (link)": ["g2"]}}]}))
    (folder / "Rig Assignments.json").write_text(
        '{"id": "x2", "Daily Op": ["rec1"], "Vehicle": ["v1"]}\n{"id": "x1", "Daily Op": ["rec1"], "Vehicle": ["v1"]}\n')
    (folder / "Guides & Staff.csv").write_bytes(
        b'\xef\xbb\xbfid,Name,Location base\ng1,"Ann, A",\ng2,Bob,\n')
    (folder / "Vehicles.csv").write_text('id,Unit name,Type\nv1,One,Van\nv2,Two,\n')
    (folder / "Routes.csv").write_text('id,From,To,Drive minutes,Sample count\n1,o1,o2,35.5,0\n2,o1,o3,,4\n3,o1,o4,10,2\n')
    return folder


def test_written_tables_read_back_in_id_order(spark, export, tmp_path):
    columns = ["Trip type", "Lead Guide (link)", "Acknowledged conflicts"]
    df = read_table(spark, str(export), "Daily Ops", columns)
    write_table(df.select("id", *columns).filter("id IS NOT NULL"), str(tmp_path), "Daily Ops")
    lines = [json.loads(line)["id"] for part in sorted((tmp_path / "Daily Ops.json").glob("part-*"))
             for line in part.read_text().splitlines()]
    assert lines == ["rec1", "rec2"]
    again = read_table(spark, str(tmp_path), "Daily Ops", columns).select("id", *columns)
    assert sorted(again.collect()) == sorted(df.select("id", *columns).filter("id IS NOT NULL").collect())
    assert read_table(spark, str(export), "Boats", ["Location"]).count() == 0


def test_load_full(spark, export, tmp_path):
    out, names = str(tmp_path / "landing"), str(tmp_path / "labels")
    report = load(spark, str(export), out, extracted_at=datetime(2026, 7, 1), labels_path=names)
    t = report.landing
    work = {r.work_id: r for r in t.work.collect()}
    assert set(work) == {"op_rec1", "op_rec2", "mv_m1"}
    assert work["op_rec1"].start_ts == datetime(2026, 6, 1, 10) and work["op_rec1"].status == "Planned"
    assert work["op_rec1"].customer_count == 12 and work["op_rec1"].source_system == "airtable"
    assert work["op_rec2"].start_ts == datetime(2026, 6, 2) and work["op_rec2"].end_ts is None
    assert (work["mv_m1"].work_type, work["mv_m1"].location_id) == ("t9", "lc_o1")
    kinds = {r.resource_id: (r.kind, r.name) for r in t.resources.collect()}
    assert kinds == {"gs_g1": ("person", "Ann, A"), "gs_g2": ("person", "Bob"), "vh_v1": ("Van", "One"),
                     "vh_v2": (None, "Two")}
    crew = {(r.work_id, r.resource_id, r.role): (r.source_id, r.end_ts) for r in t.assignments.collect()}
    assert crew == {
        ("op_rec1", "gs_g1", "Lead Guide (link)"): ("rec1", datetime(2026, 6, 1, 12)),
        ("op_rec1", "vh_v1", "Vehicle"): ("rec1", datetime(2026, 6, 1, 12)),
        ("op_rec1", "vh_v2", "Vehicle"): ("rec1", datetime(2026, 6, 1, 12)),
        ("op_rec2", "gs_g1", "Lead Guide (link)"): ("rec2", None),
        ("op_rec2", "gs_g2", "Lead Guide (link)"): ("rec2", None),
        ("mv_m1", "gs_g2", "Driver (link)"): ("m1", None)}
    assert {(r.from_id, r.to_id, r.minutes, r.is_estimate) for r in t.location_travel.collect()} == {
        ("lc_o1", "lc_o2", 35, True), ("lc_o1", "lc_o4", 10, False)}
    # The two "Late" lines say the same on the same day and become one change.
    log = {(r.entity_id, r.changed_by) for r in t.changes.collect()}
    assert t.changes.count() == 2 and log == {("op_rec2", "ann"), ("op_rec2", None)}
    assert {r.label for r in spark.read.parquet(names).collect()} == {"late v", "odd"}
    assert {r.landing_table: r.rows for r in report.counts.collect()}["assignments"] == 6
    assert ("Daily Ops", "Drivers (link)") in report.missing_columns
    assert ("Daily Ops", "Trip type") not in report.missing_columns
    assert ("Guides & Staff", "Location base") in report.empty_columns
    assert report.unlisted_override_columns == [] and repeated_keys(t).count() == 0


def test_load_lean(spark, export, tmp_path):
    report = load(spark, str(export), str(tmp_path / "landing"), "lean", extracted_at=datetime(2026, 7, 1))
    t = report.landing
    assert report.skipped_source_tables == ["Movements", "Rig Assignments"]
    assert t.changes.count() == t.location_travel.count() == 0
    assert {r.location_id for r in t.work.collect()} == {None} and t.work.count() == 2
    assert {r.kind for r in t.resources.collect()} == {"person", "vehicle"}


def test_load_refuses_empty_and_denied_exports(spark, tmp_path):
    folder = tmp_path / "export"
    folder.mkdir()
    with pytest.raises(EmptyExport):
        load(spark, str(folder), str(tmp_path / "out"))
    (folder / "Locations.csv").write_text("id,Name\n1,x\n")
    with pytest.raises(EmptyExport, match="no work rows"):
        load(spark, str(folder), str(tmp_path / "out"))
    (folder / "Capacity tiers.csv").write_text("id\n")
    with pytest.raises(DeniedSource):
        load(spark, str(folder), str(tmp_path / "out"))


def test_run_files(spark, export, tmp_path):
    report = load(spark, str(export), str(tmp_path / "landing"), extracted_at=datetime(2026, 7, 1))
    run = str(tmp_path / "run")
    from ruletrace.guards import Guards
    candidates.write_run(report.landing, report.profile, run, Guards(1, 1, 1, 1, 1), ["p03", "p04"])
    written = spark.read.json(f"{run}/candidates")
    assert {r.profile for r in written.collect()} == {"full"} and written.count() >= 3
    sheet = integrity.read_rows(spark, f"{run}/verdicts")
    assert sheet.columns == ["candidate_id", "key_id", "verdict", "note", "row_no"]
    assert [r.candidate_id for r in sheet.orderBy("row_no").collect()] == [
        r.candidate_id for r in written.orderBy("probe", "proposed_type", "candidate_id").collect()]


def test_blank_rows_and_digests(spark, tmp_path):
    rules = tmp_path / "key.csv"
    rules.write_bytes(b'\xef\xbb\xbfkey_id,type,notes\nK1,cap,"two\nlines"\n , ,\nK2,,\n')
    rows = integrity.read_rows(spark, str(rules)).orderBy("row_no").collect()
    assert [(r.key_id, r.notes) for r in rows] == [("K1", "two\nlines"), ("K2", None)]
    digest, noted = hashlib.sha256(rules.read_bytes()).hexdigest(), tmp_path / "hash.txt"
    state = lambda: integrity.frozen_state(spark, str(rules), str(noted)).first()
    assert tuple(state()) == (digest, "missing")
    noted.write_text(digest + "\n")
    assert state().state == "unchanged"
    noted.write_text("0" * 64)
    assert state().state == "changed"


def test_manifest_takes_the_latest_entry(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "p").mkdir(parents=True)
    (folder / "p" / "a.csv").write_text("a")
    (folder / "p" / "b.csv").write_text("b")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    manifest = tmp_path / "sums.txt"
    manifest.write_text(f"{sha('old')}  p/a.csv\n{sha('x')}  p/b.csv\n{sha('c')}  p/c.csv\n# remark\n{sha('a')}  p/a.csv\n")
    got = {r.path: r.state for r in integrity.manifest_state(spark, str(manifest), str(folder)).collect()}
    assert got == {"p/a.csv": "unchanged", "p/b.csv": "changed", "p/c.csv": "missing"}


def one_table(tmp_path, name, text):
    folder = tmp_path / "bad"
    folder.mkdir()
    (folder / name).write_text(text)
    return str(folder)


def test_a_record_that_is_cut_off_stops_the_load(spark, tmp_path):
    folder = one_table(tmp_path, "Locations.json", '{"id":"a","Name":"one"}\n{"id":"b","Name":"tw')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, folder, "Locations", ["Name"]).collect()


def test_csv_parts_are_not_read_by_position(spark, tmp_path):
    parts = tmp_path / "Locations.csv"
    parts.mkdir()
    (parts / "part-0.csv").write_text("id,Name,Town\n1,n,t\n")
    (parts / "part-1.csv").write_text("id,Town,Name\n2,t,n\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, str(tmp_path), "Locations", ["Name", "Town"]).collect()


def test_repeated_ids_are_refused_before_anything_is_written(spark, tmp_path):
    folder = one_table(tmp_path, "Daily Ops.csv", "id,Status\nrec1,a\nrec1,b\nrec2,c\n")
    with pytest.raises(RepeatedKeys, match="op_rec1 .2 rows"):
        load(spark, folder, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_labels_lie_nowhere_but_at_their_path(spark, export, tmp_path):
    out, staging, apart = tmp_path / "out", tmp_path / "staging", tmp_path / "apart"
    load(spark, str(export), str(out), labels_path=str(apart), staging=str(staging))
    (name,) = loads(spark, str(out))
    assert {p.name for p in out.iterdir() if not p.name.startswith(".")} == {name, "current.json"}
    out = out / name
    assert sorted(p.name for p in out.iterdir()) == sorted(TABLES)
    labels = {r.label for r in spark.read.parquet(str(apart)).collect()}
    assert labels
    for folder in (out, staging):
        for table in folder.iterdir():
            for row in spark.read.parquet(str(table)).collect():
                assert not any(isinstance(v, str) and any(x in v for x in labels) for v in row)


def test_a_map_is_read_through_spark(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"work": [{"table": "T"}], "note": "x"}')
    assert load_map(f"file://{tmp_path}/map.json") == {"work": [{"table": "T"}]}


def test_files_of_one_name_are_told_apart_by_folder(spark, tmp_path):
    for where in ("p", "q"):
        (tmp_path / "data" / where).mkdir(parents=True)
        (tmp_path / "data" / where / "x.csv").write_text(where)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    (tmp_path / "manifest").write_text(f"{sha('p')}  p/x.csv\n{sha('p')}  q/x.csv\n{sha('p')}  x.csv\n")
    got = {r.path: r.state for r in manifest_state(spark, str(tmp_path / "manifest"), str(tmp_path / "data")).collect()}
    assert got == {"p/x.csv": "unchanged", "q/x.csv": "changed", "x.csv": "missing"}


class Broken(Exception):
    pass


def test_a_load_that_fails_leaves_the_one_before(spark, export, tmp_path):
    out = str(tmp_path / "landing")
    load(spark, str(export), out, extracted_at=datetime(2026, 7, 1))
    before = {t: sorted(map(repr, df.collect())) for t, df in read_landing(spark, out).tables().items()}
    seen = []

    def broken():
        seen.append(True)
        raise Broken

    # The fourth table cannot be made.
    with pytest.raises(Broken):
        write_landing(thin(read_landing(spark, out), PROFILES["lean"]).replaced(locations=broken), out)
    assert seen and {t: sorted(map(repr, df.collect())) for t, df in read_landing(spark, out).tables().items()} == before
    assert len(loads(spark, out)) == 1 and len(list(Path(out).glob("load-*"))) == 1


def test_loads_are_published_as_one_and_few_are_kept(spark, export, tmp_path):
    out = str(tmp_path / "landing")
    first = load(spark, str(export), out, extracted_at=datetime(2026, 7, 1)).landing
    load(spark, str(export), out, "lean", extracted_at=datetime(2026, 7, 1))
    assert first.changes.count() == 2 and read_landing(spark, out).changes.count() == 0
    load(spark, str(export), out, "lean", extracted_at=datetime(2026, 7, 1))
    assert len(loads(spark, out)) == 2 and len(list(Path(out).glob("load-*"))) == 2


def test_digests_of_files_of_many_lines(spark, tmp_path):
    """Files read in several splits, with and without a last line break, a mark, line breaks of two bytes, or any line."""
    folder = tmp_path / "files"
    folder.mkdir()
    line = b"x" * 70 + b"\r\n"
    contents = {"long.csv": line * 40_000 + b"end", "mark.csv": b"\xef\xbb\xbfa\n\nb\n", "two marks": b"\xef\xbb\xbf\xef\xbb\xbf",
                "none": b"", "blank": b"\n", "odd %20 name": b"\xff\x00\n\xfe", "bare": b"\xef\xbb\xbf"}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = {r["path"].rpartition("/")[2]: r["digest"] for r in integrity.file_digests(spark, str(folder)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: hashlib.sha256(data).hexdigest() for name, data in contents.items()}


def test_two_runs_write_the_same_bytes(spark, tmp_path):
    rows = spark.range(1000, numPartitions=7).selectExpr("id % 10 AS a", "id AS b", "repeat('é', int(id % 9)) AS c")
    for run, parts in (("one", 7), ("two", 3)):
        write_ordered(rows.repartition(parts), [F.col("a"), F.col("b")], str(tmp_path / run), 300)
    one, two = ({p.name: p.read_bytes() for p in (tmp_path / r).iterdir() if not p.name.startswith(".")} for r in ("one", "two"))
    assert one == two and sorted(one) == ["_SHA256SUMS", *[f"part-0000{i}.json" for i in range(4)]]
    assert one["_SHA256SUMS"].decode().split()[::2] == [hashlib.sha256(one[f"part-0000{i}.json"]).hexdigest() for i in range(4)]
    assert [r["b"] for r in spark.read.json(str(tmp_path / "one" / "part-00000.json")).collect()][:3] == [0, 10, 20]
    write_ordered(rows.limit(0), [F.col("a")], str(tmp_path / "one"), 300)
    assert (tmp_path / "one" / "part-00000.json").read_bytes() == b""


TRICKY = [{"id": f"rec{i}", "Name": 'a "quoted" } { [ ] \\ text' + "\\" * (i % 3), "n": i, "none": None, "Ünï": "é}" * (i % 5),
           "nested": {"deep": [{"x": [{}, []]}, "}"], "records": [{"id": "not one"}]}, "blank": {}} for i in range(60)]


LAYOUTS = [json.dumps(TRICKY), json.dumps(TRICKY, indent=1), "\ufeff" + json.dumps(TRICKY, ensure_ascii=False) + "\n",
           json.dumps({"records": TRICKY}), json.dumps({"meta": [{"id": "m", "records": [{}]}], "records": TRICKY, "offset": {"a": [1, {}]}}, indent=2),
           "\n".join(json.dumps(r, indent=1) for r in TRICKY), json.dumps({"records": []}), "[]", json.dumps(TRICKY[:1])[1:-1]]


@pytest.mark.parametrize("text,split", [*[(t, "1k") for t in LAYOUTS], (LAYOUTS[0], "128m"), (LAYOUTS[4], "128m")])
def test_records_are_cut_by_byte_ranges(spark, tmp_path, text, split):
    """Lists in any layout, with braces and quotes inside of texts, in one split and in many."""
    (tmp_path / "T.json").write_text(text, encoding="utf-8")
    try:
        want = json.loads(text.lstrip("\ufeff"))
        want = want if isinstance(want, list) else want.get("records", [want])
    except json.JSONDecodeError:
        want = TRICKY
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = records(spark, str(tmp_path / "T.json"))
        parts = spark.read.option("lineSep", "}").text(str(tmp_path / "T.json")).rdd.getNumPartitions()
        assert sorted((json.loads(r[0]) for r in got.collect()), key=repr) == sorted(want, key=repr)
        assert parts > 5 or split == "128m" or len(text) < 2000
        rows = read_table(spark, str(tmp_path), "T", ["Name", "nested", "gone"], carried=True)
        assert sorted((r["id"], r["Name"]) for r in rows.collect()) == sorted((r["id"], r["Name"]) for r in want)
        assert carried_columns(rows) == ({*TRICKY[0]} if want else set())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", [json.dumps(TRICKY)[:-1], json.dumps(TRICKY)[:-30], json.dumps({"records": TRICKY})[:-2], '[{"id": "a'])
def test_a_list_that_is_cut_off_stops_the_load(spark, tmp_path, text):
    (tmp_path / "T.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, str(tmp_path), "T", ["Name"]).collect()


def test_repeated_keys_are_counted_by_hash_first(spark):
    work = [dict(work_id=w) for w in ("op_1", "op_2", "op_2", None, None)]
    found = repeated_keys(landing(spark, work=work, locations=[dict(location_id="op_1", name="x")]))
    assert sorted(map(tuple, found.collect()), key=str) == [("work", "op_2", 2), ("work", None, 2)]
    # Unique keys are never grouped by themselves.
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
