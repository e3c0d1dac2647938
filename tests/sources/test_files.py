import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources import files


def write(folder, **texts):
    folder.mkdir(parents=True, exist_ok=True)
    for name, body in texts.items():
        (folder / name.replace("__", ".")).write_text(body)
    return str(folder)


def test_front_matter(spark, tmp_path):
    head = '---\nid: {}\ntitle: {}\ntags: ["osc", "td"]\n---\n'
    d = write(tmp_path / "md", a__md=head.format("x", "OSC") + "Call 13812345678.\n", b__md=head.format("x", "B") + "b", c__md=head.format("y", "C") + "c", d__md="no head", e__md="---\nid: q\nid: r\n---\nt", f__md="---\nid: z\nodd: 1\n---\nt")
    rows = files.front_matter(spark, d, ["id", "title"], ["tags"], "id", redact=True).orderBy("path").collect()
    assert [r.error for r in rows] == ["REPEATED_ID", "REPEATED_ID", None, "NO_HEAD", "REPEATED_KEY", "UNKNOWN_KEY"]
    assert rows[0].tags == ["osc", "td"] and rows[0].content == "Call [已遮蔽手机号]." and rows[2].title == "C"


def test_json_line_faults(spark, tmp_path):
    d = write(tmp_path / "j", x__jsonl='{"id": 1, "name": "a"}\n\n{"id": 2\n{"id": "q", "name": "b"}\n{"id": 3, "name": "c", "more": 1}\n{"name": "d"}\n')
    schema = StructType.fromDDL("id long not null, name string")
    got = files.json_line_faults(spark, f"{d}/x.jsonl", schema).collect()
    assert [r.fault for r in got] == ["BLANK_LINE", "BAD_JSON", "SCHEMA_MISMATCH", "SCHEMA_MISMATCH", "SCHEMA_MISMATCH"]
    rows = files.json_lines(spark, f"{d}/x.jsonl", StructType.fromDDL("id long, name string")).collect()
    assert (rows[0].id, rows[0].name, rows[0]._corrupt_record) == (1, "a", None)
    assert [r._corrupt_record is not None for r in rows if r.name in (None, "b")].count(True) >= 2


def test_publish_and_sealed_index(spark, tmp_path):
    rows = spark.range(50).withColumn("t", F.concat(F.lit("v"), "id"))
    path = str(tmp_path / "index")
    digest = files.publish(rows, path)
    got = files.sealed_index(spark, path)
    assert got.count() == 50 and files.content_digest(got.repartition(7), ["id", "t"]) == digest and files.sealed_rows(got, digest, ["id", "t"])
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]
    with pytest.raises(FileExistsError):
        files.publish(rows, path)
    rows.limit(1).write.mode("append").parquet(f"{path}/rows")
    assert files.sealed_index(spark, path) is None
    assert files.sealed_index(spark, str(tmp_path / "none")) is None


def test_bundle(spark, tmp_path):
    lines = "\n".join(json.dumps({"table": t, "row": {"id": i, "name": f"n{i}"}}) for i, t in enumerate(["a", "b", "a"]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = [{"name": "rows.jsonl", "sha256": sha(lines)}, {"name": "pic.txt", "sha256": sha("other")}, {"name": "gone.txt", "sha256": sha("")}]
    d = write(tmp_path / "b", rows__jsonl=lines, pic__txt="pixels", extra__txt="x", manifest__json=json.dumps({"files": listed}))
    faults = {(r.file, r.fault) for r in files.bundle_faults(spark, d).collect()}
    assert faults == {("pic.txt", "CHANGED"), ("gone.txt", "MISSING"), ("extra.txt", "UNLISTED"), ("DONE.json", "NOT_DONE")}
    got = files.bundle_table(spark, d, "a", StructType.fromDDL("id long, name string")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "n0"), (2, "n2")]


def test_project_folder(spark, tmp_path):
    top = write(tmp_path / "p" / "project1", source1__n="TOP:movie\ntile 1 2 3 4\n", source1__parm="?\nfile 0 C:\\clips\\night.mov\nplay 0 1\n", noise1__n='TOP:noise\ninputs\n{\n0 \t"source1"\n1 ../missing\n}\nend\n', noise1__parm="amp 0 1\ntranslate 17 absTime.seconds\n", note1__n="COMP:annotate\n")
    write(tmp_path / "p" / "local", x__n="DAT:text\n")
    write(tmp_path / "p", project1__n="ODD:base\n", perform__n="COMP:window\n", bad__n="no family")
    nodes = files.project_nodes(spark, str(tmp_path / "p"))
    got = {r.path: r for r in nodes.collect()}
    assert sorted(got) == ["project1", "project1/noise1", "project1/note1", "project1/source1"]
    assert got["project1"].family == "OTHER" and got["project1"].folder == "" and got["project1/noise1"].kind == "noise"
    assert [p.name for p in got["project1/noise1"].parameters] == ["translate", "amp"]
    assert got["project1/source1"].parameters[0].value == "[本地文件]/night.mov" and got["project1/source1"].n_parameters == 2
    assert [tuple(e) for e in files.project_edges(nodes).collect()] == [("project1/source1", "project1/noise1")]
    assert len({r.signature for r in got.values()}) == 4


def test_parameters_that_matter(spark, tmp_path):
    parm = "\n".join(f"{n} 17 {v}" for n, v in [("wide", "1"), ("Zeta", "2"), ("alpha", "3"), ("beta", "me.digits"), ("amp", "absTime.frame"), ("gain", "0.5"), ("ext1", "x"), ("pageindex", "op('a')"), ("tx", "1"), ("Alpha2", "4"), ("émile", "5"), ("height", "6"), ("file", "C:\\Jane Doe\\a b.mov")] + [(f"q{i}", "1") for i in range(9)])
    write(tmp_path / "p", n1__n="TOP:noise\n", n1__parm=parm + "\n")
    node = files.project_nodes(spark, str(tmp_path / "p")).first()
    # Expressions of telling names, expressions, telling names, all by the alphabet; noise is left out.
    assert [p.name for p in node.parameters] == ["amp", "beta", "file", "gain", "tx", "alpha", "Alpha2", "émile", "q0", "q1"]
    assert node.n_parameters == 22 and node.parameters[2].value == "[本地文件]/a b.mov"


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("case/one.toe", "12345")
        z.writestr("case/readme.txt", "x")
    (tmp_path / "bad.zip").write_text("no archive")
    got = files.archive_members(spark, str(tmp_path / "*.zip")).collect()
    assert {(r.archive.split("/")[-1], r.member, r.bytes) for r in got} == {("a.zip", "case/one.toe", 5), ("a.zip", "case/readme.txt", 1), ("bad.zip", None, None)}
    assert [r.member for r in files.archive_members(spark, str(tmp_path / "*.zip"), ".toe").collect()] == ["case/one.toe"]


def test_markdown_report(spark):
    rows = spark.createDataFrame([("b", 2, None), ("a|c", 1, 0.5)], "name string, n int, rate double")
    assert files.markdown_report(rows, "Class", ["n"]) == "# Class\n\n| name | n | rate |\n| --- | --- | --- |\n| a\\|c | 1 | 0.5 |\n| b | 2 | - |\n"
    with pytest.raises(ValueError):
        files.markdown_report(rows, "Class", ["n"], most=1)
