"""Commands end to end: exit codes and what they publish."""

from __future__ import annotations

import json

from lexweave import cli
from lexweave.sources import artifacts

SECTION = "chapter_id string, id string, kind string, citations array<string>, status string, body array<string>"


def test_import_search_validate(spark, tmp_path, capsys):
    sections = [{"section_key": f"1-{i}", "label": f"Sec. 1-{i}. Tax", "url": "u", "content": {"text": "A tax on boats"}} for i in range(3)]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "title_01.json").write_text(json.dumps({"title_key": "01", "name": "T", "chapters": [{"chapter_key": "1", "sections": sections}]}))
    assert cli.run(["import", "--input", str(tmp_path / "raw"), "--output", str(tmp_path / "out")], spark) == 0
    data = capsys.readouterr().out.strip()
    assert cli.run(["search", "--data", data, "--query", "boats"], spark) == 0 and "Sec. 1-2. Tax" in capsys.readouterr().out
    assert cli.run(["validate", "--data", data], spark) == 0
    assert cli.run(["import", "--input", str(tmp_path / "raw"), "--output", str(tmp_path / "raw")], spark) == 1


def test_validate_against_a_schema(spark, tmp_path, capsys):
    schema = tmp_path / "schema.json"
    schema.write_text(json.dumps({"type": "object", "required": ["id"]}))
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.json").write_text('{"id": 1}')
    args = ["validate", "--data", str(tmp_path / "data"), "--schema", str(schema)]
    assert cli.run(args, spark) == 0
    (tmp_path / "data" / "b.json").write_text("{}")
    assert cli.run(args, spark) == 1 and "missing required property id" in capsys.readouterr().out


def test_overlay_and_its_check(spark, tmp_path):
    base = spark.createDataFrame([("c", "a", "section", ["1-1"], "active", ["A"]), ("c", "b", "section", ["1-2"], "active", ["B"])], SECTION)
    edition = spark.createDataFrame([("c", "b2", "section", ["1-2"], "active", ["New"])], SECTION)
    paths = {n: str(tmp_path / n) for n in ("base", "edition", "out")}
    base.write.parquet(paths["base"])
    edition.write.parquet(paths["edition"])
    common = ["--base", paths["base"], "--edition", paths["edition"]]
    assert cli.run(["overlay", *common, "--output", paths["out"]], spark) == 0
    assert {r.id for r in artifacts.current(spark, paths["out"] + "/sections").collect()} == {"a", "b2"}
    assert cli.run(["check-edition", *common, "--published", paths["out"]], spark) == 0
    artifacts.publish(base, paths["out"] + "/sections")
    assert cli.run(["check-edition", *common, "--published", paths["out"]], spark) == 1


def test_secondary_changes(spark, tmp_path, capsys):
    rows = lambda x: spark.createDataFrame(x, "kind string, id string, content string, resolution string")
    rows([("fee", "1", "a", "r"), ("fee", "2", "a", "r")]).write.parquet(str(tmp_path / "before"))
    rows([("fee", "1", "b", "r"), ("fee", "2", "a", "s"), ("index", "1", "a", "r")]).write.parquet(str(tmp_path / "after"))
    assert cli.run(["diff-secondary", "--before", str(tmp_path / "before"), "--after", str(tmp_path / "after")], spark) == 0
    out = capsys.readouterr().out
    assert all(x in out for x in ("| fee | changed | 1 |", "| fee | resolution | 1 |", "| index | added | 1 |", "| added | index:1 |"))
