"""A solution on disk, read into fact tables, and results written out."""

import json

from factgraph import sinks
from factgraph.sources import solution


def test_solution(spark, tmp_path, monkeypatch):
    files = {
        "All.sln": 'Project("{FAE}") = "App Name", "src\\App\\App.csproj", "{1}"\nProject("{FAE}") = "Lib", "src\\Lib\\Lib.csproj", "{2}"\n',
        "src/App/App.csproj": '<Project><ItemGroup><ProjectReference Include="..\\Lib\\Lib.csproj" /><PackageReference Include="P" Version="2" /></ItemGroup></Project>',
        "src/Lib/Lib.csproj": "﻿<Project/>", "other/Other.csproj": "<Project/>",
        "src/App/A.cs": "class A {}", "src/App/obj/B.g.cs": "class B {}", "src/AppX/C.cs": "class C {}", "src/Lib/Deep/D.cs": "class D {}",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    monkeypatch.setenv(solution.VARIABLE, str(tmp_path))
    found = solution.from_environment(spark)
    assert {(r["project"], r["in_solution"]) for r in found["projects"].collect()} == {("App Name", True), ("Lib", True), ("Other", False)}
    assert [tuple(r) for r in found["project_references"].collect()] == [("App Name", "Lib")]
    assert {(r["project"], r["package"], r["version"]) for r in found["packages"].collect()} == {("App Name", "P", "2"), ("Lib", None, None), ("Other", None, None)}
    documents = found["documents"]
    assert {(r["name"], r["project"], r["is_generated"]) for r in documents.collect()} == {("A.cs", "App Name", False), ("B.g.cs", "App Name", True), ("C.cs", None, False), ("D.cs", "Lib", False)}
    asked = spark.createDataFrame([(f"{tmp_path}\\src\\App\\A.cs",), (f"{tmp_path}/no.cs",)], "path string")
    assert sorted(((r["name"], r["text"]) for r in solution.at_paths(documents, asked).collect()), key=str) == [("A.cs", "class A {}"), (None, None)]
    out = documents.select(solution.relative(documents["path"], str(tmp_path)).alias("path"), "text")
    assert {r["path"]: r["n_bytes"] for r in sinks.write_texts(out, f"{tmp_path}/out").collect()}["src/App/A.cs"] == 10
    assert (tmp_path / "out/src/Lib/Deep/D.cs").read_text() == "class D {}"
    monkeypatch.delenv(solution.VARIABLE)
    assert solution.from_environment(spark) is None


def test_json(spark):
    frame = spark.createDataFrame([(1, None, [1])], "symbol_id int, first_name string, a_b_c array<int>")
    assert json.loads(sinks.json_lines(frame).first()[0]) == {"symbolId": 1, "firstName": None, "aBC": [1]}
    assert json.loads(sinks.json_lines(frame, nulls=False).first()[0]) == {"symbolId": 1, "aBC": [1]}
