"""Import statements of each language, and what they resolve to."""

import pytest

from plumbline.functions.languages import Adapter, candidates, fold, parse
from plumbline.operators import imports

from .conftest import DATA

CASES = [
    ("kt", "package a\n\nimport a.b.C\nimport d.e.*\nimport f.G as H\n// import no.X\n", [("a.b.C", 3), ("d.e", 4), ("f.G", 5)]),
    ("java", "import a.b.C;\nimport static d.E.f;\n/* import x.Y; */\nimport g.*;", [("a.b.C", 1), ("d.E.f", 2), ("g", 4)]),
    ("cs", "using System.Text;\nusing static A.B;\n", [("System.Text", 1), ("A.B", 2)]),
    ("dart", "import 'dart:io';\nimport 'package:x/y.dart';\nexport \"z.dart\";", [("package:x/y.dart", 2), ("z.dart", 3)]),
    ("go", 'package m\nimport "fmt"\nimport (\n\t"a/b"\n\tx "c/d"\n)\n', [("fmt", 2), ("a/b", 4), ("c/d", 5)]),
    ("hs", "module M where\nimport qualified Data.Map as M\nimport A.B (c)\n-- import X\n", [("Data.Map", 2), ("A.B", 3)]),
    ("js", "import a from './a';\nimport './b';\nconst c = require('c');\nimport {\n d\n} from '../d';", [("./a", 1), ("./b", 2), ("../d", 4)]),
    ("ts", "import type { A } from \"./a\";\nexport { b } from './b';", [("./a", 1)]),
    ("py", "import os, a.b\nfrom .c import d\nfrom x.y import z\nimport q as r\n# import no\n", [("os", 1), ("a.b", 1), (".c", 2), ("x.y", 3)]),
    ("rs", "use crate::a::b;\nuse super::{c, d::e, self};\nuse std::io::*;\n", [("crate::a::b", 1), ("super::c", 2), ("super::d::e", 2), ("super", 2), ("std::io::*", 3)]),
    ("swift", "import Foundation\n@testable import Core\n", [("Foundation", 1), ("Core", 2)]),
    ("zig", 'const s = @import("std");\nconst a = @import("../a.zig");', [("std", 1), ("../a.zig", 2)]),
    ("php", "<?php\nuse A\\B;\nuse C\\{D, E};\nrequire_once 'f/g.php';", [("A\\B", 2), ("C\\D", 3), ("C\\E", 3), ("f/g.php", 4)]),
    ("rb", "require 'a/b'\nrequire_relative \"c\"\nload 'd.rb'\n", [("a/b", 1), ("c", 2), ("d.rb", 3)]),
    ("ex", "alias My.App.{User, Post}\nuse GenServer\nimport Foo.Bar, only: [x: 1]\n", [("My.App.User", 1), ("My.App.Post", 1), ("GenServer", 2), ("Foo.Bar", 3)]),
    ("scala", "import a.b.{C, D}\nimport e._\n", [("a.b.{C, D}", 1), ("e._", 2)]),
    ("txt", "import a", []),
]


@pytest.mark.parametrize(("extension", "source", "expected"), CASES, ids=[c[0] for c in CASES])
def test_parse(extension, source, expected):
    assert parse(extension, source) == expected


def test_fold():
    assert fold("a/./b/../c") == "a/c" and fold("../x") == "x"


@pytest.mark.parametrize(
    ("extension", "name", "source", "first"),
    [
        ("py", "..b.c", "p/q/r/m.py", ("exact", "p/q/b/c.py")),
        ("py", ".", "p/q/m.py", ("exact", "p/q/__init__.py")),
        ("rs", "crate::a::b", "x/src/m/n.rs", ("exact", "x/src/a/b.rs")),
        ("rs", "super::a", "src/m/n.rs", ("exact", "src/m/a.rs")),
        ("rs", "super::a", "src/m/mod.rs", ("exact", "src/a.rs")),
        ("ts", "../a", "p/q/m.ts", ("exact", "p/a.ts")),
        ("ex", "MyApp.UserPost", "m.ex", ("suffix", "my_app/user_post.ex")),
        ("scala", "a.b.{C, D}", "m.scala", ("suffix", "a/b.scala")),
        ("zig", "../a.zig", "p/q/m.zig", ("exact", "p/a.zig")),
        ("dart", "package:x/y.dart", "lib/m.dart", ("suffix", "lib/y.dart")),
    ],
)
def test_first_candidate(extension, name, source, first):
    assert candidates(extension, name, source)[0] == first


def test_scan(spark):
    files = {
        "src/a/A.kt": "import b.B\nimport x.Missing\n// plumbline:ignore\nimport c.C\n",
        "src/b/B.kt": "import C\n",
        "src/c/C.kt": "",
        "lib/c/C.kt": None,
        "go/pkg/util/u.go": "",
        "go/m.go": 'import "pkg/util"\n',
        "w/MyFoo.swift": "",
        "w/z.swift": "import Foo\n",
    }
    sources = spark.createDataFrame(list(files.items()), "path string, text string")
    deps, external, suppressed = imports.scan(sources)
    assert {(r.from_path, r.to_path, r.line_number) for r in deps.collect()} == {
        ("src/a/A.kt", "src/b/B.kt", 1),
        ("src/b/B.kt", "lib/c/C.kt", 1),  # the first in order of paths
        ("go/m.go", "go/pkg/util/u.go", 1),
        ("w/z.swift", "w/MyFoo.swift", 1),  # suffixes are compared by characters
    }
    assert {(r.path, r["count"]) for r in external.collect()} == {("src/a/A.kt", 1)}
    assert {(r.path, r["count"]) for r in suppressed.collect()} == {("src/a/A.kt", 1)}


def test_scan_parses_each_text_once(spark, tmp_path):
    def parse(text):
        with (tmp_path / "seen").open("a") as f:
            f.write(f"{text}\n")
        return [(x, 1) for x in text.split(" ")]

    own = Adapter(("x",), parse, lambda name, path: [("exact", name)] if name != "z:1\0" else [("suffix", name), ("suffix", "a.x")])
    sources = spark.createDataFrame([("a.x", "b.x b.x z:1\0 none"), ("b.x", "a.x")], "path string, text string")
    deps, external, suppressed = imports.scan(sources, adapters=[own])
    assert sorted(map(tuple, deps.collect())) == [("a.x", "a.x", 1), ("a.x", "b.x", 1), ("b.x", "a.x", 1)]
    assert [tuple(r) for r in external.collect()] == [("a.x", 1)] and suppressed.count() == 0
    assert sorted((tmp_path / "seen").read_text().splitlines()) == ["a.x", "b.x b.x z:1\0 none"]


def test_no_join_of_names_is_broadcast(spark):
    known = spark.createDataFrame([("p/q/a.py",), ("m.swift",), ("x/y/z.go",)], "path string")
    tries = [[("suffix", "q/a.py")], [("suffix", "p/q/a.py")], [("suffix", ".swift")], [("exact", "m.swift")], [("within", "y")], [("within", "x")]]
    asked = spark.createDataFrame([("f", str(n), n, t) for n, t in enumerate(tries)], imports._IMPORTS)
    found = imports.resolve(asked, known)
    assert {r.line_number: r.to_path for r in found.collect()} == {0: "p/q/a.py", 1: "p/q/a.py", 2: "m.swift", 3: "m.swift", 4: "x/y/z.go", 5: None}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # tails are far larger than what Spark judges them by


def test_what_is_nowhere_is_not_joined(spark, monkeypatch):
    asked = []
    first_fits = imports.first_fits
    monkeypatch.setattr(imports, "first_fits", lambda tried, *a: asked.extend(r.text for r in tried.collect()) or first_fits(tried, *a))
    files = {f"src/b{n % 7}/t{n % 5}/p{n}.rb": f"require 'src/b{(n + 1) % 7}/t{(n + 1) % 5}/p{n + 1}'\nrequire 'json'\nrequire '../t{n % 5}/p{n}'" for n in range(35)}
    files |= {"a/x/b/c.php": "use y\\b\\c;\nrequire_once 'x/b/c.php';\nuse c;\nuse absent\\b\\c;", "d.php": "use a\\x\\b\\c;\nrequire 'x/b/c.php';\nrequire 'é/c.php';", "é/c.php": "require '/b/c.php';", "r/b/l.rb": "require 'b/l'\nrequire 'l'", "r/l.rb": "require 'l'"}
    sources = spark.createDataFrame(list(files.items()), "path string, text string")
    deps, external, _ = imports.scan(sources)
    n_asked = len(asked)
    expected = imports.resolve(imports.extract(sources), sources.select("path")).collect()  # tries every candidate
    assert {tuple(r) for r in deps.collect()} == {(r.path, r.to_path, r.line_number) for r in expected if r.to_path}
    assert sum(r["count"] for r in external.collect()) == sum(r.to_path is None for r in expected)
    assert n_asked < (len(asked) - n_asked) / 3


def test_checksums_never_miss(spark):
    paths = ["a/b/c/d.x", "/r/s/t.x", "u.x", "v/w.x", "", "é/ü/ß.x", "a//b.x"]
    checksums = imports.name_checksums(spark.createDataFrame([(p,) for p in [*paths, None]], "path string"))
    assert all(imports.may_fit("exact", p, checksums) for p in paths)
    assert all(imports.may_fit("suffix", p[i:], checksums) for p in paths for i in range(len(p)))
    assert not imports.may_fit("exact", "b/c/d.x", checksums) and not imports.may_fit("suffix", "z/a/b/c/d.x", checksums)
    nothing = imports.name_checksums(spark.createDataFrame([], "path string"))
    assert not imports.may_fit("exact", "a", nothing) and imports.may_fit("suffix", "b/a", nothing)


def test_checksums_are_held_once(spark):
    import tracemalloc

    known = spark.range(100_000).selectExpr("concat('src/b', id % 91, '/t', id % 97, '/p', id, '.x') as path").cache()
    known.count()
    tracemalloc.start()
    checksums = imports.name_checksums(known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(checksums) == 2**21 and peak < 1.5 * len(checksums)
    assert all(imports.may_fit("exact", r.path, checksums) and imports.may_fit("suffix", r.path[3:], checksums) for r in known.sample(0.01, 1).collect())
    known.unpersist()


def test_scan_leaves_no_checksums(spark, monkeypatch):
    from pathlib import Path

    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    deps, _, _ = imports.scan(spark.createDataFrame([("b.zig", ""), ("a.zig", '@import("b.zig")')], "path string, text string"))
    assert [tuple(r) for r in deps.collect()] == [("a.zig", "b.zig", 1)]
    assert len(sent) == 1 and not Path(sent[0]._path).exists()


def test_stored_keeps_no_shuffle_files(spark):
    from plumbline.plans.runtime import stored

    kept = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before, name = kept.size(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(name, None)
    table = stored(spark.range(100).groupBy("id").count())
    assert kept.size() <= before and table.count() == 100 and spark.conf.get(name, None) == set_before


def test_texts_broadcast_no_names(spark):
    from plumbline.sources.rendered import source_texts

    texts = source_texts(spark, str(DATA / "sf0.001"), "ruby")
    assert "Broadcast" not in texts._jdf.queryExecution().executedPlan().toString()


def test_source_tree(spark, tmp_path):
    from plumbline.sources import files

    for name, data in {"src/a.kt": b"import b.C", "src/my file+1.kt": b"x", "build/b.kt": b"", "c.txt": b"", "bad.kt": b"\xff\xfe", "empty.kt": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {r.path: (r.text, r.depth) for r in files.source_tree(spark, str(tmp_path)).collect()}
    assert found == {"src/a.kt": ("import b.C", 2), "src/my file+1.kt": ("x", 2), "bad.kt": (None, 1), "empty.kt": ("", 1)}
