"""The scanner against its fixtures, and against SQL on the tables."""

import json
import os
import random
import subprocess
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gritsieve import cli
from gritsieve.functions import linear, text
from gritsieve.functions.dialect import PatternError, java_pattern
from gritsieve.operators import matching, policy, summary
from gritsieve.plans import fixtures, hooks, install, queries, report
from gritsieve.plans.scan import ScanOptions, run_scan
from gritsieve.sources import config, globs, listing
from gritsieve.streaming.findings import stream_findings, write_stream

SF = "/root/testdata/sf0.001"
NAMES = [d.name for d in config.built_in()]


def found(spark, content, detectors=None):
    docs = spark.createDataFrame([("p", content)], "path string, content string")
    rows = matching.ordered(matching.find(docs, detectors or config.built_in())).collect()
    return [(r.line_number, r.plugin_name.removesuffix("Detector"), r.matched_content) for r in rows]


def test_every_detector_finds_and_just_misses(spark):
    rows = matching.find(spark.createDataFrame(fixtures.detector_corpus(), "path string, content string"), config.built_in()).collect()
    assert len(rows) == 78
    for i, name in enumerate(NAMES):
        by = {r.file_path for r in rows if r.plugin_name == name}
        assert f"{i:02d}/found.txt" in by and f"{i:02d}/missed.txt" not in by


@pytest.mark.parametrize("name", [n for n in queries.queries() if n in queries.oracle_sql()])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = connection.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def sql_findings(texts):
    """Findings of some (path, content) by the queries' SQL."""
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    table = pa.table({"path": [p for p, _ in texts], "content": [t for _, t in texts]})
    connection.register("given", table)
    return connection.execute(f"WITH {queries.findings_sql('SELECT path, content FROM given')} SELECT {', '.join(matching.COLUMNS)} FROM findings").fetchall()


#: Words of over 20 letters, numbers and addresses beside letters, digits and blanks beyond ASCII, as texts have them.
BEYOND_ASCII = ["der erungtztzeinlichkeit\u00fc", "\u00f1ci\u00f3nmentellosmentequemente porci\u00f3n\nx", "schachtzheitenachlich\u00e4 einbereinheitheitber", "\u00e9123-45-6789", "\u0661\u0662\u0663-45-6789", "to\u212aen=aaaaaaaaaa", "pwd\u00a0: x", "pwd \x0b: x", "cred\u0131\u0131tial credent\u0131al=aaaaaaaaaa", "pa\u017fsword: x", "\u00e9a@b.co\u00e9 a@b.co", "my\u017fql://u@h\u00a0x", "red\u0131s://u@h", "GHP_" + "a" * 35 + "\u017f"]


@pytest.mark.parametrize("name", ["findings_by_document", "scan_documents", "scan_pages", "findings_by_detector", "findings_ordered", "scan_conversations", "severity_counts"])
def test_queries_equal_sql_beyond_ascii(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    n = list(range(len(BEYOND_ASCII)))
    tables = {"documents": {"doc_id": n, "text": BEYOND_ASCII}, "pages": {"page_id": n, "html": BEYOND_ASCII}, "conversations": {"conv_id": n, "turn": n, "text": BEYOND_ASCII}}
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = connection.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in entry.queries()[name](spark, str(tmp_path)).collect()))) == sorted(map(str, want.fetchall()))


def test_ascii_reading_equals_sql_on_random_texts(spark):
    """With all its pretests and linear forms."""
    texts = [(str(i), t) for i, t in enumerate([*BEYOND_ASCII, *random_texts()])]
    docs = spark.createDataFrame(texts, "path string, content string").repartition(4)
    got = [tuple(r) for r in matching.find(docs, config.built_in(ascii=True)).select(*matching.COLUMNS).collect()]
    assert sorted(map(str, got)) == sorted(map(str, sql_findings(texts)))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_lines(spark):
    cases = {"": [], "\n": [""], "a": ["a"], "a\n": ["a"], "a\n\n": ["a", ""], "a\r\nb\rc\r": ["a", "b\rc\r"], "a\r\r\nb": ["a\r", "b"]}
    df = spark.createDataFrame([(k,) for k in cases], "content string")
    for r in df.select("content", text.lines_of(F.col("content")).alias("lines"), text.line_count(F.col("content")).alias("n")).collect():
        assert r.lines == cases[r.content] and r.n == len(r.lines)


def test_line_of_a_whole_file_match(spark):
    block = fixtures.line_corpus()[-1][1]
    assert [f[0] for f in found(spark, "\U0001f511\nplain\n" + block) if f[1] == "PrivateKey"] == [3]
    assert [f[0] for f in found(spark, block) if f[1] == "PrivateKey"] == [1]


def test_order_and_overlap(spark):
    block = fixtures.line_corpus()[-1][1]
    assert [f[:2] for f in found(spark, "password = 'user@example.com'\n" + block)] == [(2, "PrivateKey"), (1, "Password"), (1, "Email"), (2, "SSHPrivateKey")]


def test_unicode(spark):
    assert not found(spark, "é123-45-6789")
    assert [f[1] for f in found(spark, "١٢٣-45-6789")] == ["SSN"]
    assert [f[1] for f in found(spark, "toKen=aaaaaaaaaa")] == ["GenericKeyValue"]
    assert [f[2] for f in found(spark, "pwd : x")] == ["pwd : x"]


def test_empty_matches_and_custom_detectors(spark):
    custom = config.parse('[[detectors]]\nname="A"\npattern="^$"\nfinding_type="t"\nseverity="odd"\ndescription="ignored"\n')
    assert custom[0].severity == "LOW" and custom[0].anchored
    assert found(spark, "x\n\ny", custom) == [(2, "A", "")]
    whole = config.parse('[[detectors]]\nname="B"\npattern="(?s)a.b"\nfinding_type="t"\nseverity="high"\n[[detectors]]\nname="C"\npattern="(?is)A.B"\nfinding_type="t"\nseverity="high"\n')
    assert found(spark, "x\na\nb", whole) == [(2, "B", "a\nb")]


def test_dialect():
    assert java_pattern("a$") == r"(?Ud)a\z" and java_pattern("(?m)a$").endswith("a$")
    assert java_pattern(r"(?P<x>a)\u{1F600}[0-9-_]\v") == r"(?Ud)(a)\x{1F600}[0-9\-_]\x0B"
    assert java_pattern("[[:digit:]x]") == "(?Ud)[[0-9]x]"
    for bad in (r"(a)\1", "a(?=b)", "(?U)a+", "(?-u)a", "[a--b]", "a++", r"\Qa\E", "[a"):
        with pytest.raises(PatternError):
            java_pattern(bad)


def test_ascii_dialect():
    assert java_pattern(r"(?i)k(?-i)k[\s\S]", ascii=True) == r"(?d)(?i)[k\x{212A}](?-i)k[\t\n\f\r \S\x0B]"
    assert java_pattern(r"((?i)[^j-l])s\s", ascii=True) == r"(?d)((?i)[^\x{212A}j-l])s[\t\n\f\r ]"
    for bad in ("(?i)é", "(?i)[[:alpha:]]", r"\b{start}"):
        with pytest.raises(PatternError):
            java_pattern(bad, ascii=True)


def test_every_built_in_pattern_compiles(spark):
    config.compile_check(spark, config.load())


def test_config_errors(spark, tmp_path, monkeypatch):
    with pytest.raises(config.ConfigError, match="Failed to read"):
        config.load(tmp_path / "none.toml")
    (tmp_path / "a.toml").write_text("[[detectors]\n")
    (tmp_path / "b.toml").write_text('[[detectors]]\nname="A"\n')
    (tmp_path / "c.toml").write_text('[[detectors]]\nname="A"\npattern="(a"\nfinding_type="t"\nseverity="LOW"\n')
    for name in "ab":
        with pytest.raises(config.ConfigError, match="Failed to parse"):
            config.load(tmp_path / f"{name}.toml")
    with pytest.raises(config.ConfigError, match="Invalid detector pattern"):
        config.compile_check(spark, config.load(tmp_path / "c.toml"))
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv(config.VARIABLE, str(tmp_path / "none.toml"))
    assert len(config.load()) == 43
    monkeypatch.setenv(config.VARIABLE, str(tmp_path / "c.toml"))
    assert [d.name for d in config.load()] == ["A"]


@pytest.mark.parametrize(
    "glob, text, matches",
    [("*.log", "a/b.log", True), ("*.log", "a.log.x", False), ("target", "target/x", False), ("target/*", "target/a/b", True), ("?", "é", True), ("[!a-c]x", "dx", True), ("[!a-c]x", "bx", False), ("[]]", "]", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("**/b", "b", True), ("**/b", "xb", False), ("a/**", "a/b/c", True), ("a.b", "axb", False), ("{a,b}", "a", False), ("A", "a", False)],
)
def test_globs(spark, glob, text, matches):
    expression = globs.glob_regex(glob)
    assert bool(globs.python_regex(expression).match(text)) is matches
    assert spark.range(1).select(F.lit(text).rlike(expression)).first()[0] is matches


def test_bad_globs():
    assert globs.parse_excludes("") == globs.parse_excludes(" , ") == globs.parse_excludes(None) == []
    for bad in ("a**", "***", "[a"):
        with pytest.raises(globs.GlobError, match="Invalid exclude pattern"):
            globs.parse_excludes(f"x, {bad}")


def tree(root, files):
    for name, content in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def scan(spark, *paths, **options):
    result = run_scan(spark, ScanOptions(paths, **options))
    return {os.path.basename(f.file_path) for f in result.findings}, result.files_scanned, result.total_lines, [os.path.basename(p) for p in result.excluded_files]


def test_folder(spark, tmp_path):
    root = tree(tmp_path, {"a.txt": "pwd=1\n", "_b.txt": "x\ny", ".env": "pwd=2", ".github/c.txt": "pwd=3", ".git/d.txt": "pwd=4", "e.log": "pwd=5", "f.bin": b"pwd=6\0", "g.txt": b"\xffpwd=7", "empty": "", "w/.git": "pwd=8"})
    assert scan(spark, root, exclude="*.log") == ({"a.txt", ".env", "c.txt"}, 5, 5, ["e.log", ".git"])


def test_named_paths(spark, tmp_path):
    root = tree(tmp_path, {"r/sub/a.txt": "pwd=1", ".git/config": "pwd=2"})
    a = f"{root}/r/sub/a.txt"
    assert scan(spark, a, a, f"{root}/r")[1] == 1
    assert scan(spark, f"{root}/none")[1:] == (0, 0, [])
    assert scan(spark, f"{root}/none.log", exclude="*.log")[1:] == (0, 0, ["none.log"])
    assert scan(spark, f"{root}/.git/config")[3] == ["config"]
    assert scan(spark, f"{root}/r/sub", f"{root}/r", exclude="sub/a.txt") == (set(), 0, 0, ["a.txt"])


def test_links_in_a_loop(spark, tmp_path):
    root = tree(tmp_path, {"d/a.txt": "pwd=1"})
    os.symlink(f"{root}/d", f"{root}/d/loop")
    assert [p for p, _ in listing.walk(root, root)] == [f"{root}/d/a.txt"]


def test_totals_of_nothing(spark):
    none = matching.find(spark.createDataFrame([], "path string, content string"), config.built_in())
    assert tuple(summary.severity_counts(none).first()) == (0, 0, 0, 0)
    assert summary.status(none).first()[0] == "PASS"
    assert {r.exit_code for r in summary.exit_codes(none).collect()} == {0}
    assert tuple(summary.scanned(spark.createDataFrame([], "path string, content string")).first()) == (0, 0)


@pytest.mark.parametrize("high, findings, codes", [(0, 0, (0, 0, 0)), (0, 2, (0, 0, 1)), (1, 2, (0, 1, 1))])
def test_exit_codes(high, findings, codes):
    assert tuple(summary.exit_code(high, findings, m) for m in ("always", "critical", "strict")) == codes


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    root = tree(tmp_path / "t", {"a.txt": "x\nuser@example.com"})
    assert cli.main(["scan", root, "-v", "-o", str(tmp_path / "r.json")], spark) == 1
    shown = capsys.readouterr().out
    assert shown.rstrip("\n") == (tmp_path / "r.json").read_text()
    made = json.loads(shown)
    assert list(made) == ["status", "findings", "files_scanned", "total_lines", "excluded_files", "scan_time"]
    assert list(made["findings"][0]) == list(matching.COLUMNS) and made["status"] == "FAIL"
    assert cli.main(["scan", root, "--exit-mode", "critical"], spark) == 0
    assert capsys.readouterr().out == "WARNING: 1 potential secret(s) detected (HIGH: 0, MEDIUM: 0, LOW: 1)\n"
    assert cli.main(["scan", root, "--exclude", "*"], spark) == 0
    assert capsys.readouterr().out == "No secrets found.\n"
    assert cli.main(["scan", root, "--exclude", "a**"], spark) == 2
    assert "Invalid exclude pattern" in capsys.readouterr().err
    assert cli.main(["scan", root, "-o", str(tmp_path / "no/r.json")], spark) == 2


def test_report_frame_equals_json(spark):
    texts = spark.createDataFrame(fixtures.detector_corpus(), "path string, content string")
    excluded = spark.createDataFrame([("b",), ("a",)], "path string")
    row = report.report_frame(matching.find(texts, config.built_in()), texts, excluded, "1.0s").first()
    assert row.status == "FAIL" and row.files_scanned == 86 and row.excluded_files == ["a", "b"]
    assert [tuple(f) for f in row.findings] == [tuple(f) for f in matching.ordered(matching.find(texts, config.built_in())).collect()]


def test_push_policy(spark):
    df = spark.createDataFrame([r[:3] for r in fixtures.REMOTES], "remote string, allowed string, blocked string")
    assert [r[0] for r in df.select(policy.push_allowed(F.col("remote"), F.col("allowed"), F.col("blocked"))).collect()] == [r[3] for r in fixtures.REMOTES]


def test_hook_options():
    with pytest.raises(ValueError, match="only supported for pre-push"):
        hooks.HookOptions("pre-commit", allowed_repos="a")
    with pytest.raises(ValueError, match="only supported for pre-commit"):
        hooks.HookOptions("pre-push", exclude="a")


def test_hook_checks(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    tree(tmp_path, {"b.txt": "pwd=1", "a.txt": "x", "c.txt": "pwd=2", "d.txt": "pwd=3"})
    git("add", "a.txt")
    said = []
    assert hooks.check_commit(spark, hooks.HookOptions("pre-commit"), str(tmp_path), said.append) == 0
    git("add", "b.txt", "c.txt")
    assert hooks.check_commit(spark, hooks.HookOptions("pre-commit"), str(tmp_path), said.append) == 1
    assert said[0].endswith("b.txt") and "c.txt" not in said[1]
    assert hooks.check_commit(spark, hooks.HookOptions("pre-commit", exclude="b.txt,c.txt"), str(tmp_path), said.append) == 0
    assert hooks.check_push(spark, hooks.HookOptions("pre-push", blocked_repos="x"), str(tmp_path), "git@x:r", said.append) == 1
    assert hooks.check_push(spark, hooks.HookOptions("pre-push"), str(tmp_path), "", said.append) == 1


def test_hooks_are_installed_and_removed(tmp_path, monkeypatch, capsys):
    for name in ("APPDATA", "USERPROFILE", "XDG_CONFIG_HOME"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", str(tmp_path / "gitconfig"))
    (tmp_path / "r").mkdir()
    monkeypatch.chdir(tmp_path / "r")
    assert cli.main(["hook", "install", "pre-commit"]) == 2  # no repository
    subprocess.run(["git", "init", "-q", "."], check=True)
    path = tmp_path / "r/.git/hooks/pre-commit"
    assert cli.main(["hook", "uninstall", "pre-commit"]) == 0
    assert cli.main(["hook", "install", "pre-commit", "--exclude", "it's,*.log"]) == 0 and cli.main(["hook", "install", "pre-commit", "--exclude", "it's,*.log"]) == 0
    text = path.read_text()
    assert install.MARK in text and os.access(path, os.X_OK)
    shown = subprocess.run(["sh", "-c", text.replace(" exec ", " printf '%s|' ")], capture_output=True, text=True, check=True).stdout
    assert shown.split("|")[1:-1] == ["-m", "gritsieve", "check", "pre-commit", "--exclude", "it's,*.log"]
    assert cli.main(["hook", "uninstall", "pre-commit"]) == 0 and not path.exists()
    path.write_text("#!/bin/sh\nexit 0\n")
    assert cli.main(["hook", "install", "pre-commit"]) == cli.main(["hook", "uninstall", "pre-commit"]) == 2 and "exit 0" in path.read_text()
    assert cli.main(["hook", "install", "pre-commit", "--allowed-repos", "a"]) == cli.main(["hook", "install", "pre-push", "--exclude", "a"]) == 2
    everywhere = tmp_path / "home/.config/gritsieve/hooks/pre-push"
    assert cli.main(["hook", "install", "pre-push", "--global", "--blocked-repos", "x"]) == 0 and "'--blocked-repos' 'x'" in everywhere.read_text()
    assert install.global_folder() == everywhere.parent
    assert cli.main(["hook", "uninstall", "pre-push", "--global"]) == 0 and not everywhere.exists()
    assert [str(install.own_global_folder(v)) for v in ({"XDG_CONFIG_HOME": "/x", "HOME": "/h"}, {"APPDATA": "/a"}, {"USERPROFILE": "/u"})] == ["/x/gritsieve/hooks", "/a/gritsieve/hooks", "/u/.config/gritsieve/hooks"]
    with pytest.raises(install.HookError):
        install.own_global_folder({})


def test_aliases_and_integrity(tmp_path, capsys):
    assert cli.main(["init", "fish"]) == cli.main(["init", "bash"]) == cli.main(["verify-integrity"]) == 0
    said = capsys.readouterr().out
    assert "alias gs '" in said and "alias gs='" in said and "cli.py" in said
    program = tmp_path / "p"
    program.write_text("x")
    program.chmod(0o777)
    assert not install.verify(program)


def test_stream_equals_batch(spark, tmp_path):
    texts = spark.createDataFrame(fixtures.detector_corpus(), "path string, content string")
    texts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_findings(spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), config.built_in())
    query = write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*matching.COLUMNS).collect()))
    assert got == sorted(map(tuple, matching.find(texts, config.built_in()).select(*matching.COLUMNS).collect()))


def test_plan_is_one_scan_of_two_columns(spark):
    """All detectors, of lines and of whole files."""
    plan = matching.find(queries.table_texts(spark, SF, "documents"), config.built_in())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Union" not in plan
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


PIECES = ["a", ".", "@", "-", "é", "/", ":", "redis://", "mongodb://", "MySQL://", "mongodb+srv://", "co", "m_", "%", " ", "'", '"', "=", "\u00a0", "\n", "@@", ".b@c.de", "u:p@h", "eyJ", ".eyJa", "1", "٢", "sk_", "ſ"]


def random_texts():
    rng = random.Random(11)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(6000)]
    corpus = [t for _, t in fixtures.detector_corpus()]
    for _ in range(4000):
        text = list(" ".join(rng.choice(["x", "é", "", "1"]) + t for t in rng.sample(corpus, 2)))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 2)] = rng.choice(["", "a", "1", "é", "\u00a0", "٣", "K", "ſ", "-", ".", text[at].swapcase()])
        made.append("".join(text))
    return made


def test_linear_forms_and_pretests_equal_the_patterns(spark):
    detectors = config.built_in()
    docs = spark.createDataFrame([(t,) for t in random_texts()], "t string").repartition(4)
    t = F.col("t")
    for d in detectors:
        if d.linear:
            wrong = docs.where(linear.FIRST[d.linear](t) != F.regexp_extract(t, d.java, 0)).limit(1).collect()
            assert not wrong, (d.name, wrong)
    matched = [F.count_if(t.rlike(d.java)).alias(f"m{i}") for i, d in enumerate(detectors)]
    lost = [F.count_if(t.rlike(d.java) & ~matching._may_match(t, d)).alias(f"l{i}") for i, d in enumerate(detectors)]
    row = docs.agg(*matched, *lost).first()
    assert not any(row[f"l{i}"] for i in range(len(detectors)))
    assert sum(row[f"m{i}"] > 0 for i in range(len(detectors))) >= len(detectors) - 1  # a block that goes over lines is left out


@pytest.mark.parametrize("run", ["a.", "redis://", "mongodb://", "a@", "1 ", "pwd ", "eyJ", "aB3+"])
def test_a_megabyte_on_one_line(spark, run):
    began = time.monotonic()
    text = run * (1_000_000 // len(run))
    found(spark, f"x@y.zz {text}\nx@")
    assert time.monotonic() - began < 60


def test_files_source(spark, tmp_path):
    from gritsieve.sources.datasource import FilesSource

    root = tree(tmp_path, {"a.txt": "x", "_b.txt": "", ".env": "y", ".git/c": "z", "d.log": "w", "sub/e.txt": b"\xff\0", "sub/x/f.txt": "q"})
    spark.dataSource.register(FilesSource)
    read = lambda paths, exclude: {os.path.relpath(r.path, root): bytes(r.content) for r in spark.read.format("gritsieve_files").option("paths", json.dumps(paths)).option("exclude", exclude).load().collect()}
    assert read([root, f"{root}/a.txt", f"{root}/none"], "*.log,sub/x/*") == {"a.txt": b"x", "_b.txt": b"", ".env": b"y", "sub/e.txt": b"\xff\0"}
    assert read([f"{root}/none"], "") == {}
