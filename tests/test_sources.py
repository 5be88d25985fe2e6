"""Readers and writers on files of their own, and streams over several batches."""

import io
import json
import zipfile

import pandas as pd

from loomgraph.operators import sessions as batch_sessions
from loomgraph.sources import files
from loomgraph.streaming import attempts as stream


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


def test_packs_of_two_kinds(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"id": "a", "name": "A", "course": "c"}]))
    (tmp_path / "e.json").write_text(json.dumps([{"from": "a", "to": "b", "edgeType": "related", "weight": 1}]))
    n, e = files.pack_files(spark, f"file://{tmp_path}/n.json", f"file://{tmp_path}/e.json", "p")
    assert tuple(n.first()) == ("p", "a", "A", "c", None) and tuple(e.first()) == ("p", "a", "b", "related", 1.0, None)
    (tmp_path / "p.json").write_text(json.dumps({"nodes": [{"kp_id": "a", "title": "A", "ord": 3}], "edges": [{"from_kp": "a", "to_kp": "b", "why": "w"}]}))
    n, e = files.pack_file(spark, f"file://{tmp_path}/p.json", "p")
    assert n.first().ord == 3 and e.first().source == "w"


def test_question_bank_with_defaults(spark):
    rows = [(json.dumps({"b": [{"stem": "s", "options": ["x"]}, {"difficulty": 5, "correctIndex": 1}]}),), ("{broken",), (None,)]
    got = files.question_bank(spark.createDataFrame(rows, "value string")).orderBy("no").collect()
    assert [(r.stem, r.options, r.difficulty, r.est_min, r.correct_index) for r in got] == [("s", ["x"], 3, 5, 0), ("", [], 5, 5, 1)]


def test_json_lines_last_row_wins_and_line_separators_stay(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "old"}\n{"k": 1, "v": "new line"}\nbroken\n\n{"k": 2, "v": null}\n')
    got = {r.k: r.v for r in files.json_lines(spark, f"file://{tmp_path}/a.jsonl", "k int, v string", ["k"]).collect()}
    assert got == {1: "new line", 2: None}


def test_recognised_words_in_lines(spark, tmp_path):
    word = lambda y, x, conf, text: "\t".join(map(str, [5, 1, 1, 1, 1, 1, x, y, 10, 10, conf, text]))
    (tmp_path / "w.tsv").write_text("\n".join(["level\tpage", word(10, 50, 90, "world"), word(12, 5, 90, "hello"), word(40, 5, 90, "next"), word(40, 20, 10, "weak"), word(40, 30, 90, "x"), word(40, 40, 90, "7")]))
    w = files.recognised_words(spark, f"file://{tmp_path}/w.tsv", 50)
    assert [r.text for r in files.word_lines(w).orderBy("line_no").collect()] == ["hello world", "next 7"]


def test_documents_of_each_kind(spark, tmp_path):
    p = "<w:p><w:pPr><w:pStyle w:val=\"Heading2\"/></w:pPr><w:t>Head</w:t></w:p><w:p><w:t>A &amp; B</w:t></w:p>"
    (tmp_path / ("0" * 32 + "_a.docx")).write_bytes(zipped({"word/document.xml": p, "word/footer1.xml": "<w:p><w:t>foot</w:t></w:p>"}))
    (tmp_path / "b.pptx").write_bytes(zipped({"ppt/slides/slide10.xml": "<a:p>ten</a:p>", "ppt/slides/slide2.xml": "<a:p>two</a:p>", "ppt/notesSlides/notesSlide1.xml": "<a:p>note</a:p>"}))
    (tmp_path / "c.epub").write_bytes(zipped({"META-INF/container.xml": '<rootfile full-path="o/x.opf"/>', "o/x.opf": '<item id="1" href="b.html"/><item id="2" href="a.html"/><itemref idref="2"/><itemref idref="1"/>', "o/a.html": "<p>first</p>", "o/b.html": "<p>second</p>"}))
    (tmp_path / "d.html").write_text("<p>x</p><script>no</script>y&#65;")
    (tmp_path / "e.doc").write_bytes(b"\x01\x02" + "readable words here".encode("utf-16-le"))
    (tmp_path / "f.docx").write_bytes(b"no archive")
    (tmp_path / "g.exe").write_bytes(b"x")
    got = {r.name: r for r in files.documents(spark, f"file://{tmp_path}").collect()}
    assert got["a.docx"].text == "## Head\nA & B\nfoot" and got["b.pptx"].text == "[slide 1]\ntwo\n[slide 2]\nten\n[notes 1]\nnote"
    assert got["c.epub"].text == "first\n\nsecond" and got["d.html"].text == "x\nyA" and "readable words here" in got["e.doc"].text
    assert got["f.docx"].error and got["f.docx"].text == "" and got["g.exe"].error
    assert {r.name for r in files.allowed(spark.createDataFrame([(n,) for n in got], "name string")).collect()} == {"a.docx", "b.pptx", "c.epub", "d.html", "f.docx"}


def test_parts_and_upserts(spark):
    parts = spark.createDataFrame([("u", 10, "c"), ("u", 2, "b"), ("u", 1, "a"), ("u", 1, "a"), (None, 1, "x")], "upload_id string, idx int, part string")
    assert [tuple(r) for r in files.joined_parts(parts).collect()] == [("u", "abc", 3)]
    old, new = (spark.createDataFrame(x, "k int, v int, s string") for x in ([(1, 1, "o"), (2, 5, "o"), (3, 1, "o")], [(1, 2, "n"), (2, 5, "n"), (4, None, "n")]))
    assert {(r.k, r.s) for r in files.upserted(old, new, ["k"], "v").collect()} == {(1, "n"), (2, "n"), (3, "o"), (4, "n")}


def test_stream_over_several_batches_is_the_batch(spark, tmp_path):
    at = pd.Timestamp("2025-01-06 12:00", tz="UTC")
    rows = [(f"a{i:02d}", f"s{i % 2}", "K", i % 3 == 0, (at + pd.Timedelta(minutes=7 * i)).to_pydatetime()) for i in range(40)]
    schema = "attempt_id string, student_id string, kp_id string, correct boolean, occurred_at timestamp"
    path = f"file://{tmp_path}/in"
    for k in range(4):
        spark.createDataFrame(rows[10 * k : 10 * k + 10] + rows[10 * k : 10 * k + 1], schema).coalesce(1).write.mode("append").parquet(path)
    source = lambda n=None: stream.usable(stream.read_stream(spark, path, n))
    acc = {}
    for _, s, _, right, _ in rows:
        acc[s] = (0.8 if right else 0.4) if s not in acc else (9 * acc[s] + right) / 10
    got = {r.student_id: r for r in stream.drain(stream.moving(source()), ["student_id", "kp_id"], "n", "update").collect()}
    assert {s: round(r.acc, 9) for s, r in got.items()} == {s: round(x, 9) for s, x in acc.items()} and got["s0"].n == 20
    days = stream.drain(stream.daily(stream.read_stream(spark, path, 1)), ["student_id"], mode="complete").collect()
    assert sum(r.n for r in days) == 44
    want = {(r.student_id, r.start_us, r.end_us) for r in batch_sessions.sessionize(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.student_id, r.start_us, r.end_us) for r in stream.drain(stream.sessions(stream.read_stream(spark, path, 1)), ["student_id"], mode="complete").collect()} == want


def test_moving_values_of_many_keys_take_few_states(spark, tmp_path):
    at = pd.Timestamp("2025-01-06 12:00", tz="UTC")
    rows = [(f"a{i:04d}", f"s{i % 7}", f"K{i % 31}", i % 3 == 0, (at + pd.Timedelta(minutes=i)).to_pydatetime()) for i in range(600)]
    schema, path = "attempt_id string, student_id string, kp_id string, correct boolean, occurred_at timestamp", f"file://{tmp_path}/in"
    for k in range(2):
        spark.createDataFrame(rows[300 * k : 300 * k + 300], schema).coalesce(1).write.mode("append").parquet(path)
    want = {}
    for _, s, k, right, _ in rows:
        acc, sev, streak, n = want.get((s, k), (0.0, 0.0, 0, 0))
        acc, sev = ((9 * acc + right) / 10, min(1.0, sev * (0.9 if right else 1.05))) if n else ((0.8, 0.2) if right else (0.4, 0.5))
        want[s, k] = acc, sev, streak + 1 if right else 0, n + 1
    q = stream.moving(stream.read_stream(spark, path, 1), 16).writeStream.format("memory").queryName("moved").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(want) == 217 and {p["batchId"] for p in q.recentProgress} >= {0, 1} and 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 16
    got = {}
    for r in spark.table("moved").orderBy("n").collect():
        got[r.student_id, r.kp_id] = (r.acc, r.sev, r.streak, r.n)
    assert got == want
