"""The general operators: hand cases, special cases, seams and hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import formulas as f
from loomgraph.functions import text as t
from loomgraph.operators import features, graphs, hierarchy, learners, profiles, sessions, texts
from loomgraph.operators.attempts import latest_by_key

T0 = dt.datetime(2025, 1, 6, 12, tzinfo=dt.timezone.utc)
ATTEMPTS = "attempt_id string, student_id string, kp_id string, correct boolean, self_conf int, latency_ms bigint, hints_used int, occurred_at timestamp, created_at timestamp, n int"
KPS = "kp_id string, kp_name string, course string, difficulty int"


def attempt(i, student="s1", kp="K1", correct=True, minutes=0, created=0, conf=3):
    at = None if minutes is None else T0 + dt.timedelta(minutes=minutes)
    return (i, student, kp, correct, conf, 1000, 0, at, T0 + dt.timedelta(minutes=created), 7)


@pytest.fixture(scope="module")
def kps(spark):
    return spark.createDataFrame([("K1", "one", "A", 2), ("K2", "two", "A", 3), ("K3", None, "B", None), (None, "x", "B", 1)], KPS)


@pytest.fixture(scope="module")
def attempts(spark):
    rows = [attempt("a1"), attempt("a1"), attempt("a1", correct=False, created=5), attempt("a2", kp=" k1 ", minutes=10), attempt("a3", kp="K2", minutes=100, correct=None), attempt("a4", kp="none", minutes=20)]
    rows += [attempt("a5", student=None), attempt(None, minutes=31), attempt(None, minutes=31), attempt("a6", kp=None, minutes=70), attempt("a7", student="s2", kp="K3", minutes=None), attempt("a8", student="s3", kp="K2")]
    return spark.createDataFrame(rows, ATTEMPTS)


def test_latest_row_of_each_key(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("a", None, "z"), (None, 1, "p"), (None, 1, "p")]
    got = sorted(map(tuple, latest_by_key(spark.createDataFrame(rows, "k string, v int, w string"), "k", ["v"], ["k", "v", "w"]).collect()), key=repr)
    assert got == sorted([("a", 2, "y"), (None, 1, "p"), (None, 1, "p")], key=repr)


def test_features_found(attempts, kps):
    got = {tuple(r) for r in features.found(attempts, kps).collect()}
    assert got == {("s1", "K1", 4, 3, 20250106), ("s1", "K2", 1, 0, 20250106), ("s2", "K3", 1, 1, None), ("s3", "K2", 1, 1, 20250106)}


def test_feature_table_has_every_student_and_leaves_no_table(spark, attempts, kps):
    wide = features.entity_features(attempts, kps, block_size=2)
    assert {c for c in wide.columns} >= {"student_id", "f000", "f001"}
    rows = {r.student_id: r for r in wide.select("student_id", "n_attempts", features.feature(wide, "K2").alias("k2")).collect()}
    assert set(rows) == {"s1", "s2", "s3"} and rows["s1"].n_attempts == 7 and rows["s1"].k2 == 1 and rows["s2"].k2 == 0
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("loom_cells")]
    assert features.entity_features(attempts.limit(0), kps).count() == 0
    assert features.entity_features(attempts, kps.limit(0)).count() == 3


def test_dense_block(attempts, kps):
    wide = features.dense_features(features.entity_features(attempts, kps, block_size=2), kps, block_size=2)
    rows = {r.student_id: r for r in wide.collect()}
    assert rows["s1"].n000 == [4, 1] and rows["s1"].n001 == [0] and rows["s2"].n001 == [1] and rows["s3"].n000 == [0, 1]


def sessions_by_hand(times, gap):
    out = []
    for x in sorted(times):
        if out and x - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = x, out[-1][2] + 1
        else:
            out.append([x, x, 1])
    return {tuple(x) for x in out}


@pytest.mark.parametrize("width", [100, 1000, 10**9])
def test_sessions_at_the_seams_of_slices(spark, width):
    rng = random.Random(width)
    rows = [("hot", rng.randrange(20_000)) for _ in range(900)] + [("b", x) for x in (99, 100, 199, 210, 300, 399)] + [("c", 5), (None, 5), ("d", None), ("c", 5)]
    df = spark.createDataFrame(rows, "u string, us bigint").select("u", F.timestamp_micros("us").alias("at"), F.lit(1).alias("n"), F.lit(2).alias("start_us"))
    got = sessions.sessionize(df, "u", "at", 10, width).collect()
    for u in ("hot", "b", "c"):
        assert {(r.start_us, r.end_us, r.n_events) for r in got if r.u == u} == sessions_by_hand([x for v, x in rows if v == u and x is not None], 10)
    assert {r.u for r in got} == {"hot", "b", "c"}
    assert sessions.sessionize(df.limit(0), "u", "at").count() == 0


def test_session_ends_after_more_than_the_gap(attempts):
    got = {tuple(r)[1:] for r in sessions.found(attempts).collect() if r.student_id == "s1"}
    us = lambda m: int((T0 + dt.timedelta(minutes=m)).timestamp() * 1e6)
    assert got == {(us(0), us(31), 5), (us(70), us(100), 2)}


NODES, EDGES = "pack_id string, kp_id string, kp_name string", "pack_id string, from_kp string, to_kp string, edge_type string, weight double, source string"


def edge(a, b, kind="prerequisite", weight=1.0, pack="p"):
    return (pack, a, b, kind, weight, "s")


def test_hierarchy_with_chains_cycles_and_dirt(spark):
    chain = [edge(f"n{i:03d}", f"n{i + 1:03d}") for i in range(90)]
    rows = [*chain, edge("n000", "n001", " Prerequisite ", 2.0), edge("n010", "m", "PREREQUISITE"), edge("x", "y"), edge("y", "z"), edge("z", "x"), edge("y", "w"), edge("n001", "n001"), edge("n000", "gone"), edge(None, "n000"), edge("n000", "w2", "related"), edge("a", "b", pack="q")]
    names = {e for r in rows for e in r[1:3] if e not in (None, "gone", "a", "b")}
    nodes = spark.createDataFrame([("p", n, "x") for n in names] * 2 + [("q", "a", None), ("q", "b", None), (None, "a", None), ("q", None, None)], NODES)
    edges = spark.createDataFrame(rows, EDGES)
    found = {(r.pack_id, r.kp_id): (r.root_kp, r.depth) for r in hierarchy.found(nodes, edges).collect()}
    assert len(found) == len(names) + 2
    assert all(found["p", f"n{i:03d}"] == ("n000", i) for i in range(91)) and found["p", "m"] == ("n000", 11)
    assert all(found["p", k] == ("", -1) for k in "wxyz") and found["p", "w2"] == ("w2", 0) and found["q", "b"] == ("a", 1)
    parents = hierarchy.parent_pointers(nodes, edges)
    tree = hierarchy.hierarchy(parents)
    paths = {(r.pack_id, r.kp_id): r.path for r in tree.collect()}
    assert paths["p", "n090"] == [f"n{i:03d}" for i in range(91)] and paths["p", "x"] is None
    assert {(r.kp_id, r.cycle) for r in hierarchy.cycles(parents, tree).collect()} == {("x", "x"), ("y", "x"), ("z", "x")}
    assert hierarchy.descendants(tree).where("kp_id = 'n000'").count() == 91
    assert hierarchy.found(nodes.limit(0), edges).count() == 0
    two = spark.createDataFrame([edge("n000", "n002")], EDGES).unionByName(edges)
    assert [tuple(r) for r in hierarchy.several_parents(nodes, two).collect()] == [("p", "n002", 2)]


def test_splitterless_cycle(spark):
    nodes = spark.createDataFrame([("p", c, "") for c in "abc"], NODES)
    edges = spark.createDataFrame([edge("a", "b"), edge("b", "c"), edge("c", "a")], EDGES)
    parents = hierarchy.parent_pointers(nodes, edges)
    for split in (1, 8, 10**9):
        tree = hierarchy.hierarchy(parents, split)
        assert {(r.kp_id, r.root_kp, r.depth) for r in tree.collect()} == {(c, "", -1) for c in "abc"}
        assert {(r.kp_id, r.cycle) for r in hierarchy.cycles(parents, tree).collect()} == {(c, "a") for c in "abc"}


def test_formulas_by_hand(spark):
    d = spark.range(1)
    one = lambda *c: d.select(*c).first()
    lit = F.lit
    r = one(
        f.score_v1(lit(0.5), lit(0.5), lit(3.0)), f.band(lit(40)), f.empirical(lit(12), lit(10)), f.support(lit(None).cast("double"), lit(None).cast("double")), f.ceiling(lit(0.2)),
        f.impact_v1(lit(30.0), lit(40.0), lit(3), lit(7.0), lit(1.5)), f.impact_v1(lit(40.0), lit(40.0), lit(3), lit(0.0), lit(1.0)), f.review_interval(lit(90), lit(1)), f.minutes_of_impact(lit(20.0)), f.npmi(lit(4), lit(4), lit(4), lit(4)), f.hub_score(lit(4), lit(9)),
    )
    assert list(r)[:2] == [51.0, "yellow"] and r[2] == pytest.approx(10.5 / 11) and r[3] == 0.5 and r[4] == pytest.approx(0.64)
    assert r[5] == pytest.approx(3 * 10 * 0.5 * 1.5) and r[6] == 0 and r[7] == 4 and r[8] == 8 and r[9] == 1 and r[10] == 9.25


def test_noise_has_the_shape_of_laplace(spark):
    d = spark.range(20_000).select(f.laplace(f.splitmix(F.col("id")), 2.0).alias("x"))
    r = d.agg(F.avg("x"), F.avg(F.abs("x"))).first()
    assert abs(r[0]) < 0.1 and abs(r[1] - 2.0) < 0.1
    assert d.limit(5).collect() == spark.range(5).select(f.laplace(f.splitmix(F.col("id")), 2.0).alias("x")).collect()


def test_weak_links(spark, attempts, kps):
    rows = [attempt(f"x{i}", kp="K1", correct=False, minutes=i, conf=1) for i in range(3)] + [attempt(f"y{i}", kp="K2", correct=i == 0, minutes=9 + i, conf=1) for i in range(4)]
    g = learners.graded_attempts(spark.createDataFrame(rows, ATTEMPTS), kps)
    m = learners.mastery_v1(learners.mastery_inputs(g))
    links = learners.debt_graph(spark.createDataFrame([edge("K1", "K2", weight=0.5), edge("K1", "K2", " Transfer_Gap", 1.5), edge("K1", "K9"), edge("K1", "K1"), edge("K2", "K1", "related")], EDGES), kps)
    assert [tuple(r) for r in links.collect()] == [("K1", "K2", 1.5, 1)]
    top = learners.top_debts(learners.debts(m, links, kps)).collect()
    score = 100 * (0.6 * 0.25 + 0.3 * 0.25 + 0.1 * 0.2)
    assert [(r.from_name, r.to_name, r.freq, r["rank"]) for r in top] == [("one", "two", 3, 1)] and top[0].impact == pytest.approx(3 * (50 - score) * 1.5)
    assert learners.top_debts(learners.debts(m.limit(0), links, kps)).count() == 0


def test_fold_equals_a_loop(spark, kps):
    rng = random.Random(4)
    ys = [rng.random() < 0.4 for _ in range(200)]
    g = learners.graded_attempts(spark.createDataFrame([attempt(f"a{i:03d}", correct=y, minutes=i) for i, y in enumerate(ys)], ATTEMPTS), kps)
    acc, sev = (0.8, 0.2) if ys[0] else (0.4, 0.5)
    for y in ys[1:]:
        acc, sev = (9 * acc + y) / 10, min(1.0, sev * (0.9 if y else 1.05))
    r = learners.attempt_fold(g).first()
    assert r.acc == pytest.approx(acc) and r.sev == pytest.approx(sev) and r.n == 200


def test_places_over_days(spark, kps):
    rows = [attempt(f"a{i:02d}", minutes=i * 700, correct=i % 3 == 0) for i in range(20)]
    r = profiles.placed(learners.graded_attempts(spark.createDataFrame(rows, ATTEMPTS), kps)).orderBy("place").collect()
    assert [x.place for x in r] == list(range(1, 21)) and [x.prev_y for x in r][1:] == [x.y for x in r][:-1] and r[0].prev_y is None


def test_cohort_is_hidden_when_small(spark):
    q = {r.g: r for r in profiles.cohort_quantiles(spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", 1.0)] * 4, "g string, score double"), "g").collect()}
    assert (q["a"].p25, q["a"].p50, q["a"].p75) == (1, 2, 3) and q["b"].suppressed and q["b"].p50 is None


def test_graph_of_a_diamond(spark):
    nodes = spark.createDataFrame([("p", c, "") for c in "abcde"], NODES)
    e = spark.createDataFrame([edge("a", "b"), edge("a", "c"), edge("b", "d"), edge("c", "d")], EDGES)
    closure = graphs.longest_paths(e)
    layered = graphs.layers(nodes, closure)
    assert {r.kp_id: r.layer for r in layered.collect()} == {"a": 0, "e": 0, "b": 1, "c": 1, "d": 2}
    assert {r.kp_id: r.mass for r in graphs.downstream_mass(nodes, closure).collect()} == {"a": 3, "b": 1, "c": 1, "d": 0, "e": 0}
    assert [r.kp_id for r in graphs.critical_path(layered, e).orderBy("place").collect()] == ["a", "b", "d"]
    ranks = graphs.pagerank(nodes, e, rounds=10).collect()
    assert sum(r["rank"] for r in ranks) == pytest.approx(1)
    gain = {r.kp_id: r.gain for r in graphs.diffusion(e, nodes.where("kp_id = 'a'").withColumn("amount", F.lit(200.0))).collect()}
    assert gain == pytest.approx({"a": 100, "b": 55, "c": 55, "d": 60.5})
    assert {r.component for r in graphs.components(nodes, e).collect()} == {"a", "e"}
    loop = e.unionByName(spark.createDataFrame([edge("d", "a", weight=0.5)], EDGES))
    with pytest.raises(ValueError, match="cycle"):
        graphs.longest_paths(loop)
    assert graphs.acyclic(nodes, loop).count() == 4 and graphs.longest_paths(e.limit(0)).count() == 0


def test_text_functions(spark):
    rows = [("Ａ　Ｂ \n c", "<p>a&lt;b</p><script>x</script>c<br/>d &amp; e"), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "a string, h string").select(t.plain_width(F.col("a")).alias("p"), t.vote_key(F.col("a")).alias("v"), t.html_text(F.col("h")).alias("h"), F.size(t.slices(F.repeat("a", 100))).alias("n")).collect()
    assert got[0].p == "a b c" and got[0].v == "abc" and got[0].h == "a<b\nc\nd & e" and got[1].p is None and got[2].h == "" and (got[1].n, got[2].n) == (0, 0)
    j = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ("none",), ('```json\n{"a": 2}\n```',)], "s string").select(t.loose_json(F.col("s")).cast("string").alias("j")).collect()
    assert [r.j for r in j] == ['{"a":1}', None, '{"a":2}']


def test_near_names_and_lexicon(spark):
    n = spark.createDataFrame([(x,) for x in ("cash", "cast", "cas", "cash", "dash", "card", "", None, "x")], "name string")
    assert {tuple(r) for r in texts.near_names(n).collect()} == {("cash", "cast"), ("cas", "cash"), ("cas", "cast"), ("cash", "dash"), ("", "x")}
    lex = spark.createDataFrame([("1", "cash"), ("2", "cash flow"), ("3", "flow"), (None, "x")], "term_id string, term string")
    df = spark.createDataFrame([("k", "Cash flow and cash"), ("n", None), ("e", "")], "key string, text string")
    assert {(r.term_id, r.pos) for r in texts.lexicon_hits(df, lex).collect()} == {("2", 0), ("1", 14)}
    assert texts.lexicon_hits(df, lex.limit(0)).count() == 0


def test_paper(spark):
    lines = ["Part A", "1. What is", "it?", "A. one", "B. two", "答案：B", "二、填空题", "2、Fill ____"]
    got = texts.paper_items(spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "paper_id string, line_no bigint, line string")).orderBy("item").collect()
    assert [(r.number, r.section, r.stem, r.n_options, r.answer) for r in got] == [(1, "Part A", "What is it?", 2, "B"), (2, "二、填空题", "Fill ____", 0, None)]


def test_visible_before_search(spark):
    docs = spark.createDataFrame([("1", "o", "private"), ("2", "o", "consented"), ("3", "o", "public"), ("4", "me", "private")], "id string, owner_user_id string, visibility string")
    yes = spark.createDataFrame([("o", "me", "granted")], "student_id string, teacher_id string, state string")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(texts.visible(docs, "me", "student", yes)) == {"3", "4"} and ids(texts.visible(docs, "me", "teacher", yes)) == {"2", "3", "4"} and len(ids(texts.visible(docs, "x", "admin"))) == 4


def test_text_rank_is_made_within_keys_and_writes_nothing(spark):
    from loomgraph import runtime

    rnd = random.Random(5)
    rows = [(f"d{i}", " ".join(rnd.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rnd.randrange(1, 40)))) for i in range(25)]
    rows += [("d0", "beta omega beta"), ("one", "alone"), ("same", "twin twin"), ("none", None), ("blank", "!"), (None, "alpha beta")]
    want = {}
    for key in {k for k, _ in rows if k}:
        texts_of = [x.split() for k, x in rows if k == key and x and x != "!"]
        w = {}
        for x in texts_of:
            for i, a in enumerate(x):
                for gap, b in enumerate(x[i + 1 : i + 5], 1):
                    if a != b:
                        w[a, b], w[b, a] = w.get((a, b), 0) + 1 / gap, w.get((b, a), 0) + 1 / gap
        names = {y for x in texts_of for y in x}
        deg = {a: sum(n for (c, _), n in w.items() if c == a) for a in names}
        r = dict.fromkeys(names, 1 / max(1, len(names)))
        for _ in range(30):
            r = {b: 0.15 / len(names) + 0.85 * sum(r[a] * n / deg[a] for (a, c), n in w.items() if c == b) for b in names}
        want |= {(key, a): x / sum(r.values()) for a, x in r.items()}
    docs = spark.createDataFrame(rows, "id string, body string").coalesce(1)
    before = len(runtime._written)
    for at_once in (200_000, 50):
        got = {(r.id, r.token): r["rank"] for r in texts.text_rank(docs, "id", "body", at_once=at_once).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - x) < 1e-12 for k, x in want.items())
    assert len(runtime._written) == before
    assert texts.text_rank(docs.limit(0), "id", "body").count() == 0
