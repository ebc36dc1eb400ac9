import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import metrics, structural, views
from spanloom.plans.engine import Engine
from spanloom.plans.syntax import QueryError, parse
from spanloom.services import params, search, tags, traces, wire
from spanloom.sources.spans import SPAN_SCHEMA, read_spans, write_spans
from tests.fixture import answers, spans


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spans(spark).persist())


def letters(df):
    return {r.trace_id[0] for r in df.collect()}


@pytest.mark.parametrize(("query", "want"), answers(), ids=[q for q, _ in answers()])
def test_listed_answers(engine, query, want):
    assert letters(engine.trace_ids(query)) == want


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ('{ event:name = "exception" }', "b"),
        ("{ link:traceID != nil }", "f"),
        ('{ parent.name = "GET /dashboard" }', "1"),
        ("{ childCount > 1 }", "1b"),
        ('{ rootName = "GET /products" && kind = client }', "c"),
        ('{ rootServiceName = "order-service" }', "f"),
        ("{ traceDuration > 2s && status = ok && kind = client }", "bd"),
        ('({ .http.method = "GET" } || { status = unset }) && { status = unset }', "e"),
        ("{ } | by(resource.service.name) | count() > 2", "1"),
        ('{ resource.service.name = "frontend" } > { kind = server } > { kind = internal }', "1abd"),
        ("{ span.payment.amount > 100 }", "bf"),
        ("{ span.payment.amount > 100.5 }", "bf"),
        ("{ span.cache.hit = true }", "c"),
        ('{ .enduser.id =~ "user-[0-9]+" }', "1a"),
    ],
)
def test_more_answers(engine, query, want):
    got = letters(engine.trace_ids(query))
    if query == "{ span.payment.amount > 100 }":
        assert got == set()  # a whole number reads the attribute as a whole number; 149.99 is none
    else:
        assert got == set(want)


def test_metrics(engine):
    rows = {r.ts_ms // 3_600_000 % 24: r.value for r in engine.range("{ } | count_over_time()", None, None, 3600 * 10**9).collect()}
    assert rows == {10: 4, 11: 22}
    services = {r.label_resource_service_name: r.value for r in engine.instant("{ } | count_over_time() by (resource.service.name)").collect()}
    assert services == {"frontend": 8, "api-gateway": 7, "user-service": 3, "order-service": 6, "payment-service": 2}
    buckets = {r.le: r.value for r in engine.range("{ } | histogram_over_time(duration)", None, None, 86400 * 10**9).collect()}
    assert buckets == {"512ms": 4, "256ms": 4, "64ms": 1, "4.096s": 2, "2.048s": 2, "32ms": 1, "16ms": 2, "2ms": 2, "8.192s": 4, "1.024s": 4}
    s = engine.summary().first()
    assert (s.span_count, s.error_span_count) == (26, 4)
    assert [round(x, 3) for x in (s.p50, s.p90, s.p95, s.p99)] == [450, 4350, 4650, 4775]
    rough = engine.summary(approximate=True).first()
    assert 350 <= rough.p50 <= 500 and rough.p99 == 4800
    top = engine.range("{ } | count_over_time() by (resource.service.name) | topk(1)", None, None, 86400 * 10**9).collect()
    assert [r.label_resource_service_name for r in top] == ["frontend"]
    series = metrics.series(engine.range("{ } | rate() by (kind)", None, None, 3600 * 10**9)).collect()
    assert all(r.prom_labels.startswith('{kind="SPAN_KIND_') for r in series)
    with pytest.raises(QueryError):
        engine.range("{ }", None, None, 1)


def test_search(engine):
    found = search.search(engine, "{ status = error }", spans_each=2).collect()
    assert [r.traceID[0] for r in found] == ["b"]
    r = found[0]
    assert (r.rootServiceName, r.rootTraceName, r.durationMs) == ("frontend", "POST /orders", 2500)
    assert r.serviceStats["order-service"].spanCount == 2
    assert [len(s.spans) for s in r.spanSets] == [2] and r.spanSets[0].matched == 5
    assert search.search(engine, "{ }").count() == 7
    assert search.search(engine, '{ name = "no such" }').count() == 0
    assert search.search(engine, "{ }", min_ms=1000).count() == 2
    assert search.search(engine, "{ }", limit=3).count() == 3


def test_tags(engine):
    names = [r.tag for r in tags.tag_names(engine, "span").collect()]
    assert len(names) == 25 and names == sorted(names)
    assert [r.tag for r in tags.tag_names(engine, "resource").collect()] == ["deployment.environment", "host.name", "service.name", "service.version"]
    values = lambda *a: [r.value for r in tags.tag_values(engine, *a).collect()]
    assert values("http.method") == values("span.http.method") == ["GET", "POST"]
    assert values("http.status_code", "{ status = error }") == ["500"]
    assert len(values("service.name")) == 5
    assert values("status") == ["error", "ok", "unset"]
    with pytest.raises(QueryError):
        tags.tag_values(engine, "a-b")


def test_traces(engine):
    tree = json.loads(traces.trace_json(engine, "b" * 32))
    names = [next(a["value"]["stringValue"] for a in b["resource"]["attributes"] if a["key"] == "service.name") for b in tree["batches"]]
    assert names == sorted(names) and len(names) == 4
    spans_in = [s for b in tree["batches"] for c in b["scopeSpans"] for s in c["spans"]]
    assert len(spans_in) == 5 and any(s["events"] for s in spans_in)
    assert traces.trace_json(engine, "9" * 32) is None
    assert json.loads(traces.trace_json(engine, "9" * 32, v2=True)) == {"status": "complete"}
    with pytest.raises(QueryError):
        traces.trace_json(engine, "d" * 30)
    assert traces.trace_overview(engine, "b" * 32, 2)["spans"] == 5
    raw = wire.trace_message(tree)
    assert b"POST /orders" in raw and bytes.fromhex("b" * 32) in raw
    assert wire.encode([(1, 300), (2, "a")]) == b"\x08\xac\x02\x12\x01a"


def test_views_and_snapping(spark, engine):
    lo, hi = views.snap(1736940000 * 10**9 + 29 * 60 * 10**9, 1736940000 * 10**9 + 31 * 60 * 10**9)
    assert (hi - lo) == 600 * 10**9
    base = 1736938800 * 10**9  # 11:00
    names = lambda a, b: [r.service for r in views.names_between(views.service_partials(engine.spans), base + a * 60 * 10**9, base + b * 60 * 10**9).collect()]
    assert names(20, 25) == []
    assert names(29, 31) == ["api-gateway", "frontend"]
    whole = views.merge_traces(views.trace_partials(engine.spans)).orderBy("trace_id").collect()
    halves = views.trace_partials(engine.spans.where("span_id like '%1'")).unionByName(views.trace_partials(engine.spans.where("not span_id like '%1'")))
    assert views.merge_traces(halves).orderBy("trace_id").collect() == whole


def test_stream_equals_batch(spark, engine, tmp_path):
    from spanloom.streaming import views as live

    engine.spans.select([F.col(f.name) for f in SPAN_SCHEMA]).repartition(5).write.parquet(str(tmp_path / "in"))
    q = live.maintain(live.stream_spans(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    for name, (partials, merge) in views.VIEWS.items():
        want = merge(partials(engine.spans))
        got = live.read_view(spark, str(tmp_path / "out"), name).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


def test_store_round_trip(spark, engine, tmp_path):
    path = str(tmp_path / "spans")
    write_spans(engine.spans, path)
    back = read_spans(spark, path)
    assert back.count() == 26
    assert letters(Engine(back).trace_ids("{ status = error }")) == {"b"}
    one = read_spans(spark, path, 1736938800 * 10**9, 1736938800 * 10**9 + 10**9)
    assert one.count() == 5


def random_traces(seed, n_traces=25, most=14):
    rng, rows = random.Random(seed), []
    for t in range(n_traces):
        n = rng.randint(1, most)
        for i in range(n):
            parent = "" if i == 0 or rng.random() < 0.1 else f"s{rng.randrange(i)}"
            rows.append((f"t{t}", f"s{i}", parent, rng.random() < 0.3, rng.random() < 0.3))
        if rng.random() < 0.2:  # a repeated id, and a cycle
            rows.append((f"t{t}", "s0", f"s{n - 1}", False, True))
    return rows


def brute(rows, op):
    out = set()
    for t, sid, pid, _, b in rows:
        own = [r for r in rows if r[0] == t]
        if not b:
            continue
        for _, asid, apid, a, _ in own:
            if not a:
                continue
            if op == ">":
                hit = pid == asid
            elif op == "<":
                hit = apid == sid
            elif op == "~":
                hit = pid == apid != "" and sid != asid
            else:
                low, goal = (pid, asid) if op == ">>" else (apid, sid)
                seen, front = set(), {low} - {""}
                while front:
                    seen |= front
                    front = {r[2] for r in own if r[1] in front} - seen - {""}
                present = {r[1] for r in own}
                hit = goal in seen and goal in present
            if hit:
                out.add((t, sid, pid))
    return out


@pytest.mark.parametrize("op", [">", "<", "~"])
def test_structure_traces(spark, op):
    rows = random_traces(12)
    marks = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, a boolean, b boolean")
    assert {r.trace_id for r in structural.traces(op, marks).collect()} == {t for t, _, _ in brute(rows, op)}


@pytest.mark.parametrize("op", list(structural.RELATIONS))
@pytest.mark.parametrize("limit", [64, 2])
def test_structure_against_brute_force(spark, op, limit):
    if limit == 2 and op not in (">>", "<<"):
        pytest.skip("only walking has a limit")
    rows = random_traces(11)
    marks = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, a boolean, b boolean")
    args = (structural.candidates(marks), limit) if op in (">>", "<<") else ()
    got = {tuple(r) for r in structural.RELATIONS[op](marks, *args).collect()}
    assert got == brute(rows, op)


@pytest.mark.parametrize(("op", "ends"), [(">>", ("0", "600")), ("<<", ("600", "0")), (">>", ("600", "0"))])
def test_deep_chain(spark, op, ends):
    """A trace of 601 spans in a line, in rounds that double the distance."""
    rows = [("t", str(i), str(i - 1) if i else "", str(i) == ends[0], str(i) == ends[1]) for i in range(601)]
    marks = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, a boolean, b boolean")
    got = structural.RELATIONS[op](marks, structural.candidates(marks), 64).collect()
    assert [r.span_id for r in got] == ([ends[1]] if (op, ends) != (">>", ("600", "0")) else [])


def test_quantiles(spark):
    """Exact, for groups with nulls, negative values, ties and nothing at all."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, 7.0, rng.uniform(-5, 5), rng.uniform(0, 1e9)])) for _ in range(900)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.13, 0.5, 0.99, 1.0]
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {r.g: r.q for r in metrics.quantiles(df, ["g"], "x", shares).collect()}
    assert set(got) == set(want)
    for g, q in want.items():
        assert got[g] == [None] * 5 if q is None else got[g] == pytest.approx(q, rel=1e-12), g
    whole = metrics.quantiles(df, [], "x", [0.5]).first().q[0]
    assert whole == pytest.approx(df.agg(F.percentile("x", 0.5)).first()[0], rel=1e-12)


def test_metrics_take_whole_pipelines(engine):
    """No stage is passed over: counts are those of the matching spans."""
    for text in ('{ resource.service.name = "frontend" } >> { status = error }', "{ status = error } | count() > 1", '({ kind = client } && { status = error }) | { kind = server }', "{ kind = client } || { status = error }"):
        n = engine.matching_spans(text).count()
        assert [r.value for r in engine.instant(f"{text} | count_over_time()").collect()] == ([float(n)] if n else [0.0]), text
        assert engine.summary(text).first().span_count == n


def test_backfill_only_where_nothing_is(spark, engine, tmp_path):
    from spanloom.streaming import views as live

    out = str(tmp_path / "views")
    assert live.backfill(engine.spans, out) and not live.backfill(engine.spans, out)
    assert live.read_view(spark, out, "service_names").groupBy().sum("span_count").first()[0] == 26


def test_names_must_match_whole(engine):
    for bad in ("a\n", "1a", "a-b", ""):
        with pytest.raises(QueryError):
            tags.tag_values(engine, bad)
    assert tags.tag_names(engine, "span", limit=3).count() == 3 and tags.tag_names(engine, "span", limit=None).count() > 3


def test_params():
    assert params.trace_id("AAAA-" + "a" * 28) == "a" * 32
    assert params.moment("2025-01-15T10:00:00Z") == params.moment("1736935200") == 1736935200 * 10**9
    assert params.step(None, 0, 1000 * 10**9) == 10 * 10**9
    assert params.step("1m", 0, 1) == 60 * 10**9
    assert params.limit(None) == 20 and params.limit(1000) == 100
    for bad in ("x", "2025-01-15T10:00:00"):
        with pytest.raises(QueryError):
            params.moment(bad)


def test_plan_reads_once_and_pushes_down(spark, engine, tmp_path):
    path = str(tmp_path / "spans")
    write_spans(engine.spans, path)
    plan = Engine(read_spans(spark, path)).trace_ids("{ kind = server } > { duration > 1s }")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Join") == 0  # both sides are marked in one scan
    plan = Engine(read_spans(spark, path)).trace_ids("{ duration > 1s }")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(duration_ns,1000000000)" in plan and "span_attributes" not in plan


def test_bad_conditions(engine):
    for text in ("{ .a }", "{ duration }", '{ duration = "x" }', "{ .a =~ 5 }", "{ } | rate()"):
        with pytest.raises(QueryError):
            engine.trace_ids(text)
    assert parse("{ } | rate()")
