import json

import pytest

from spanloom.plans.engine import Engine
from spanloom.services import respond
from tests.fixture import spans

FROM, TO = 1736931600 * 10**9, 1736946000 * 10**9


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spans(spark).persist())


def test_search(engine):
    out = json.loads(respond.search_response(engine, "{ status = error }", FROM, TO))
    assert [t["traceID"][0] for t in out["traces"]] == ["b"]
    assert out["traces"][0]["startTimeUnixNano"] == "1736938800000000000"
    assert out["metrics"] == {"inspectedTraces": 1, "inspectedSpans": 5}
    assert json.loads(respond.search_response(engine, '{ name = "none" }'))["traces"] == []


def test_tags(engine):
    assert [s["name"] for s in json.loads(respond.tags_v2(engine))["scopes"]] == ["intrinsic", "resource", "span"]
    assert json.loads(respond.tags_v2(engine, "resource"))["scopes"][0]["tags"] == ["deployment.environment", "host.name", "service.name", "service.version"]
    names = json.loads(respond.tags_v1(engine))["tagNames"]
    assert names == sorted(set(names)) and len(names) == 37
    assert json.loads(respond.tag_values(engine, "http.method"))["tagValues"][0] == {"type": "string", "value": "GET"}
    assert json.loads(respond.tag_values(engine, "nothing", v2=False)) == {"tagValues": []}


def test_metrics(engine):
    out = json.loads(respond.range_response(engine, "{ } | count_over_time() by (status)", FROM, TO, "1h"))["series"]
    assert {s["promLabels"] for s in out} == {f'{{status="STATUS_CODE_{x}"}}' for x in ("OK", "ERROR", "UNSET")}
    plain = json.loads(respond.range_response(engine, "{ } | rate()", FROM, TO, "3600"))["series"]
    assert [s["value"] for s in plain[0]["samples"]] == [4 / 3600, 22 / 3600]
    top = json.loads(respond.instant_response(engine, "{ } | count_over_time() by (resource.service.name)", FROM, TO))["series"]
    assert top[0]["labels"] == {"resource_service_name": "frontend"} and top[0]["value"] == 8
    s = json.loads(respond.summary_response(engine, "", ("service.name",), FROM, TO))["summaries"]
    assert sum(x["spanCount"] for x in s) == 26 and s[0]["series"][0]["key"] == "service_name"


def test_error():
    assert json.loads(respond.error(ValueError("no"))) == {"error": "no"}
