import io
import json
import logging

import pytest

from leadloom import cli, secrets, settings
from leadloom.errors import BadConfig, Denied, SourceFailure, Throttled, Unreachable
from leadloom.functions.numbers import band
from leadloom.plans import policy, searches
from leadloom.sources import fetch, live, registry


def test_people_search(spark):
    s = settings.PeopleSearch(api_key=settings.Secret("key-123456"), per_page=5)
    http = settings.Http(initial_backoff=0.001)
    read = lambda **kw: live.people(spark, s, {"person_titles": ["CTO"]}, http=http, opener="tests.offline:people", **kw)
    pages = {r.page_no: len(json.loads(r.value)["people"]) for r in read().collect()}
    assert pages == {1: 5, 2: 5, 3: 5, 4: 5, 5: 3}  # the short page is the last one
    assert {r.page_no for r in read(pages_per_task=2).collect()} == set(range(1, 6))
    rows = registry.source("people_search")(spark, settings=s, criteria={}, limit=7, http=http, opener="tests.offline:people").collect()
    assert [r.full_name for r in sorted(rows, key=lambda r: r.seq)] == [f"Person {i}" for i in range(7)]
    with pytest.raises(Denied):
        live.people(spark, settings.PeopleSearch(), {})
    with pytest.raises(Exception, match="HTTP 401"):
        live.people(spark, settings.PeopleSearch(api_key=settings.Secret("wrong-key-1")), {}, opener="tests.offline:people").collect()


def test_company_sites(spark):
    w = settings.Website(urls=("one.example", "www.one.example", "closed.example", "gone.example"), max_pages_per_site=2, request_delay=0.0)
    http = settings.Http(initial_backoff=0.001)
    assert sorted(r.url for r in live.sites(spark, w, http=http, opener="tests.offline:site").collect()) == ["https://one.example", "https://one.example/contact"]
    r = registry.source("company_site")(spark, settings=w, http=http, opener="tests.offline:site").collect()
    assert [(x.company_name, x.email, x.company_description) for x in r] == [("One Ltd", "hi@one.example", None)]
    with pytest.raises(BadConfig):
        live.sites(spark, settings.Website())


def test_client():
    answers, slept = [], []
    client = fetch.Client("s", "https://h.example", opener=lambda *a: answers.pop(0), sleep=slept.append)
    answers[:] = [(503, {}, b""), (429, {"retry-after": "90"}, b""), (200, {}, b"{}")]
    assert client.json("GET", "/x") == {} and slept[1] == 60.0 and 0.5 <= slept[0] <= 0.625
    for status, kind in ((403, Denied), (404, SourceFailure), (500, Unreachable), (429, Throttled)):
        answers[:] = [(status, {}, b"why")] * 3
        with pytest.raises(kind):
            client.request("GET", "/x")
    with pytest.raises(SourceFailure):
        client.request("GET", "file:///etc/passwd")
    now = [0.0]
    manners = fetch.Manners(fetch.Client("s", opener=lambda *a: (404, {}, b""), sleep=lambda s: now.__setitem__(0, now[0] + s)), delay=2.0, clock=lambda: now[0])
    assert manners.allowed("https://a.example/x")  # no robots.txt allows everything
    manners.wait("https://a.example/x")
    assert now[0] == 2.0
    manners.wait("https://b.example/x")
    assert now[0] == 2.0


def test_bands_and_searches(tmp_path):
    assert [band(x) for x in ("201-500", "201 – 500", "1 to 10", "1,10", "1k-2k", "500-201", "12", None, "a-b")] == [(201, 500), (201, 500), (1, 10), (1, 10), (1000, 2000), None, None, None, None]
    s = searches.search({"titles": [" CTO ", "CTO", ""], "employee_ranges": ["51-200", "1-50"], "keywords": ["pay", " ments "]})
    assert s.titles == ("CTO",) and s.employee_ranges == ("1,50", "51,200") and s.keywords == "pay ments" and not s.empty and searches.search({}).empty
    for bad in ({"employee_ranges": ["1-50", "50-60"]}, {"employee_ranges": ["x"]}, {"nope": 1}, {"titles": "CTO"}):
        with pytest.raises(BadConfig):
            searches.search(bad)
    base = settings.PeopleSearch(person_titles=("CEO",), person_seniorities=("c-suite",), include_similar_titles=True)
    got = searches.criteria(base, searches.search({"titles": ["CTO"], "similar_titles": False}))
    assert got["person_titles"] == ["CTO"] and got["person_seniorities"] == ["c_suite"] and got["include_similar_titles"] is False
    with pytest.raises(BadConfig):
        searches.criteria(settings.PeopleSearch(person_seniorities=("boss",)))
    a, b = tmp_path / "s.json", tmp_path / "f.json"
    a.write_text('{"Nordic Tech": {"titles": ["CTO"]}}')
    b.write_text('{"nordic-tech": {"min_completeness": 0.5}, "other": {"min_employees": 9, "max_employees": 1}}')
    both = searches.strategy("NORDIC tech", a, b)
    assert both.search.titles == ("CTO",) and both.filters == {"min_completeness": 0.5}
    assert searches.halves(searches.load(a), policy.load_profiles(b)) == {"nordic_tech": ("search", "filters"), "other": ("filters",)}
    for name in ("none", "other"):
        with pytest.raises(BadConfig):
            searches.strategy(name, a, b)


def test_settings():
    s = settings.load({"LEAD_PEOPLE__API_KEY": "key-123456", "LEAD_OUTPUT_FORMATS": '["csv", "jsonl", "csv"]', "LEAD_HTTP__MAX_ATTEMPTS": "5", "lead_write_run_report": "no"}, file="/nowhere")
    assert s.people.api_key == "key-123456" and s.output_formats == ("csv", "jsonl") and s.http.max_attempts == 5 and not s.write_run_report and "key" not in repr(s.people.api_key)
    for bad in ({"PEOPLE_API_KEY": "x"}, {"LEAD_HTTP_TIMEOUT": "3"}, {"LEAD_MIN_COMPLETENESS": "2"}, {"LEAD_DEFAULT_LIMIT": "many"}, {"LEAD_LOG_FORMAT": "xml"}, {"LEAD_SORT_BY_COMPLETENESS": "maybe"}):
        with pytest.raises(BadConfig):
            settings.load(bad, file="/nowhere")
    settings.load({"HTTP_TIMEOUT": "3", "LEAD_HTTP__TIMEOUT": "4"}, file="/nowhere")  # both: the right one is read


def test_secrets():
    secrets.forget()
    secrets.register(secrets.held_by(settings.load({"LEAD_PEOPLE__API_KEY": "key-123456"}, file="/nowhere")) + ["short", None, "key-123456-longer"])
    assert secrets.masked("a key-123456-longer b key-123456 short") == "a *** b *** short" and secrets.masked(5) == 5
    out = io.StringIO()
    for style in ("console", "json"):
        secrets.set_up("info", style, out)
        logging.getLogger("leadloom.x").info("sent %s", "key-123456", extra={"url": "https://h/?k=key-123456"})
    first, second = out.getvalue().splitlines()
    assert "key-123456" not in out.getvalue() and first.endswith("INFO leadloom.x: sent *** url=https://h/?k=***") and json.loads(second)["url"] == "https://h/?k=***"
    secrets.forget()


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "f.json").write_text('{"strict": {"min_completeness": 0.9}}')
    assert cli.main(["--list-formats"]) == 0 and "jsonl" in capsys.readouterr().out
    assert cli.main(["--profiles", "f.json", "--list-profiles"]) == 0 and "strict (filters)" in capsys.readouterr().out
    for bad in (["--format", "xml"], ["--source", "nope"], ["--profile", "nope"], ["--set", "nope=1"]):
        assert cli.main([*bad, "--out", "o"]) == 2
    (tmp_path / "file").write_text("")
    assert cli.main(["--out", "file/x"]) == 2
    assert cli.main(["--source", "csv", "--path", "/no/such", "--out", "o"]) == 3
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    code = cli.main(["--source", "synthetic", "--limit", "40", "--format", "csv,jsonl", "--out", "o", "--max-leads", "5", "--exclude-domain", "acme1.example", "--require-email"])
    out = capsys.readouterr().out
    assert code == 0 and "40 records" in out and "first leads:" in out
    report = json.loads(next((tmp_path / "o").glob("leads_report_*.json")).read_text())
    assert report["stats"]["n_exported"] == 5 and {"summary", "run", "stats", "deduplication", "sources", "rejections", "outputs"} <= set(report) and report["stats"]["total_rejected"] == len(report["rejections"])
