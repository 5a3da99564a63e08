import json

import pytest
from pyspark.sql import functions as F

from leadloom.plans import pipeline, policy
from leadloom.sources import company_pages, delimited, people_pages, synthetic
from leadloom.streaming import stages

HOME = """<!doctype html><title>Start | Fjordline Rowing Sheds</title><meta name="application-name" content="Fjordline">
<script type="application/ld+json">[{"@type": ["Thing", "LocalBusiness"], "industry": "Boat building", "address": {"@type": "PostalAddress", "addressLocality": "Molde"}}]</script>
<nav><a href="/kontakt-oss?ref=top">Skriv</a> <a href="about.html">Om</a> <a href="tel:123">T</a> <a href="https://contact.fjordline.example/x">elsewhere</a></nav>
<footer><a href="https://www.youtube.com/@fjordline">film</a><a href="mailto:SHED@fjordline.example?subject=hi">post</a></footer>"""
INNER = """<title>Om oss</title><meta property="og:description" content="Sheds for oars."><script type="application/ld+json">{"@type": "Corporation", "name": "Fjordline Naust AS",
 "numberOfEmployees": {"minValue": 12}, "sameAs": "https://github.com/fjordline"}</script><a href="https://youtube.com/other">x</a><a href="/kontakt-oss">self</a>"""


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿First Name;Email Address;Company;Zzz\nAda;a@b.io;Acme;1\n;;;2\nBob;;Bee;3\n".encode())
    rows = delimited.read(spark, str(p)).orderBy("seq").collect()
    assert [(r.first_name, r.email, r.company_name) for r in rows] == [("Ada", "a@b.io", "Acme"), ("Bob", None, "Bee")]
    assert json.loads(rows[0].raw) == {"First Name": "Ada", "Email Address": "a@b.io", "Company": "Acme", "Zzz": "1", "_row_number": 1} and json.loads(rows[1].raw)["_row_number"] == 3


def test_delimited_rows(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.csv").write_text('name,email\n\t Dee \t,d@x.io\n"open quote,e@x.io\nGil,g@x.io,extra\nHal\n"Jo ""JJ"" K, Jr",j@x.io\n')
    (p / "b.csv").write_text("name,email\nLou,l@x.io\n")
    rows = delimited.read(spark, str(p)).collect()
    assert sorted((r.full_name, r.email) for r in rows) == [("Dee", "d@x.io"), ("Gil", "g@x.io"), ("Hal", None), ('Jo "JJ" K, Jr', "j@x.io"), ("Lou", "l@x.io")]
    assert sorted(json.loads(r.raw)["_row_number"] for r in rows) == [1, 1, 3, 4, 5]
    assert [(r.row, r.reason) for r in delimited.rejected(spark, str(p)).collect()] == [(2, "quoting")]
    assert delimited.read(spark, str(p), limit=2).count() == 2
    (tmp_path / "m.csv").write_text('name;company\n"Mia\nMoe";Acme\n')
    assert [r.full_name for r in delimited.read(spark, str(tmp_path / "m.csv"), multi_line=True).collect()] == ["Mia\nMoe"]
    (tmp_path / "l.csv").write_bytes("name;company\nJürg;Bär\n".encode("latin-1"))
    assert [r.company_name for r in delimited.read(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").collect()] == ["Bär"]
    (tmp_path / "e.csv").write_text("")
    assert delimited.read(spark, str(tmp_path / "e.csv")).count() == 0


def test_people_pages(spark):
    page = {"people": [{"id": "7", "name": "Ada L", "phone_numbers": [{"raw_number": " "}, {"number": "123"}], "organization": {"domain": "acme.io", "estimated_num_employees": 12}}, None]}
    r = people_pages.to_raw(people_pages.people(spark.createDataFrame([(json.dumps(page),), ('{"people": []}',), ('{"people": [], "contacts": []}',)], "value string"))).collect()
    assert len(r) == 1 and r[0].phone == "123" and r[0].company_domain == "acme.io" and r[0].company_employee_count == "12" and r[0].source_url.endswith("/7")
    with pytest.raises(Exception, match="an object was expected"):
        people_pages.people(spark.createDataFrame([("[1]",)], "value string")).collect()
    far = spark.createDataFrame([((3_000_000 << 33) // 2 + 5, json.dumps(page))], "page_no long, value string")
    assert people_pages.to_raw(people_pages.people(far)).collect()[0].seq > 0


def test_company_pages(spark):
    rows = [
        (1, "http://www.fjordline.example/", HOME), (2, "https://fjordline.example/kontakt-oss", INNER), (3, "https://empty.example", None), (4, "not a url", HOME),
        (5, "https://links.example", "<a href='https://x.com/links'>x</a>"), (6, "https://paths.example", "<a href='/company/about-us'>c</a><a href='https://other.example/contact'>o</a>"), (7, "https://only.example/contact", "<a href='#contact'>self</a>"),
    ]
    got = {r.company_domain: r for r in company_pages.to_raw(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got) == {"fjordline.example", "links.example", "paths.example"}  # no fact, no record
    r = got["fjordline.example"]
    assert (r.company_name, r.email, r.company_employee_count, r.company_city, r.company_industry, r.company_description) == ("Fjordline Naust AS", "shed@fjordline.example", "12", "Molde", "Boat building", "Sheds for oars.")
    # The first page's film and the second page's code; the contact page is found by its path, and foremost by the first word.
    assert r.company_social_links == {"github": "https://github.com/fjordline", "youtube": "https://youtube.com/@fjordline"}
    assert r.company_contact_url == "https://fjordline.example/about.html"
    assert got["paths.example"].company_contact_url == "https://other.example/contact"
    assert company_pages.next_page(HOME, "https://fjordline.example") == "https://fjordline.example/about.html"
    assert company_pages.seed_urls(["Fjordline.example", "https://www.fjordline.example/x", "no host", "b.example:8080"]) == ["https://fjordline.example", "https://b.example"]


def test_scrub(spark):
    texts = ["<input name='csrf_token' value='abc123secret'>", "/x?api_key=K123456789&q=1", "Authorization: Bearer abcdefghijkl", "https://me:pass@h.example/", "plain text"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(company_pages.scrub(F.col("t")).alias("t"), company_pages.leaks(F.col("t"), ["K123456789"]).alias("leaks")).collect()
    assert [r.t for r in rows] == ["<input name='csrf_token' value='***'>", "/x?api_key=***&q=1", "Authorization: Bearer ***", "https://***@h.example/", "plain text"]
    assert [r.leaks for r in rows] == [False, True, True, False, False]


def test_pipeline_and_policy(spark):
    rules = policy.resolve(policy.from_environment({"LEAD_FILTER__MIN_COMPLETENESS": "0.9"}), {"min_completeness": 0.2, "exclude_domains": "acme1.example, acme2.example"}, {"require_email": "true"})
    assert rules.min_completeness == 0.2 and rules.exclude_domains == ("acme1.example", "acme2.example") and rules.require_email and rules.active
    result = pipeline.run({"a": lambda: synthetic.generate(spark, 120), "bad": lambda: spark.read.parquet("/no/such/file")}, rules)
    stats = result.stats()
    assert stats["n_raw"] == 120 == stats["n_valid"] + stats["n_invalid"] and stats["failed_sources"] == ["bad"]
    assert result.leads.count() == stats["after_dedup"] and stats["duplicates_removed"] > 0
    assert result.rejections.count() == stats["n_invalid"] + stats["n_filtered"] + stats["duplicates_removed"]


def test_stream(spark, tmp_path):
    rows = synthetic.generate(spark, 40).withColumn("collected_at", F.lit("2025-01-01T00:00:00Z").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stages.counts(stages.annotate(stream)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("counts").agg(F.sum("n_raw")).collect()[0][0] == 40
