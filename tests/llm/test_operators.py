import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("leadloom.llm")

LEAD = "seq long, provider string, external_id string, full_name string, first_name string, last_name string, email string, linkedin_url string, company_name string, company_domain string, company_website string, job_title string, phone string, company_city string, company_country string, company_industry string, seniority string, label string, side string, id string"
FIELDS = [x.split()[0] for x in LEAD.split(", ")]


def leads(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], LEAD)


def test_survivors(spark):
    from leadloom.llm import survivors

    person = "struct<" + ",".join(f"{f.split('.')[1]}:string" for f in survivors.FIELDS if f.startswith("person.")) + ">"
    company = "struct<" + ",".join(f"{f.split('.')[1]}:{'bigint' if f.endswith('count') else 'string'}" for f in survivors.FIELDS if f.startswith("company.")) + ">"
    ddl = f"record_id long, dup_group long, person {person}, company {company}, source struct<provider:string,collected_at:timestamp,sources:array<string>>, completeness double, survivor string"
    np = len([f for f in survivors.FIELDS if f.startswith("person.")])
    nc = len(survivors.FIELDS) - np

    def rec(i, g, c, at=None, sources=None, city=None, email=None):
        from datetime import datetime

        p, co = [None] * np, [None] * nc
        p[5], co[6] = email, city
        return (i, g, tuple(p), tuple(co), ("p", at and datetime.fromisoformat(at), sources), c, "x")

    rows = [
        rec(1, 1, 0.5), rec(2, 1, 0.500000001, "2025-01-01"), rec(3, 1, None, "2026-01-01"), rec(4, 2, 0.5, None, ["a", "a", " ", None]), rec(5, 2, 0.5, None, ["a", "b"]), rec(6, 3, 0.9), rec(7, None, 0.9), rec(8, None, 0.9),
        rec(9, 4, float("nan")), rec(10, 4, None), rec(11, 5, 0.5, city="Leeds", sources=["s1"]), rec(12, 5, 0.4, city="Leeds", sources=["s2"], email="X@y.z"), rec(13, 5, 0.3, city="Lds", sources=["s3"]),
    ]
    best, quality = survivors.fuse(spark.createDataFrame(rows, ddl))
    got = {r.dup_group: r for r in best.collect()}
    assert {g: r.record_id for g, r in got.items()} == {1: 2, 2: 5, 4: 9, 5: 11}
    assert got[5].fields["company.city"] == "Leeds" and got[5].fields["person.email"] == "X@y.z" and got[1].fields is None
    assert quality.count() > 0
    assert survivors.fuse(spark.createDataFrame([], ddl))[0].count() == 0


def test_survivors_keep_links_and_raw_title(spark):
    from leadloom.llm import survivors

    person = "struct<first_name:string,last_name:string,full_name:string,job_title:string,job_title_raw:string,seniority:string,email:string,phone:string,linkedin_url:string>"
    company = "struct<name:string,domain:string,website:string,industry:string,employee_count:bigint,country:string,city:string,linkedin_url:string,description:string,contact_url:string,social_links:map<string,string>>"
    ddl = f"record_id long, dup_group long, person {person}, company {company}, source struct<provider:string,collected_at:timestamp,sources:array<string>>, completeness double"
    rec = lambda i, c, title, links: (i, 1, (None,) * 4 + (title,) + (None,) * 4, (None,) * 10 + (links,), ("p", None, ["s"]), c)
    best = survivors.fuse(spark.createDataFrame([rec(1, 0.9, None, None), rec(2, 0.5, "CTO @ Acme", {"X": "https://x.example/a", "blog": " "})], ddl))[0].collect()
    assert best[0].record_id == 1 and best[0].fields["person.job_title_raw"] == "CTO @ Acme"
    assert best[0].kept["company.social_links"] == ["x\u0001https://x.example/a"]


def test_cascade(spark):
    from leadloom.llm import cascade

    raw = leads(
        spark, dict(seq=1, full_name="Ada Lovelace", company_domain="acme.example", email="ada@acme.example"), dict(seq=2, full_name="Grace Hopper", company_domain="acme.example"), dict(seq=3, full_name="Katherine Jonson", company_name="Acme Ltd"),
        dict(seq=4, full_name="Grace Hopper", company_domain="other.example"), dict(seq=5), dict(seq=None, full_name="X Y"), dict(seq=6, full_name="A. Lovelace", company_domain="acme.example"),
    )
    extra = [dict(seq=50 + i, company_name="Acme Ltd", company_domain="acme.example") for i in range(3)]
    directory = leads(spark, dict(seq=100, full_name="Lovelace, Ada", company_domain="go.acme.invalid", email="<ADA@acme.example>"), dict(seq=101, full_name="HOPPER Grace", company_domain="acme.example"), dict(seq=102, full_name="Kathy Johnson", company_name="Acme"), dict(seq=103), *extra)
    got = {(r.raw_seq, r.directory_seq): r for r in cascade.match(raw, directory).collect()}
    assert set(got) == {(1, 100), (2, 101), (3, 102), (6, 100)}
    assert all(0 < r.confidence < 1 for r in got.values())
    assert cascade.match(raw, directory.limit(0)).count() == 0


def test_cascade_initial_of_one_person(spark):
    from leadloom.llm import cascade

    at = dict(company_domain="acme.example")
    raw = leads(spark, dict(seq=1, full_name="R. Smith", **at), dict(seq=2, full_name="K. Jonson", **at), dict(seq=3, full_name="A. Weber", **at), dict(seq=4, full_name="D. Moss", **at))
    directory = leads(
        spark, dict(seq=100, full_name="Robert Smith", **at), dict(seq=101, full_name="Bob Smith", **at), dict(seq=102, full_name="Katherine Jonson", **at), dict(seq=103, full_name="Kathrine Jonson", **at),
        dict(seq=104, full_name="Alexander Weber", **at), dict(seq=105, full_name="Alexandra Weber", **at), dict(seq=106, full_name="Alex Weber", **at), dict(seq=107, full_name="Dan Moss", **at), dict(seq=108, full_name="Dora Moss", **at),
    )
    got = {(r.raw_seq, r.directory_seq) for r in cascade.match(raw, directory).collect()}
    assert got == {(1, 100), (1, 101), (2, 102), (2, 103)}


def test_cascade_links_resolved_records(spark):
    from leadloom.llm import cascade

    at = dict(company_domain="acme.example")
    page = "https://linkedin.example/in/"
    # One person: 1-100 by mailbox, 2-101 by profile, 1-101 by a typing error only. Two persons: 3-102 and 4-103, each by whole name.
    raw = leads(
        spark, dict(seq=1, full_name="Anna Martin", email="anna@acme.example", **at), dict(seq=2, full_name="A. M. Marrtn", linkedin_url=page + "am-1", **at),
        dict(seq=3, full_name="Paul Hansen", **at), dict(seq=4, full_name="Paul Hanson", **at),
    )
    directory = leads(
        spark, dict(seq=100, full_name="Q. Other", email="anna@acme.example", **at), dict(seq=101, full_name="Anna Matin", linkedin_url=page + "am-1", **at),
        dict(seq=102, full_name="Paul Hansen", **at), dict(seq=103, full_name="Paul Hanson", **at),
    )
    got = {(r.raw_seq, r.directory_seq) for r in cascade.match(raw, directory).collect()}
    assert got == {(1, 100), (1, 101), (2, 100), (2, 101), (3, 102), (4, 103)}


def test_canon(spark):
    from leadloom.llm import canon

    entries = spark.createDataFrame([(1, "job_title", "VP of Sales"), (2, "job_title", "Software Engineer"), (3, "job_title", "Senior Software Engineer"), (9, "company_country", "United Kingdom"), (9, "company_country", "United Kingdom")], "canon_id int, field string, canonical string")
    values = ["V.P. Sales @ Acme", "VP of Sales", "Seinor Software Enginer", "Softwareentwickler", "Tea Wrangler", "N/A", None, "  ", "Vice-President of Slaes", "x" * 20_000, "VP of Sales"]
    df = leads(spark, *[dict(seq=i, job_title=v) for i, v in enumerate(values)], dict(seq=50, company_country="Country: U.K."), dict(seq=51, company_country="Atlantis"), dict(seq=52, seniority="vp"))
    got = {(r.seq, r.field): r.canon_id for r in canon.match(df, entries).collect()}
    assert got == {(0, "job_title"): 1, (2, "job_title"): 3, (3, "job_title"): 2, (4, "job_title"): 0, (8, "job_title"): 1, (9, "job_title"): 0, (50, "company_country"): 9, (51, "company_country"): 0, (52, "seniority"): 0}
    assert canon.match(df.limit(0), entries).count() == 0
    aliases = spark.createDataFrame([("job_title", "Software Engineer", "Code-Wrangler"), ("company_country", "United Kingdom", "Blighty"), ("x", "y", "z"), ("job_title", None, "q")], "field string, canonical string, alias string")
    got = {(r.seq, r.field): r.canon_id for r in canon.match(leads(spark, dict(seq=1, job_title="code wrangler"), dict(seq=2, company_country="blighty")), entries, aliases=aliases).collect()}
    assert got == {(1, "job_title"): 2, (2, "company_country"): 9}


def test_components(spark):
    from leadloom.llm import components

    rnd = random.Random(3)
    keyed = [(rnd.randrange(300), f"k{rnd.randrange(260)}") for _ in range(330)] + [(1000 + i, f"c{i}") for i in range(60)] + [(1001 + i, f"c{i}") for i in range(60)] + [(i, "hot") for i in range(2000, 2400)] + [(None, "k1"), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, k in keyed:
        if i is not None and k is not None:
            parent[find(i)] = find(k)
    ids = {i for i, k in keyed if i is not None and k is not None}
    least = {}
    for i in sorted(ids):
        least.setdefault(find(i), i)
    want = {i: least[find(i)] for i in ids}
    df = spark.createDataFrame(keyed, "id long, key string")
    assert {r.id: r.label for r in components.group(df, rounds=2).collect()} == want  # the long chain is contracted
    chain = spark.createDataFrame([(i + j, f"c{i}") for i in range(1, 9) for j in (0, 1)] + [(50, "z"), (51, "z")], "id long, key string")
    for rounds in (1, 100):  # contracted at once, and walked to its end
        assert {r.id: r.label for r in components.group(chain, rounds=rounds).collect()} == {**{i: 1 for i in range(1, 10)}, 50: 50, 51: 50}
    rows = leads(spark, dict(seq=1, email="Jo <jo@x.example>", provider="p", external_id="0"), dict(seq=2, email="JO@X.EXAMPLE"), dict(seq=3, email="info@x.example"), dict(seq=4, email="info@x.example"), dict(seq=5, provider="p", external_id="0"), dict(seq=2, email="jo@x.example"), dict(seq=6, linkedin_url="https://linkedin.example/company/x"), dict(seq=7))
    assert {tuple(r) for r in components.lead_groups(rows).collect()} == {(1, 2)}


def test_mojibake(spark):
    from leadloom.llm import mojibake

    rnd = random.Random(1)
    cities = ["München", "Málaga", "Genève", "Köln", "Łódź", "São Paulo", "Ãtria", "Leeds", "Bremen"]
    rows = [dict(seq=i, company_city=rnd.choice(cities)) for i in range(400)]
    bad = {1000: ("MÃ¼nchen", "München"), 1001: ("GenÃƒÂ¨ve", "Genève"), 1002: ("K�ln", None), 1003: ("Mбlaga", "Málaga"), 1004: ("┼ü├│d┼║", "Łódź")}
    rows += [dict(seq=k, company_city=v) for k, (v, _) in bad.items()] + [dict(seq=2000), dict(seq=2001, company_city=""), dict(seq=2002, company_city="a" * 5000)]
    got = {r.seq: r.restored for r in mojibake.garbled(leads(spark, *rows)).collect()}
    assert got == {k: want for k, (_, want) in bad.items()}
    assert mojibake.garbled(leads(spark, dict(seq=1))).count() == 0


def test_companies_by_host(spark):
    from leadloom.llm import people

    hosts = ["foo.co.uk", "https://www.bar.co.uk/x", "acme.com.au", "acme.com", "go.acme.de", "MAIL.Acme.example", "acme.invalid", "N/A", "not a domain", "t.co", None, "x@shop.acme.de"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(people.host_key("h")).collect()]
    assert got == ["foo.co.uk", "bar.co.uk", "acme.com.au", "acme.com", "acme.de", "acme", "acme", None, None, "t.co", None, "acme.de"]
    # One name at .com and .de is one company; another company of the same label is not.
    rows = leads(
        spark, dict(id="1", side="l", company_name="Acme Tools GmbH", company_domain="acme.com"), dict(id="2", side="l", company_name="Acme Tools", company_domain="acme.de"),
        dict(id="3", side="l", company_name="Acme Bakery", company_domain="acme.co.uk"), dict(id="4", side="l", company_name="Foo", company_domain="foo.co.uk"), dict(id="5", side="l", company_name="Bar", company_domain="bar.co.uk"),
        dict(id="6", side="l", company_name="Acme Tolls"), dict(id="7", side="l", company_name="Nobody"), dict(id="8", side="l", full_name="Ann Lee", email="ann@acme.de", linkedin_url="linkedin.example/in/ann"),
        dict(id="9", side="l", full_name="Ann Lee", linkedin_url="linkedin.example/in/ann"),
    )
    f = people.forms(people.taken(rows.withColumn("id", F.col("id").cast("long")), "id", "l"))
    company = {r.id: r.company for r in f.collect()}
    assert company[1] == company[2] == company[6] == company[8] == company[9] and len({company[i] for i in (1, 3, 4, 5, 7)}) == 5 and company[7] == "?nobody"


def test_company_names_by_suffix(spark):
    from leadloom.llm import people

    known = spark.createDataFrame([("gryrodratti foods", "g", 3), ("zabreley systems", "z", 3), ("gryrodatta motors", "q", 2)], "company_words string, label string, n long")
    rest = spark.createDataFrame([("gryrodrati foods",), ("zabreley systms ab",), ("gryphon foods",)], "company_words string")
    assert {tuple(r) for r in people._by_suffix(rest, known).collect()} == {("gryrodrati foods", "g"), ("zabreley systms ab", "z")}


def test_planted_qualities(spark):
    from leadloom.llm import survivors

    rnd = random.Random(11)
    planted = {"a": (0.9, 0.8), "b": (0.7, 0.95), "c": (0.8, 0.6), "all": (1.0, 0.0)}
    rows, n = [], 0
    for g in range(2_500):
        for k in range(3):
            true = rnd.random() < 0.6
            by = sorted(s for s, (sens, spec) in planted.items() if rnd.random() < (sens if true else 1 - spec))
            rows.append((f"{g}-{k}", "person.email", by, sorted(planted), 3, 1.0))
            n += true
    patterns = spark.createDataFrame(rows, "pattern string, field string, by array<string>, cover array<string>, n_values long, n double")
    merged = patterns.groupBy(F.concat_ws(",", "by").alias("pattern"), "field", "by", "cover", "n_values").agg(F.sum("n").alias("n"))
    _, q = survivors.quality(merged, iterations=30)
    for r in q.collect():
        sens, spec = planted[r.source]
        assert abs(r.sensitivity - sens) < 0.05 and abs(r.specificity - spec) < 0.05, r


def test_variants(spark):
    from leadloom.llm import variants

    rows = leads(
        spark, dict(seq=1, full_name="Maximilian Krudroraro", company_domain="acme.example"), dict(seq=2, full_name="KRUDRORARO Max", company_domain="www.acme.example"), dict(seq=3, full_name="Maximilian Krudrorraro, MBA", company_domain="acme.example"),
        dict(seq=4, full_name="Chiara Krudroraro", company_domain="acme.example"), dict(seq=5, full_name="Maximilian Krudroraro", company_domain="other.example"), dict(seq=6, full_name="M. Krudroraro", company_domain="acme.example"),
        dict(seq=7, company_domain="acme.example"), dict(seq=8, company_website="http://acme.example/x"), dict(seq=9, full_name="SUPPORT", company_domain="acme.example"), dict(seq=10), dict(seq=None), dict(seq=1, full_name="Maximilian Krudroraro", company_domain="acme.example"),
    )
    got = {tuple(r) for r in variants.link(rows).collect()}
    people = [1, 2, 3, 6]
    assert got == {(a, b) for a in people for b in people if a < b} | {(7, 8)}
    assert variants.link(rows.limit(0)).count() == 0
    many = spark.range(30).select(F.col("id").alias("seq"), F.lit("t").alias("thing"))
    assert variants.row_pairs(many, chunk=4).distinct().count() == variants.row_pairs(many, chunk=4).count() == 435


def test_variants_of_any_letter(spark):
    from leadloom.llm import variants

    at = dict(company_domain="acme.example")
    names = ["Anna Martin", "Anna Matin", "Paul Fischer", "Paul Ficher", "Rosa Berg"]
    got = {tuple(r) for r in variants.link(leads(spark, *[dict(seq=i, full_name=n, **at) for i, n in enumerate(names)])).collect()}
    assert got == {(0, 1), (2, 3)}


def test_variants_in_large_blocks(spark, monkeypatch):
    from leadloom.llm import variants

    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abdegiklmnoprstu") for _ in range(n))
    surs = [word(n) for n in range(4, 18) for _ in range(3)]
    for s in surs[:]:  # one letter or two changed, anywhere
        for k in (1, 2):
            t = list(s)
            for _ in range(k):
                t[rnd.randrange(len(t))] = rnd.choice("abdegi")
            surs.append("".join(t))
    number = lambda i: i.to_bytes(2, "big")
    forms = spark.createDataFrame([(number(i), "acme", "rosa", s, ["rosa"]) for i, s in enumerate(surs)], "form binary, company string, given string, skel string, alts array<string>")
    want = {(number(i), number(j)) for i, a in enumerate(surs) for j, b in enumerate(surs) if i < j and variants.ratio(a, b) >= variants.RATIO}
    for size in (1, 10_000):  # every suffix refined, and none
        monkeypatch.setattr(variants, "REFINE", size)
        assert want <= {(bytes(r.a), bytes(r.b)) for r in variants.candidates(forms).collect()}
    # A common surname: the given name's first letter is wrong once, in a company of many forms.
    rows = [dict(seq=i, full_name=f"{word(6)} Hansen", company_domain="acme.example") for i in range(80)] + [dict(seq=100 + i, full_name="Barbara Hansen", company_domain="acme.example") for i in range(12)]
    got = {tuple(r) for r in variants.link(leads(spark, *rows, dict(seq=200, full_name="Narbara Hansen", company_domain="acme.example"))).collect()}
    assert (100, 200) in got


def test_tokens(spark):
    tiktoken = pytest.importorskip("tiktoken")
    from leadloom.llm import tokens

    assert tiktoken
    rnd = random.Random(2)
    texts = [None, "", " ", "Hi there", "<|endoftext|>", "a" * 300, "\n\n  x  " * 40, "it's we'll I'd " * 30, "日本語テキスト" * 40, "".join(rnd.choice("ab 1'\n  é!") for _ in range(3000)), " ".join("word%d" % i for i in range(500))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "Hi there", "x")], "doc_id long, text string, ids string")
    plain = tokens.encoding("byte_bpe_50k", tokens.TOKENIZERS)
    for chunk, overlap in ((65_536, 2_048), (64, 16), (100, 100)):
        got = tokens.encode(df, chunk=chunk, overlap=overlap).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            assert r.ids == plain.encode_ordinary(texts[r.doc_id] or "")
    assert tokens.decode(plain.encode_ordinary(texts[8])) == texts[8]
    # Texts of several chunks at the production sizes: one with boundaries everywhere, one with none in the overlap.
    long = [" ".join(f"Wörter{i} it's {i * 7}" for i in range(14_000)), "a" * 150_000, "x" * 65_536 + " y", "é" * 65_537]
    got = {r.doc_id: r.ids for r in tokens.encode(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()}
    assert all(len(t) > tokens.CHUNK_CHARS and got[i] == plain.encode_ordinary(t) for i, t in enumerate(long))
    assert tokens.encode(df.limit(0)).count() == 0


def test_mixing(spark):
    pytest.importorskip("tiktoken")
    from leadloom.llm import mixing

    docs = spark.createDataFrame([(i, "some words here " * (1 + i % 7), "ab"[i % 2] if i % 11 else "c", 1) for i in range(600)] + [(900, None, "a", 1), (901, "", "a", 1), (902, "z", None, 1), (903, "z", "unlisted", 1)], "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    rows, shares = mixing.mix(docs, targets)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"a", "b", "c", "none"} and got["none"].reached_share == 0
    for s in "abc":
        assert abs(got[s].reached_share - {"a": 0.4, "b": 0.3, "c": 0.2}[s] / 0.9) < 0.01 and got[s].most_repeats <= got[s].max_repeats
    assert rows.agg(F.sum("n_tokens")).collect()[0][0] == sum(r.mix_tokens for r in got.values())
    assert {r.source for r in rows.select("source").distinct().collect()} == {"a", "b", "c"}
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_pii(spark):
    from leadloom.llm import pii

    texts = ["CALLER: you can mail me, it is selma.brerosanen@mogezalo.example.", None, "", " \n", "Ticket #340286 stays with the data desk until June.", "Call the front desk: +44.770.090.0194. Visit us at 174 Quillhollow St., Port Birch Heath 96744. The board is chaired by Ravi Drustoberg."]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {(r.doc_id, r.kind, r.start_pos) for r in pii.listed(df).collect()}
    assert (0, "email", 32) in got and (5, "phone", 22) in got and (5, "address", texts[5].index("174") + 1) in got and (5, "name", texts[5].index("Ravi") + 1) in got
    assert not any(d in (1, 2, 3, 4) for d, _, _ in got)
    masked = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert masked[0] == "CALLER: you can mail me, it is [EMAIL]." and masked[1] is None and masked[2] == "" and masked[4] == texts[4]
    net = pii.network(str(pii.WEIGHTS))
    long = (texts[5] + " ") * 40
    spans = pii.mentions(long, net.tag([long])[0])
    assert sum(k == "phone" for _, _, k in spans) == 40  # windows overlap, mentions come out once
    assert pii.listed(df.limit(0)).count() == 0
