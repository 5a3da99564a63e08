import random

from leadloom.operators import dedup, normalize, qualify, rank, validate
from leadloom.schema import conform
from leadloom.sinks import files

DDL = "seq long, provider string, external_id string, full_name string, email string, phone string, company_name string, company_domain string, job_title string"


def raw(spark, rows):
    return conform(spark.createDataFrame(rows, DDL))


def test_record(spark):
    rows = [(1, "csv", "e1", "ADA LOVELACE", "Ada <ada@acme.com>", "0044 20 1234567", "ACME Ltd", None, "CTO at Acme"), (2, None, None, None, None, None, None, None, None), (3, "csv", None, "SUPPORT", "bad", None, "X", "no domain", None)]
    df = qualify.qualify(validate.validate(normalize.normalize(raw(spark, rows))), qualify.Rules(min_completeness=0.5))
    a, b, c = df.orderBy("seq").collect()
    assert a.person.full_name == "Ada Lovelace" and a.person.job_title == "CTO" and a.person.seniority == "c_suite" and a.company.domain == "acme.com" and a.completeness == 0.85 and a.valid and a.failed is None
    assert a.person.first_name == "Ada" and a.person.last_name == "Lovelace" and len(a.lead_id) == 16
    assert b.rules == ["no_identity", "no_company_signal"] and not b.valid and b.source.provider == "unknown"
    assert c.rules == ["non_person_name", "invalid_email", "invalid_domain"] and c.failed.rule == "min_completeness"
    assert rank.rejections(df).count() == 2 and rank.stage_counts(df).collect()[0].n_invalid == 2


def test_greedy_dedup_equals_scan(spark):
    rnd = random.Random(5)
    pick = lambda *v: rnd.choice([None, *v])
    rows = [(i, "p", pick("1", "2", "3", "4"), pick("Ann B", "Cy D", "Eve F"), pick("a@x.io", "b@x.io", "c@y.io", "d@z.io"), pick("+123456789", "+987654321"), pick("Aa", "Bb"), pick("x.io", "y.io"), None) for i in range(60)]
    std = normalize.normalize(raw(spark, rows), unicode=False).cache()
    plain = [r.asDict(recursive=True) for r in std.orderBy("seq").collect()]
    for strategy, merge in (("identity", False), ("aggressive", True)):
        want, pairs = dedup.scan([dict(r, person=dict(r["person"]), company=dict(r["company"]), source=dict(r["source"])) for r in plain], dedup.STRATEGIES[strategy], merge)
        kept, found = dedup.deduplicate(std, strategy, merge)
        show = lambda r: (r["lead_id"], r["person"]["email"], r["person"]["phone"], r["company"]["domain"], tuple(r["source"]["sources"]))
        assert sorted(map(repr, (show(r.asDict(recursive=True)) for r in kept.collect()))) == sorted(map(repr, map(show, want)))
        assert sorted((r.seq, r.matched_key) for r in found.collect()) == sorted((p["seq"], p["matched_key"]) for p in pairs)
    assert dedup.deduplicate(std, "none")[0].count() == 60


def test_dedup_names_of_any_script(spark):
    same = [("Анна Иванова", "Анна Иванова"), ("山田太郎", "山田太郎"), ("Nguyễn Văn Đức", "Nguyen Van Duc")]
    rows = [(10 * i + j, "p", None, name, None, None, "Acme", f"d{i}.io", None) for i, pair in enumerate(same) for j, name in enumerate(pair)]
    kept, pairs = dedup.deduplicate(normalize.normalize(raw(spark, rows)), "aggressive", unicode=True)
    assert sorted(r.seq for r in kept.collect()) == [0, 10, 20]
    assert sorted((r.seq, r.matched_key) for r in pairs.collect()) == [(1, "name_domain"), (11, "name_domain"), (21, "name_domain")]


def test_exports(spark, tmp_path):
    std = normalize.normalize(raw(spark, [(1, "csv", "1", "Đặng", "a@b.io", None, "C", None, None)]))
    assert files.write_csv(std, tmp_path / "x.csv") == 1
    body = (tmp_path / "x.csv").read_bytes()
    assert body.startswith(b"\xef\xbb\xbflead_id,person_first_name") and "Đặng".encode() in body and body.count(b"\n") == 2
    assert files.write_csv(std.limit(0), tmp_path / "y.csv") == 0 and (tmp_path / "y.csv").read_bytes().count(b"\n") == 1
    assert files.write_jsonl(std, tmp_path / "x.jsonl") == 1 and files.write_json(std, tmp_path / "x.json") == 1
    import json

    assert json.loads((tmp_path / "x.json").read_text())[0]["person"]["full_name"] == "Đặng"
