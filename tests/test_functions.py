import pytest
from pyspark.sql import functions as F

from leadloom.functions import labels, numbers, text, urls


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("f", "pairs"),
    [
        (text.clean_text, [("  a  b ", "a b"), ("N/A", None), ("a\tb", "ab"), ("", None), (None, None), ("unknown", None), ("x​", "x")]),
        (lambda c: text.titlecase(text.clean_text(c)), [("ADA O'NEILL", "Ada O'Neill"), ("MARY-JANE McDonald", "Mary-Jane McDonald"), ("IBM", "Ibm"), ("3M", "3m"), ("GmbH", "GmbH"), (None, None)]),
        (lambda c: text.normalize_email(text.clean_text(c)), [("mailto:A@B.COM", "a@b.com"), ("Ada <ada@x.io>", "ada@x.io"), ("a@b", None), ("<a@b.c", None), ("a@b.com.", "a@b.com"), ("a b@c.d", None)]),
        (lambda c: text.normalize_phone(text.clean_text(c)), [("0039 02 1234", "+39021234"), ("(415) 555-0142", "4155550142"), ("+1 (415) 555", "+1415555"), ("12-34", None), ("+00123456789", "+123456789")]),
        (lambda c: text.strip_title_suffix(text.clean_text(c)), [("CEO at Acme", "CEO"), ("VP @ X Y", "VP"), ("Cat Sitter", "Cat Sitter")]),
        (lambda c: urls.normalize_domain(text.clean_text(c)), [("https://www.Acme.com:8080/x?y", "acme.com"), ("a@b.co.uk", "b.co.uk"), ("localhost", None), ("not a domain", None), ("10.0.0.1", "10.0.0.1"), ("u:p@h.io/x", "h.io")]),
        (lambda c: urls.normalize_page(text.clean_text(c)), [("mailto:a@acme.com", None), ("acme.com:8080/c/", "https://acme.com/c"), ("http://A.com//t/?utm_x=1&b=2&B=3&a=1#z", "https://a.com/t?b=2&a=1"), ("javascript:void(0)", None), ("acme.com?x=1", "https://acme.com")]),
        (lambda c: urls.normalize_profile(text.clean_text(c), "person"), [("de.linkedin.com/pub/Ada?x=1", "https://www.linkedin.com/in/ada"), ("linkedin.com/company/x", None), ("x", None)]),
        (numbers.parse_employee_count, [("1,200", 1200), ("201-500", 201), ("1.2k", 1200), ("1000+", 1000), ("approx. 250", 250), ("-5", None), ("two", None), ("7 to 9", 7), ("~12 staff", 12)]),
        (lambda c: labels.normalize_country(text.clean_text(c)), [("usa", "US"), ("Deutschland", "DE"), ("sg", "SG"), ("Atlantis", "Atlantis"), ("The Netherlands", "NL")]),
        (labels.coerce_seniority, [("C-Suite", "c_suite"), ("head", "director"), ("Vice President", "vp"), ("zzz", "unknown")]),
        (labels.infer_seniority, [("Vice President, X", "vp"), ("Vice-President", "c_suite"), ("President", "c_suite"), ("Developer", "unknown"), ("VP/Sales", "vp"), ("International Clerk", "intern"), ("International Lead", "senior"), (None, "unknown")]),
    ],
)
def test_functions(spark, f, pairs):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, v string")
    got = [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [b for _, b in pairs]


def test_social_links(spark):
    df = spark.createDataFrame([(["https://x.com/acme", "https://twitter.com/b", "github.com/acme", "https://facebook.com", "notlinkedin.com/x", None],)], "v array<string>")
    assert df.select(urls.social_links(F.col("v")).alias("m")).collect()[0].m == {"x": "https://x.com/acme", "github": "https://github.com/acme"}


def test_unicode(spark):
    df = spark.createDataFrame([("Ａｃｍｅ", "Đặng Thị"), (None, None)], "a string, b string")
    assert text.fold_unicode(df, ["a"]).collect()[0].a == "Acme"
    assert [r[0] for r in df.select(text.unicode_slug("b")).collect()] == ["dangthi", ""]
