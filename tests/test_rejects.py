from leadloom.operators import rejects

HEAD = "First Name,Last Name,Position,Email Address,Direct Phone,LinkedIn Profile,Company,Website,Industry,Employees,Country,City"
DDL = "line_id long, file_name string, line_no int, line string, reason string"


def row(i, line, file="a.csv", no=2):
    return (i, file, no, line, "clash")


def cells(email="a@b.example", phone="+4930231250", size="12", name="Ada"):
    return f"{name},B,C,{email},{phone},,Co,,I,{size},X,Y"


def test_reasons(spark):
    rows = [
        (0, "a.csv", 1, HEAD, None), row(1, cells()), row(2, cells(name='"A,B"')), row(3, cells(name='"A ""x"" B"')), row(4, cells(name='A"')), row(5, cells(name='"A"b')), row(6, '"open,' + cells()),
        row(7, cells() + ",x"), row(8, "a,b"), row(9, cells(email="nope", phone="12", size="-5")), row(10, cells(email="Jo <jo@x.example>", phone="N/A", size="~1.2k")), row(11, cells(email="mailto:jo@x.example", size="Oct-82")),
        row(12, cells(size="3000000", phone="1-800-ABCDEFG")), row(13, "   "), row(14, None), row(15, ",,,,,,,,,,,"), row(16, cells(name='"two\nlines"')), row(17, cells(name='""')),
    ]
    rows += [(20, "b.tsv", 1, HEAD.replace(",", "\t"), None), row(21, cells().replace(",", "\t"), "b.tsv"), row(22, cells(), "b.tsv"), row(23, cells(), None), row(9, rows[9][3])]
    lines = spark.createDataFrame(rows, DDL)
    got = {tuple(r) for r in rejects.failures(lines).collect()}
    assert got == {
        (4, "quoting"), (5, "quoting"), (6, "quoting"), (7, "column_count"), (8, "column_count"), (9, "email"), (9, "phone"), (9, "employees"), (11, "employees"), (12, "employees"), (12, "phone"), (22, "column_count"),
    }
    loaded = {r.line_id: r for r in rejects.load(lines).collect()}
    assert set(loaded) == {1, 2, 3, 10, 15, 16, 17, 21, 23}
    assert loaded[2].first_name == "A,B" and loaded[3].first_name == 'A "x" B' and loaded[16].first_name == "two\nlines" and loaded[17].first_name == ""


def test_empty_and_long(spark):
    none = spark.createDataFrame([], DDL)
    assert rejects.failures(none).count() == 0 and rejects.load(none).count() == 0
    long = cells(name='"' + 'x""' * 50_000 + '"')
    assert rejects.failures(spark.createDataFrame([(0, "a.csv", 1, HEAD, ""), row(1, long), row(2, '"' * 50_001)], DDL)).collect()[0].line_id == 2
