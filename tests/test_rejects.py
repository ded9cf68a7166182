"""Lines of one's own CSV files that can't be read end no job: they are set apart and counted."""

import pytest

from svcops.operators.quality import dq_report
from svcops.sources import io
from svcops.sources.catalog import Tables

GOOD = {
    "transactions": ['1,s,"two\nlines",2,2010-03-01 10:00:00,2.5,7,France,5.0', "2,s,,1,2010-04-01 10:00:00,1.0,,France,1.0"],
    "customers": ["7,Retail,100.0,Online,Europe,2009-01-01"],
    "tickets": ["1,7,LOC_01,2010-01-01,billing,Low,3.0,,Resolved", '2,7,"LOC_01",2010-01-02,billing,Low,,4.0,Resolved'],
    "operations": ["LOC_01,2010-Q1,UK,1.0,2.0,0.5,1.0,3"],
}
BAD = {
    "transactions": ["3,s,d,many,2010-03-01 10:00:00,2.5,7,France,5.0", "4,s,d,1,no date,2.5,7,France,5.0"],
    "tickets": ["3,7,LOC_01", "4,7,LOC_01,2010-01-01,billing,Low,long,,Resolved", "5,7,LOC_01,2010-01-01,billing,Low,3.0,,Resolved,more"],
}


@pytest.fixture
def own(spark, tmp_path):
    def make(bad):
        paths = {}
        for name, lines in GOOD.items():
            head = ",".join(f.name for f in io.RAW_SCHEMAS[name])
            wrong = bad.get(name, [])
            path = tmp_path / f"{name}-{len(wrong)}.csv"
            path.write_text("\n".join([head, *wrong[:1], *lines, *wrong[1:]]) + "\n")
            paths[name] = str(path)
        return Tables.from_files(spark, **paths)
    return make


def rows(df):
    return sorted(map(str, df.collect()))


def test_good_lines_stay_and_bad_ones_are_listed(own):
    T, clean = own(BAD), own({})
    for name in GOOD:
        assert rows(T.raw(name)) == rows(clean.raw(name)) and T.raw(name).count() == len(GOOD[name])
    got = sorted((r["table"], r["line"].rstrip("\n"), r["file"].rsplit("/", 1)[-1]) for r in io.rejected_lines(T).collect())
    assert got == sorted((n, line, f"{n}-{len(lines)}.csv") for n, lines in BAD.items() for line in lines)
    assert io.rejected_lines(clean).count() == 0


def test_a_line_is_judged_alike_whatever_is_selected(own):
    """The bad field is in a column that the query doesn't read."""
    T = own(BAD)
    assert rows(T.raw("tickets").select("ticket_id")) == ["Row(ticket_id='1')", "Row(ticket_id='2')"]
    assert T.raw("tickets").where("ticket_id = '4'").count() == 0
    assert T.t.count() == 2


def test_the_quality_report_counts_them(spark, own, tmp_path):
    T = own(BAD)
    report = dq_report(T).collect()
    assert [(r["step"], r["table"], r["before"], r["after"], r["change"]) for r in report[19:]] == [
        (20, "transactions", 2, 0, 2), (22, "tickets", 3, 0, 3)]
    assert list(map(str, report[:19])) == list(map(str, dq_report(own({})).collect()))
    io.write_outputs(T, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "rejected_lines")).count() == 5


def test_other_sources_have_no_rejects(spark, sf_dir):
    assert io.rejected_lines(Tables(spark, sf_dir)).count() == 0


def test_own_files_are_read_strictly(own, spark):
    """What the package wrote itself must be readable as it is."""
    for T, fails in ((own({}), False), (own(BAD), True)):
        df = io.read_csv(spark, T.files["tickets"], io.TICKETS_RAW_SCHEMA)
        if fails:
            with pytest.raises(Exception, match="MALFORMED"):
                df.collect()
        else:
            assert df.count() == 2
