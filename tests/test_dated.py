"""Dates in lines of contexts, odd ones too."""

from recollect.operators import dated


def test_year_0000_is_no_date_and_blanks_are_those_of_the_sql(spark):
    lines = ["in 0000 it was", "[0000] in 2021", "[7 May 2023] x", "then", " \u00a0\u3000", "[\u00a02023 ] y", "[7\x0bMay 2023] z 2020", "[7\tMay\r2022]"]
    df = spark.createDataFrame([(1, "\n".join(lines))], "key int, text string")
    got = {r.line: (str(r.day), r.date_text, str(r.carried)) for r in dated.dated_lines(df, ["key"]).collect()}
    assert got == {
        0: ("None", "", "None"), 1: ("None", "", "None"), 2: ("2023-05-07", "7 May 2023", "2023-05-07"), 3: ("None", "", "2023-05-07"), 5: ("2023-06-15", "\u00a02023 ", "2023-06-15"),
        6: ("2023-06-15", "2023", "2023-06-15"), 7: ("2022-05-07", "7\tMay\r2022", "2022-05-07"),
    }
