"""Constants and small functions that the tests share."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
