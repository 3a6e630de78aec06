"""Helpers of these tests."""


def as_rows(df):
    return sorted(map(str, df.collect()))
