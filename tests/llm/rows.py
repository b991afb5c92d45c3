"""Helpers of the tests in this folder."""


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}
