"""Small helpers of the tests."""

import datetime as dt


def ts(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def by_key(df, key="user_id"):
    return {r[key]: r.asDict() for r in df.collect()}
