"""The distributed greedy fold equals a sequential brute force (random small fixtures)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from spark_netwatch.operators.greedy import greedy_accept


def brute(rows, gap):
    out = set()
    last = {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or t - last[k] >= gap:
            out.add(i)
            last[k] = t
    return out


events = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 3000)), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None)
@given(events, st.sampled_from([1, 100, 300, 1000]))
def test_greedy_matches_sequential(spark, evs, gap):
    rows = [(k, t, i) for i, (k, t) in enumerate(evs)]
    df = spark.createDataFrame(rows, "k string, ts long, id long")
    got = {r.id for r in greedy_accept(df, "k", "ts", "id", gap).filter("accepted").collect()}
    assert got == brute(rows, gap)


def test_greedy_one_hot_key_long_chain(spark):
    # one key holding every row, evenly spaced: the chain visits every 3rd event
    rows = [("hot", t * 100, t) for t in range(600)]
    df = spark.createDataFrame(rows, "k string, ts long, id long")
    for parts in (1, 7, 300):               # whole key, a few stretches, stretches shorter than the gap
        got = {r.id for r in greedy_accept(df, "k", "ts", "id", 300, parts).filter("accepted").collect()}
        assert got == brute(rows, 300)


def test_greedy_events_of_one_instant(spark):
    rows = [("a", t, i) for i, t in enumerate([5, 5, 5, 300, 305, 305, 305, 9000])]
    df = spark.createDataFrame(rows, "k string, ts long, id long")
    for parts in (1, 5):
        got = {r.id for r in greedy_accept(df, "k", "ts", "id", 300, parts).filter("accepted").collect()}
        assert got == brute(rows, 300)
