import json
import random
from itertools import permutations

import pytest

from terrane.operators.change_feed import BucketedTable, order_slot
from terrane.session import work_dir
from terrane.sources.storage import write_new

SCHEMA = "event_no bigint, op string, ts_ms bigint, before string, after string, key string"


def img(i, **kw):
    return json.dumps({"id": i, **kw})


def state(spark, *batches, buckets=4):
    t = BucketedTable(spark, work_dir(spark, "t"), "id", buckets)
    for b in batches:
        t.apply(spark.createDataFrame(b, SCHEMA))
        t = BucketedTable(spark, t.path, "id")
    return {r.key: r.event_no for r in t.state().collect()}, t


E = lambda no, op, ts, before, after: (no, op, ts, before, after, "clash")


def test_order_repeats_and_deletes(spark):
    events = [
        E(1, "r", 1, None, img("a", x=1)),
        E(2, "U", 3, img("a", x=1), img("a", x=2)),
        E(3, "u", 3, '{"x": 1, "id": "a"}', '{"x":2, "id":"a"}'),  # the same change again
        E(4, "u", 2, img("a", x=1), img("a", x=9)),  # late
        E(5, "i", 1, None, img("b")),
        E(6, "d", 2, img("b"), None),
        E(7, "c", 5, None, img("c")),
        E(8, "d", 4, img("c"), None),
        E(9, "u", 6, img("e", y=1), img("f", y=1)),  # takes another id
        E(10, "i", 5, None, img("e", y=1)),
        E(11, "d", 1, None, None),
        E(12, None, None, None, "{}"),
        E(13, "u", 1, None, "no json"),
    ]
    random.Random(1).shuffle(events)
    assert state(spark, events)[0] == {"a": 2, "c": 7, "f": 9}


def fit(e, state):
    """How well an event follows a state (an image, or None), with whole images only."""
    _, op, before, after = e
    return op in ("i", "c") and state is None or op == "r" and state == after or op in "ud" and before is not None and state == before


def test_walk_fits_as_often_as_any_order():
    """Against all orders of up to six events of a few states; ties may differ, the number of fits may not."""
    rng = random.Random(7)
    for _ in range(400):
        states = [img("a", v=n) for n in range(rng.randint(1, 3))]
        events, seen = [], set()
        for n in range(rng.randint(1, 6)):
            op = rng.choice("iuudr")
            e = (op, rng.choice(states) if op in "ud" else None, None if op == "d" else rng.choice(states))
            if e not in seen:
                seen.add(e)
                events.append((n, *e))
        start = rng.choice([None, *states])

        def fits(order):
            state, total = start, 0
            for e in order:
                total, state = total + fit(e, state), e[3]
            return total

        got = order_slot(rng.sample(events, len(events)), start is not None, start)
        assert sorted(got) == events and fits(got) == max(fits(o) for o in permutations(events))


@pytest.mark.parametrize("n", [3, 8, 5000])
def test_crowded_millisecond_of_any_size(spark, n):
    """A chain of n updates, some before-images short or missing, in one millisecond, in any cut into batches."""
    rng, E_ = random.Random(n), []
    for k in range(n):
        before = img("a", v=k, w="x") if k % 3 else json.dumps({"v": k}) if k else None
        E_.append(E(k + 1, "u" if k else "i", 5, before, img("a", v=k + 1, w="x")))
    numbers = rng.sample(range(1, n + 1), n)
    events = [(numbers[k], *e[1:]) for k, e in enumerate(E_)]
    last = events[-1][0]
    rng.shuffle(events)
    assert state(spark, events)[0] == {"a": last}
    cut = n // 3
    assert state(spark, events[:cut], events[cut : 2 * cut], events[2 * cut :])[0] == {"a": last}


def test_late_event_decides_an_open_millisecond(spark):
    a, b = img("1", x="A"), img("1", x="B")
    events = [E(3, "i", 1, None, a), E(1, "u", 2, b, a), E(2, "u", 2, a, b)]
    assert state(spark, events)[0] == state(spark, events[1:], events[:1])[0] == {"1": 1}
    # the same millisecond in two batches, and an older one that becomes crowded afterwards
    events = [E(1, "i", 1, None, a), E(2, "u", 1, a, b), E(3, "u", 2, b, a), E(4, "u", 2, a, b), E(5, "d", 2, b, None), E(6, "c", 2, None, a)]
    for k in (4,):
        assert state(spark, events[k:], events[:k])[0] == state(spark, events)[0] == {"1": 6}


def test_missing_images(spark):
    a, b = img("a", x=1), img("a", x=2)
    assert [e[0] for e in order_slot([(1, "d", None, None), (2, "i", None, b)], True, a)] == [1, 2]
    assert [e[0] for e in order_slot([(1, "u", None, b), (2, "u", a, img("a", x=3))], True, a)] == [2, 1]
    assert [e[0] for e in order_slot([(1, "u", b, a), (2, "u", a, b)], False, None)] == [1, 2]
    many = [(n, "u", None, img("a", x=n)) for n in range(3000)]
    assert [e[0] for e in order_slot(many, True, a)] == list(range(3000))


def test_rebucket_and_cut_manifest(spark):
    got, t = state(spark, [E(n, "i", n, None, img(str(n))) for n in range(40)], buckets=4)
    t.rebucket(7)
    t = BucketedTable(spark, t.path, "id")
    assert t.buckets == 7 and {r.key: r.event_no for r in t.state().collect()} == got
    write_new(spark, f"{t.path}/manifest/000000000009.json", '{"version": 9, "buck')
    t = BucketedTable(spark, t.path, "id")
    t.apply(spark.createDataFrame([E(99, "d", 99, img("7"), None), E(98, "u", 3, img("3"), img("3", x=1))], SCHEMA))
    t = BucketedTable(spark, t.path, "id")
    assert t.version == 10 and {r.key: r.event_no for r in t.state().collect()} == {k: 98 if k == "3" else v for k, v in got.items() if k != "7"}
    with pytest.raises(Exception):
        write_new(spark, f"{t.path}/manifest/000000000010.json", "{}")


def test_one_millisecond(spark):
    chain = [E(3, "i", 5, None, img("a", v=0)), E(1, "u", 5, img("a", v=0), img("a", v=1)), E(2, "u", 5, img("a", v=1), img("a", v=2)), E(4, "d", 5, img("a", v=2), None), E(5, "c", 5, None, img("a", v=3))]
    assert state(spark, chain)[0] == {"a": 5}
    long = [(n, "u", img("a", v=n), img("a", v=n + 1)) for n in range(12)]
    random.Random(2).shuffle(long)
    assert [e[0] for e in order_slot(long, True, img("a", v=0))] == list(range(12))


def test_batches_equal_one_batch(spark):
    events = [E(n, "u" if n > 20 else "i", 10 + n // 2, None if n <= 20 else img(str(n % 20), v=n - 20), img(str(n % 20), v=n)) for n in range(1, 101)]
    whole, _ = state(spark, events)
    parts, t = state(spark, events[:40], events[40:], events[:10], [])
    assert whole == parts and t.version == 3 and len(whole) == 20


def test_untouched_buckets_keep_their_files(spark):
    _, t = state(spark, [E(n, "i", n, None, img(str(n))) for n in range(40)], buckets=8)
    before = dict(t.files)
    t.apply(spark.createDataFrame([E(99, "d", 99, img("7"), None)], SCHEMA))
    assert sum(before[b] != t.files[b] for b in before) == 1 and "7" not in {r.key for r in t.state().collect()}


def test_empty(spark):
    got, t = state(spark, [])
    assert got == {} and t.version == 0
