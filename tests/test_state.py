"""Requests and work under state against plain simulations, in one run and cut by restarts."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row

from tracewright.streaming import state

SCHEMA = "project string, at timestamp, seq long, kind string, request_id long, section string, force boolean, message string, id string, urgent boolean, generation long"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
MS0 = round(START.timestamp() * 1000)


def event(project, ms, seq, kind, **more):
    fields = ("request_id", "section", "force", "message", "id", "urgent", "generation")
    return (project, START + timedelta(milliseconds=ms), seq, kind, *[more.get(f) for f in fields])


def streamed(spark, tmp_path, processor, parts, restart=False):
    """Rows given out for events written as files, in one run or one run a file."""
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    got = None
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            if restart or k == len(parts) - 1:
                events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1 if restart else 100).parquet(src)
                got = state.run_to_end(state.processed(events, processor), "t", cp, out).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return [tuple(v - MS0 if k == "at_ms" else v for k, v in r.asDict().items()) for r in got]


def far(project="zz"):
    """Moves the watermark past all that is due."""
    return event(project, 10**7, 0, "up", generation=0)


R = lambda ms, i, section=None, force=False: event("p", ms, i, "request", request_id=i, section=section, force=force)


@pytest.mark.parametrize(
    "events, want",
    [
        # the same section shares what is in flight
        ([R(0, 1, "a"), R(1, 2, "a"), event("p", 9, 9, "reply", message="ok")], {1: "ok", 2: "ok"}),
        # another one waits; a third supersedes it
        ([R(0, 1, "a"), R(1, 2, "b"), R(2, 3, "c"), event("p", 5, 8, "reply", message="ok"), event("p", 6, 9, "reply", message="fine")], {1: "ok", 2: "superseded", 3: "fine"}),
        # a forced request doesn't share an unforced one in flight, but makes a waiting one forced
        ([R(0, 1, "a"), R(1, 2, "a", True), R(2, 3, "a"), event("p", 5, 8, "reply", message="old"), event("p", 6, 9, "reply", message="new")], {1: "old", 3: "old", 2: "new"}),
        # a forced one in flight is shared by all
        ([R(0, 1, None, True), R(1, 2), R(2, 3, None, True), event("p", 5, 9, "reply", message="ok")], {1: "ok", 2: "ok", 3: "ok"}),
        # no reply in time; the one that waits goes out then, and comes out of time as well
        ([R(0, 1, "a"), R(50, 2, "b")], {1: "timed-out", 2: "timed-out"}),
        ([R(0, 1, "a"), R(1, 2, "b"), event("p", 150, 9, "reply", message="late")], {1: "timed-out", 2: "late"}),
        # the service ends
        ([R(0, 1, "a"), R(1, 2, "b"), event("p", 2, 5, "down"), R(3, 3, "a"), event("p", 4, 6, "up"), R(5, 4, "a"), event("p", 6, 9, "reply", message="ok")], {1: "exited", 2: "exited", 3: "not-running", 4: "ok"}),
    ],
)
def test_coalesced_requests(spark, tmp_path, events, want):
    got = streamed(spark, tmp_path, state.Coalescer(100), [[*events, far()]])
    assert {r[2]: r[5] for r in got if r[1] == "answer"} == want
    assert sum(r[1] == "answer" for r in got) == len(want)


def test_relayed_requests(spark, tmp_path):
    q = lambda ms, i, s: event("p", ms, i, "request", request_id=i, section=s)
    a = lambda ms, i, s: event("p", ms, 50 + i, "reply", request_id=i, section=s, message="ok")
    events = [q(0, 1, "a"), q(1, 2, None), q(2, 3, "c"), a(5, 1, "a"), a(6, 2, "b"), a(7, 9, "a"), a(8, 1, "a"), a(150, 3, "c"), q(200, 4, "d"), q(210, 5, "d"), event("p", 220, 99, "down")]
    got = streamed(spark, tmp_path, state.Relay(100), [events[:4], events[4:8], [*events[8:], far()]], restart=True)
    assert sorted(r[1:] for r in got) == [(1, "a", "ok", 5), (2, None, "mismatched", 6), (3, "c", "timed-out", 102), (4, "d", "exited", 220), (5, "d", "exited", 220)]


def plain_queue(events, width, timeout):
    """The queue of one project, with lists."""
    gen = ticket = completed = degenerate = 0
    advised, waiting, busy, out = False, [], {}, []

    def serve(now):
        nonlocal ticket
        while len(busy) < width and waiting:
            waiting.sort(key=lambda w: (w[0], w[1]))
            if waiting[0][2] in busy:
                return
            _, _, i, g = waiting.pop(0)
            if g < gen:
                out.append(("dropped", i, g, None, None, now))
                continue
            busy[i] = (g, now + timeout)
            out.append(("start", i, g, None, ticket, now))
            ticket += 1

    def settle(now):
        while due := sorted((d, i) for i, (_, d) in busy.items() if d <= now):
            d, i = due[0]
            g = busy.pop(i)[0]
            out.append(("dropped" if g < gen else "done", i, g, "timed-out", None, d))
            serve(d)

    for n, (_, at, _, kind, _, _, _, message, i, urgent, g) in enumerate(sorted(events, key=lambda e: (e[1], e[2]))):
        now = round((at - START).total_seconds() * 1000)
        settle(now)
        if kind == "generation" and g > gen:
            gen, completed, degenerate, advised = g, 0, 0, False
        elif kind == "submit" and g < gen:
            out.append(("dropped", i, g, None, None, now))
        elif kind == "submit":
            lane, old = 0 if urgent else 1, [w for w in waiting if w[2] == i]
            if old:
                waiting.remove(old[0])
                g = max(g, old[0][3])
            waiting.append((lane, n, i, g) if not old or lane < old[0][0] else (*old[0][:3], g))
        elif kind == "finish" and i in busy and busy[i][0] == g:
            del busy[i]
            out.append(("dropped" if g < gen else "done", i, g, message, None, now))
            if g >= gen and message in ("ok", "degenerate"):
                completed += 1
                degenerate += message == "degenerate"
                if not advised and completed >= 5 and degenerate / completed >= 0.3:
                    advised = True
                    out.append(("advice", None, gen, None, None, now))
        serve(now)
    settle(10**6)
    return out


@pytest.mark.parametrize("restart", [False, True])
def test_work_queue(spark, tmp_path, restart):
    r = random.Random(11)
    events = {}
    for p in ("a", "b", "c"):
        now, g, es = 0, 0, []
        for seq in range(120):
            now += r.randrange(15)
            kind = r.choices(["submit", "finish", "generation"], [6, 8, 0.3])[0]
            g += kind == "generation"
            es.append(event(p, now, seq, kind, id=f"n{r.randrange(6)}", urgent=r.random() < 0.3, generation=max(0, g - (r.random() < 0.1)), message=r.choice(["ok", "ok", "degenerate", "failed", "unreadable"])))
        events[p] = es
    every = sorted((e for es in events.values() for e in es), key=lambda e: e[1])
    cuts = [0, 90, 200, len(every)]
    parts = [every[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    parts[-1] = [*parts[-1], far()]
    if not restart:
        r.shuffle(parts[0])
    got = streamed(spark, tmp_path, state.WorkQueue(2, 60), parts, restart)
    kinds = Counter()
    for p, es in events.items():
        want = plain_queue(es, 2, 60)
        assert Counter(g[1:] for g in got if g[0] == p) == Counter(want)
        kinds.update(w[0] for w in want)
    assert set(kinds) == {"start", "done", "dropped", "advice"}


class Store:
    """A state store's values and maps for one key, with the number of calls."""

    def __init__(self):
        self.calls, self.timers = Counter(), []

    def getValueState(self, name, schema):
        return Kept(self.calls)

    getMapState = lambda self, name, key, value: Kept(self.calls)
    listTimers = lambda self: iter(self.timers)
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)


class Kept:
    def __init__(self, calls):
        self.calls, self.map, self.value = calls, {}, None

    def _told(self, what):
        self.calls[what] += 1
        return self

    exists = lambda self: self._told("one").value is not None
    get = lambda self: self._told("one").value
    clear = lambda self: setattr(self._told("one"), "value", None)
    update = lambda self, value: setattr(self._told("one"), "value", value)
    containsKey = lambda self, key: key in self._told("one").map
    getValue = lambda self, key: self._told("one").map.get(key)
    updateValue = lambda self, key, value: self._told("one").map.__setitem__(key, value)
    removeKey = lambda self, key: self._told("one").map.pop(key)
    iterator = lambda self: iter(list(self._told("all").map.items()))


def test_store_is_asked_for_what_a_batch_touches_not_for_each_event(spark):
    n = 2000
    e = lambda k, kind, **more: Row(**{"ms": k, "seq": k, "kind": kind, "request_id": k, "section": "a", "force": False, "message": "ok", "id": f"n{k % 4}", "urgent": False, "generation": 0, **more})
    relay, store = state.Relay(10**6), Store()
    relay.init(store)
    assert list(relay.handleInputRows(("p",), iter([e(k, "request") for k in range(n)]), None)) == [] and store.timers == [10**6]
    assert store.calls["all"] == 1 and store.calls["one"] <= 2 * n
    store.calls.clear()
    out = list(relay.handleInputRows(("p",), iter([e(n + k, "reply", request_id=k) for k in range(n)]), None))
    assert [r.request_id for r in out] == list(range(n)) and store.timers == [] and relay.pending.state.map == {}
    assert store.calls["all"] == 1 and store.calls["one"] <= 2 * n
    for processor, kinds in ((state.WorkQueue(2, 10**6), ("submit", "finish")), (state.Coalescer(10**6), ("request", "reply"))):
        store = Store()
        processor.init(store)
        out = list(processor.handleInputRows(("p",), iter([e(k, kinds[k // 4 % 2]) for k in range(n)]), None))
        assert len(out) >= n // 2 and store.calls.total() < n
