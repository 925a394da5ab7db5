"""Keyed state of requests and of work: STR-01 to STR-04, STR-08, STR-17, AGG-27.

Each processor is a function of the events of its key in the order of (at, seq), however a stream cuts
them into batches: what falls due between two events is settled before the second, and a timer settles
what no further event reaches. State lives in the state store, so a restart goes on where it stopped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..storage import fresh

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Messages and thresholds: fixed values.
TIMED_OUT, SUPERSEDED, NOT_RUNNING, EXITED, MISMATCHED = "timed-out", "superseded", "not-running", "exited", "mismatched"
LEAST_COMPLETED, DEGENERATE_RATE = 5, 0.3


class _Held:
    """A value of the state store in memory, written back by flush()."""

    def __init__(self, state: Any):
        self.state = state
        self.forget()

    def forget(self) -> None:
        self.read, self.changed, self.value = False, False, None

    def get(self) -> tuple | None:
        if not self.read:
            self.value, self.read = (tuple(self.state.get()) if self.state.exists() else None), True
        return self.value

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, value: tuple) -> None:
        self.value, self.read, self.changed = value, True, True

    def clear(self) -> None:
        self.update(None)

    def flush(self) -> None:
        if self.changed and self.value is not None:
            self.state.update(self.value)
        elif self.changed:
            self.state.clear()
        self.forget()


class _HeldMap:
    """A map of the state store in memory: entries as they are asked for, all once they are listed; written back by flush()."""

    def __init__(self, state: Any):
        self.state = state
        self.forget()

    def forget(self) -> None:
        self.whole = False
        self.stored: dict[tuple, tuple | None] = {}  # what the store has of the entries read, None: nothing
        self.now: dict[tuple, tuple] = {}

    def _ask(self, key: tuple) -> None:
        if key not in self.stored and not self.whole:
            found = tuple(self.state.getValue(key)) if self.state.containsKey(key) else None
            self.stored[key] = found
            if found is not None:
                self.now[key] = found

    def containsKey(self, key: tuple) -> bool:
        self._ask(key)
        return key in self.now

    def getValue(self, key: tuple) -> tuple | None:
        self._ask(key)
        return self.now.get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._ask(key)
        self.now[key] = value

    def removeKey(self, key: tuple) -> None:
        self._ask(key)
        self.now.pop(key, None)

    def entries(self) -> dict[tuple, tuple]:
        if not self.whole:
            for k, v in self.state.iterator():
                if (key := tuple(k)) not in self.stored:
                    self.stored[key] = self.now[key] = tuple(v)
            self.whole = True
        return self.now

    def flush(self) -> None:
        for key, value in self.now.items():
            if self.stored.get(key) != value:
                self.state.updateValue(key, value)
        for key, value in self.stored.items():
            if value is not None and key not in self.now:
                self.state.removeKey(key)
        self.forget()


class _Timed(StatefulProcessor):
    """Events in order, each after what falls due before it; one timer stands for the next thing due."""

    OUT = ""

    def hold(self, handle: StatefulProcessorHandle, **states: Any) -> None:
        """The state store's values and maps as attributes, held in memory for one key at a time."""
        self.handle, self.held = handle, list(states.values())
        self.named = Row(*[c.split()[0] for c in self.OUT.split(", ")])
        for name, state in states.items():
            setattr(self, name, state)

    def row(self, *values: Any) -> Row:
        return self.named(*values)

    def begin(self) -> None:
        """Called when a key's state is about to be used."""

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        out: list[Row] = []
        self.begin()
        # a batch's rows of one key; the source bounds a batch
        for e in sorted(rows, key=lambda r: (r["ms"], r["seq"])):
            now = e["ms"]
            self.settle_due(key, now, out)
            self.take(key, e, now, out)
        self._end()
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        out: list[Row] = []
        self.begin()
        # no event before the watermark comes any more, so what falls due up to it is settled at once
        self.settle_due(key, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), out)
        self._end()
        yield from out

    def _end(self) -> None:
        due = self.next_due()
        for state in self.held:
            state.flush()
        set_now = list(self.handle.listTimers())
        for t in set_now:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in set_now:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class Coalescer(_Timed):
    """STR-08: of a project one request is in flight. Requests for the section in flight share it, unless they are forced and it is not;
    others wait, and only the last section waits: requests for another one are superseded. A forced request makes
    a waiting one forced. A request that has no reply in time is answered so, and the next goes out.

    Events: kind is request (request_id, section, force), reply (message), down or up.
    """

    OUT = "project string, kind string, request_id long, section string, force boolean, status string, at_ms long"

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = "section string, force boolean, due long, ids array<long>"
        value = lambda name, schema: _Held(handle.getValueState(name, schema))
        self.hold(handle, sent=value("sent", held), waiting=value("waiting", held), down=value("down", "down boolean"))

    def next_due(self) -> int | None:
        return self.sent.get()[2] if self.sent.exists() else None

    def _answer(self, key, held, status, now, out) -> None:
        out.extend(self.row(key[0], "answer", i, held[0], held[1], status, now) for i in held[3])

    def _start(self, key, now, out) -> None:
        if self.sent.exists() or not self.waiting.exists():
            return
        section, force, _, ids = self.waiting.get()
        self.waiting.clear()
        if self.down.exists():
            self._answer(key, (section, force, 0, ids), NOT_RUNNING, now, out)
            return
        self.sent.update((section, force, now + self.timeout, list(ids)))
        out.append(self.row(key[0], "send", None, section, force, None, now))

    def settle_due(self, key, now, out) -> None:
        while self.sent.exists() and (due := self.sent.get()[2]) <= now:
            self._settle(key, TIMED_OUT, due, out)

    def _settle(self, key, status, now, out) -> None:
        if self.sent.exists():
            held = self.sent.get()
            self.sent.clear()
            self._answer(key, held, status, now, out)
            self._start(key, now, out)

    def take(self, key, e, now, out) -> None:
        if e["kind"] == "reply":
            self._settle(key, e["message"], now, out)
        elif e["kind"] == "up":
            self.down.clear()
        elif e["kind"] == "down":
            self.down.update((True,))
            if self.waiting.exists():
                self._answer(key, self.waiting.get(), EXITED, now, out)
                self.waiting.clear()
            self._settle(key, EXITED, now, out)
        elif e["kind"] == "request":
            section, force, i = e["section"], bool(e["force"]), e["request_id"]
            if self.waiting.exists() and self.waiting.get()[0] != section:
                self._answer(key, self.waiting.get(), SUPERSEDED, now, out)
                self.waiting.clear()
            if self.sent.exists():
                held = self.sent.get()
                if held[0] == section and (held[1] or not force):
                    self.sent.update((held[0], held[1], held[2], [*held[3], i]))
                    return
            if self.waiting.exists():
                held = self.waiting.get()
                self.waiting.update((section, held[1] or force, 0, [*held[3], i]))
            else:
                self.waiting.update((section, force, 0, [i]))
            self._start(key, now, out)


class Relay(_Timed):
    """STR-17: requests of a project by id, each answered once: by its reply, by a reply for another section as an error, by
    the service's end, or in time. Replies to what isn't pending count for nothing.

    Events: kind is request (request_id, section), reply (request_id, section, message) or down.
    """

    OUT = "project string, request_id long, section string, status string, at_ms long"

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hold(handle, pending=_HeldMap(handle.getMapState("pending", "request_id long", "section string, due long")))

    def begin(self) -> None:
        # due and id of all that is pending; those answered or asked again meanwhile stay until they come up
        self.line = [(due, i) for (i,), (_, due) in self.pending.entries().items()]
        heapq.heapify(self.line)

    def next_due(self) -> int | None:
        while self.line and not self._stands(*self.line[0]):
            heapq.heappop(self.line)
        return self.line[0][0] if self.line else None

    def _stands(self, due: int, i: int) -> bool:
        held = self.pending.getValue((i,))
        return held is not None and held[1] == due

    def _answer(self, key, i, section, status, now, out) -> None:
        self.pending.removeKey((i,))
        out.append(self.row(key[0], i, section, status, now))

    def settle_due(self, key, now, out) -> None:
        while self.line and self.line[0][0] <= now:
            due, i = heapq.heappop(self.line)
            if self._stands(due, i):
                self._answer(key, i, self.pending.getValue((i,))[0], TIMED_OUT, due, out)

    def take(self, key, e, now, out) -> None:
        i = e["request_id"]
        if e["kind"] == "request":
            self.pending.updateValue((i,), (e["section"], now + self.timeout))
            heapq.heappush(self.line, (now + self.timeout, i))
        elif e["kind"] == "reply" and self.pending.containsKey((i,)):
            section = self.pending.getValue((i,))[0]
            self._answer(key, i, section, e["message"] if section == e["section"] else MISMATCHED, now, out)
        elif e["kind"] == "down":
            for (i,), (section, _) in sorted(self.pending.entries().items()):
                self._answer(key, i, section, EXITED, now, out)
            self.line.clear()


class WorkQueue(_Timed):
    """STR-01 to STR-04, AGG-27: work of a project with at most `width` pieces under way, urgent ones first, then as they came.

    A piece that waits and is asked for again waits once, as an urgent one if either is. A newer
    generation supersedes: a piece of an older one is dropped when it comes, when its turn comes,
    and when its result comes (its place is free again). A piece without result in time has failed.
    Advice is given once a generation, when enough results are degenerate.

    Events: kind is submit (id, urgent, generation), finish (id, generation, message: ok, degenerate,
    failed or unreadable) or generation. Rows out: kind is start, done, dropped or advice; ticket counts starts.
    """

    OUT = "project string, kind string, id string, generation long, status string, ticket long, at_ms long"

    def __init__(self, width: int, timeout_ms: int):
        self.width, self.timeout = width, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        map_ = lambda name, key, value: _HeldMap(handle.getMapState(name, key, value))
        self.hold(
            handle,
            # of each lane: next place to give out and next place to serve
            counts=_Held(handle.getValueState("counts", "generation long, head0 long, tail0 long, head1 long, tail1 long, ticket long, completed long, degenerate long, advised boolean")),
            lanes=map_("lanes", "lane int, place long", "id string, generation long"),
            waits=map_("waits", "id string", "lane int, place long"),
            under_way=map_("under_way", "id string", "generation long, due long"),
        )

    def _load(self) -> dict:
        names = ("generation", "head0", "tail0", "head1", "tail1", "ticket", "completed", "degenerate", "advised")
        return dict(zip(names, self.counts.get() if self.counts.exists() else (0,) * 8 + (False,), strict=True))

    def _save(self, c: dict) -> None:
        self.counts.update(tuple(c.values()))

    def _busy(self) -> list[tuple]:
        return [(k[0], *v) for k, v in self.under_way.entries().items()]  # at most `width`

    def next_due(self) -> int | None:
        return min((due for *_, due in self._busy()), default=None)

    def _serve(self, key, c, now, out) -> None:
        free = self.width - len(self._busy())
        while free > 0:
            lane = 0 if c["head0"] < c["tail0"] else 1 if c["head1"] < c["tail1"] else None
            if lane is None:
                return
            at = (lane, c[f"head{lane}"])
            if not self.lanes.containsKey(at):  # it moved to the urgent lane
                c[f"head{lane}"] += 1
                continue
            i, generation = self.lanes.getValue(at)
            if self.under_way.containsKey((i,)):  # asked for again while under way: nothing overtakes it
                return
            c[f"head{lane}"] += 1
            self.lanes.removeKey(at)
            self.waits.removeKey((i,))
            if generation < c["generation"]:
                out.append(self.row(key[0], "dropped", i, generation, None, None, now))
                continue
            self.under_way.updateValue((i,), (generation, now + self.timeout))
            out.append(self.row(key[0], "start", i, generation, None, c["ticket"], now))
            c["ticket"] += 1
            free -= 1

    def settle_due(self, key, now, out) -> None:
        while True:
            due = sorted(((d, i, g) for i, g, d in self._busy() if d <= now))
            if not due:
                return
            d, i, generation = due[0]
            self.under_way.removeKey((i,))
            c = self._load()
            out.append(self.row(key[0], "dropped" if generation < c["generation"] else "done", i, generation, TIMED_OUT, None, d))
            self._serve(key, c, d, out)
            self._save(c)

    def take(self, key, e, now, out) -> None:
        c, i = self._load(), e["id"]
        if e["kind"] == "generation" and e["generation"] > c["generation"]:
            c |= {"generation": e["generation"], "completed": 0, "degenerate": 0, "advised": False}
        elif e["kind"] == "submit" and e["generation"] < c["generation"]:
            out.append(self.row(key[0], "dropped", i, e["generation"], None, None, now))
        elif e["kind"] == "submit":
            lane, at = 0 if e["urgent"] else 1, self.waits.getValue((i,)) if self.waits.containsKey((i,)) else None
            generation = e["generation"]
            if at is not None:
                generation = max(generation, self.lanes.getValue(tuple(at))[1])
            if at is None or lane < at[0]:
                if at is not None:
                    self.lanes.removeKey(tuple(at))
                at = (lane, c[f"tail{lane}"])
                c[f"tail{lane}"] += 1
                self.waits.updateValue((i,), at)
            self.lanes.updateValue(tuple(at), (i, generation))
        elif e["kind"] == "finish" and self.under_way.containsKey((i,)) and self.under_way.getValue((i,))[0] == e["generation"]:
            self.under_way.removeKey((i,))
            late = e["generation"] < c["generation"]
            out.append(self.row(key[0], "dropped" if late else "done", i, e["generation"], e["message"], None, now))
            if not late and e["message"] in ("ok", "degenerate"):
                c["completed"] += 1
                c["degenerate"] += e["message"] == "degenerate"
                if not c["advised"] and c["completed"] >= LEAST_COMPLETED and c["degenerate"] >= DEGENERATE_RATE * c["completed"]:
                    c["advised"] = True
                    out.append(self.row(key[0], "advice", None, c["generation"], None, None, now))
        self._serve(key, c, now, out)
        self._save(c)


def processed(events: DataFrame, processor: _Timed, delay: str = "0 seconds") -> DataFrame:
    """What a processor gives out for a stream of events: project, at (a timestamp), seq and the columns that it names. Events later
    than `delay` behind the newest are dropped; those without a project or a time are left out."""
    at = F.col("at").cast("timestamp")
    good = events.filter(F.col("project").isNotNull() & F.col("at").isNotNull()).withColumns({"at": at, "ms": F.unix_millis(at)}).withWatermark("at", delay)
    return good.groupBy("project").transformWithState(processor, processor.OUT, "Append", "EventTime")


def run_to_end(out: DataFrame, label: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run a stream over all that its source has, and read what it gave out. With the checkpoint and path of a former run it goes on."""
    spark: SparkSession = out.sparkSession
    path = path or fresh(spark, label)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
