"""Stateful stream operators: decisions for good, bounded rate limits, and queues with timers.

Each is a processor with typed state in the state store on disk, so a task holds the rows that a
trigger brings for a key and what it looks up, not the state of the key.  ``state_store`` asks for
the store that these processors need.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.functions import answers
from larkspur.operators import ingest

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> SparkSession:
    """Ask for the state store on disk; its coordinator starts with the first look at the session's streams, which a table needs too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.streams.active  # noqa: B018
    return spark


# Decisions: collisions by record id, then duplicates and conflicts by logical key.

#: What a decision needs of an attempt beside its identity, carried as one text.
_FACTS = {"_bad_time": "boolean", "_before": "string", "_after": "string", "timeliness": "string", "clock_skew_suspected": "boolean", "consent_reason": "string", "consent_policy_version": "string", "event_name": "string"}
_ATTEMPT = "tenant_id string, app_id string, producer string, event_id string, record_id string, delivery_id string, digest string, place binary, payload_sha256 string, facts string, alone boolean"
_MARKED = f"{_ATTEMPT}, collided boolean, receipt int"
_NAMES = [c.split()[0] for c in _ATTEMPT.split(", ")]
#: The columns that ``ingest.attempt_order`` reads.
_PLACED = ["received_at", "record_id", "delivery_id", "tenant_id", "app_id", "schema_version", "_record_sha256"]


class Copies(StatefulProcessor):
    """By record id: each attempt with whether its record id is met more than once, and how often it was received.

    The state is the first attempt, which is told again when a second one comes, and a count for each
    attempt: one that is delivered again is no copy.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", f"{_ATTEMPT}, collided boolean")
        self.seen = handle.getMapState("seen", "delivery_id string, digest string", "receipts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = self.first.get() if self.first.exists() else None
        for row in rows:
            attempt, values = (row.delivery_id or "", row.digest), tuple(row[c] for c in _NAMES)
            receipts = (self.seen.getValue(attempt)[0] if self.seen.containsKey(attempt) else 0) + 1
            self.seen.updateValue(attempt, (receipts,))
            copy = receipts == 1 and first is not None and row.record_id is not None
            if copy and not first[-1]:
                first = (*first[:-1], True)
                self.first.update(first)
                yield self.marked(first[:-1], True, 1)
            if first is None:
                first = (*values, False)
                self.first.update(first)
            yield self.marked(values, bool(copy or (receipts > 1 and first[-1])), receipts)

    def marked(self, values: tuple, collided: bool, receipt: int) -> Row:
        return Row(**dict(zip(_NAMES, values)), collided=collided, receipt=receipt)

    def close(self) -> None:
        pass


_DECIDED = "record_id string, delivery_id string, digest string, receipt int, version long, duplicate_resolution string, _first_record_id string, facts string"


class Decisions(StatefulProcessor):
    """By logical key: which attempt is first, and so what each one is; decisions that change are told again.

    The state is the first attempt in the total order and a row an attempt.  All attempts of a key are
    told again only when one comes that stands before the first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "place binary, record_id string, payload_sha256 string, delivery_id string, digest string")
        self.attempts = handle.getMapState("attempts", "delivery_id string, digest string", "place binary, record_id string, payload_sha256 string, facts string, collided boolean, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        head, moved, touched = self.head.get() if self.head.exists() else None, False, {}
        for row in rows:
            attempt = (row.delivery_id or "", row.digest)
            if row.alone:
                again = row.receipt > 1
                yield self.told(attempt, row.record_id, row.facts, row.receipt, 1 + row.collided, "duplicate_delivery" if again else "record_id_collision" if row.collided and '"_bad_time":true' not in row.facts else "unique", row.record_id)
                continue
            if row.receipt > 1:
                touched[attempt, row.receipt] = (row.record_id, row.facts)
                continue
            place = bytes(row.place)
            version = self.attempts.getValue(attempt)[-1] + 1 if self.attempts.containsKey(attempt) else 1
            self.attempts.updateValue(attempt, (place, row.record_id, row.payload_sha256, row.facts, row.collided, version))
            touched[attempt, 1] = None
            if head is None or place < bytes(head[0]):
                moved = moved or head is not None
                head = (place, row.record_id, row.payload_sha256, *attempt)
                self.head.update(head)
        for (attempt, receipt), again in touched.items():
            if again:
                yield self.told(attempt, again[0], again[1], receipt, 1, "duplicate_delivery", head[1])
            elif not moved:
                yield self.decided(attempt, self.attempts.getValue(attempt), head)
        if moved:
            changed = []
            for attempt, state in self.attempts.iterator():
                state = (*state[:-1], state[-1] + 1)
                changed.append((attempt, state))
                yield self.decided(attempt, state, head)
            for attempt, state in changed:
                self.attempts.updateValue(attempt, state)

    def decided(self, attempt: tuple, state: tuple, head: tuple) -> Row:
        _, record_id, payload, facts, collided, version = state
        if collided:
            resolution = "record_id_collision"
        elif tuple(attempt) == tuple(head[3:]):
            resolution = "unique"
        else:
            resolution = "duplicate_delivery" if payload == head[2] else "event_id_conflict"
        return self.told(attempt, record_id, facts, 1, version, resolution, head[1])

    def told(self, attempt: tuple, record_id, facts: str, receipt: int, version: int, resolution: str, first) -> Row:
        return Row(record_id=record_id, delivery_id=attempt[0], digest=attempt[1], receipt=receipt, version=version, duplicate_resolution=resolution, _first_record_id=first, facts=facts)

    def close(self) -> None:
        pass


def _joined(parts: list[Column]) -> Column:
    """One binary key that sorts as its parts do, which are binary keys of even length without zero units."""
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit(b"\0\0"), p]
    return F.concat(*out)


def _of_table(seen: DataFrame) -> DataFrame:
    """What ``Copies`` and ``Decisions`` tell last of a whole table of examined attempts: a window by record id, one by logical key."""
    alone, attempt = F.coalesce(F.col("_alone"), F.lit(False)), F.struct(F.coalesce("delivery_id", F.lit("")), "_record_sha256")
    by_record = Window.partitionBy("record_id", F.when(F.col("record_id").isNull(), F.xxhash64("delivery_id", "_record_sha256")))
    same = Window.partitionBy("record_id", F.when(F.col("record_id").isNull(), F.xxhash64("delivery_id", "_record_sha256")), F.coalesce("delivery_id", F.lit("")), "_record_sha256")
    df = seen.select(*_PLACED, *ingest.LOGICAL_KEY[2:], "payload_sha256", *_FACTS, alone.alias("_alone"))
    df = df.withColumn("receipt", F.row_number().over(same.orderBy("tenant_id", "app_id", *_FACTS)))
    df = df.withColumn("_collided", F.col("record_id").isNotNull() & (F.min(attempt).over(by_record) != F.max(attempt).over(by_record)))
    by_key = Window.partitionBy("_alone", *ingest.LOGICAL_KEY, F.when(F.col("_alone"), F.xxhash64("delivery_id", "_record_sha256"))).orderBy(F.col("receipt") > 1, *ingest.attempt_order())
    df = df.withColumn("_first", F.first(F.struct("record_id", "payload_sha256")).over(by_key)).withColumn("_place", F.row_number().over(by_key))
    again, collided = F.col("receipt") > 1, F.col("_collided") & ~(F.col("_alone") & F.col("_bad_time"))
    resolution = F.when(again, "duplicate_delivery").when(collided, "record_id_collision").when(F.col("_alone") | (F.col("_place") == 1), "unique").when(F.col("_first.payload_sha256").eqNullSafe(F.col("payload_sha256")), "duplicate_delivery").otherwise("event_id_conflict")
    first = F.when(F.col("_alone"), F.col("record_id")).otherwise(F.col("_first.record_id"))
    return df.select("record_id", F.nullif("delivery_id", F.lit("")).alias("delivery_id"), F.col("_record_sha256").alias("digest"), "receipt", F.lit(1).cast("long").alias("version"), resolution.alias("duplicate_resolution"), first.alias("_first_record_id"), *_FACTS)


def decisions(attempts: DataFrame) -> DataFrame:
    """Decisions of a stream (or table) of attempts, as ``ingest.decide`` makes them, revised as later attempts ask for it.

    Rows are (delivery_id, digest, receipt, version, decision): the last version of an attempt is its
    decision so far, and after any order and batching of the same attempts it is that of ``ingest.decide``.
    An attempt that is delivered again, byte for byte, is a duplicate with its own receipt and never a
    collision.  The consent of an attempt is what its row tells; ``withdrawals`` adds that of a stream.
    A table comes whole, so windows give each attempt's last version at once and no state is kept.
    """
    seen = ingest.examined(attempts)
    if not attempts.isStreaming:
        return _concluded(_of_table(seen))
    state_store(attempts.sparkSession)
    facts = F.to_json(F.struct(*_FACTS), {"ignoreNullFields": "false"})
    place = _joined([F.coalesce(p, F.lit(b"")) for p in ingest.attempt_order()])
    alone = F.coalesce(F.col("_alone"), F.lit(False))
    rows = seen.select(*ingest.LOGICAL_KEY, "record_id", "delivery_id", F.col("_record_sha256").alias("digest"), place.alias("place"), "payload_sha256", facts.alias("facts"), alone.alias("alone"))
    spread = rows.withColumn("salt", F.when(F.col("record_id").isNull(), F.xxhash64("delivery_id", "digest")))
    marked = spread.groupBy("record_id", "salt").transformWithState(Copies(), _MARKED, "Append", "None")
    spread = marked.withColumn("salt", F.when(F.col("alone"), F.xxhash64("delivery_id", "digest")))
    decided = spread.groupBy(*ingest.LOGICAL_KEY, "salt").transformWithState(Decisions(), _DECIDED, "Append", "None")
    schema = ", ".join(f"{k} {v}" for k, v in _FACTS.items())
    opened = decided.withColumn("f", F.from_json("facts", schema)).select("record_id", F.nullif("delivery_id", F.lit("")).alias("delivery_id"), "digest", "receipt", "version", "duplicate_resolution", "_first_record_id", "f.*")
    return _concluded(opened)


def _concluded(decided: DataFrame) -> DataFrame:
    return ingest.concluded(decided).drop("_bad_time", "_before", "_after", "_first_record_id")


def standing(told: DataFrame) -> DataFrame:
    """The decisions that hold, of all that ``decisions`` told: the last version of each receipt."""
    from larkspur.operators.ledger import latest_by

    return latest_by(told, ["delivery_id", "digest", "receipt"], ["version"])


# Rate limits with a bound on keys.


class Buckets(StatefulProcessor):
    """Token buckets of the keys of a shard: at most ``most`` of them, the longest unseen gives way, idle ones expire."""

    def __init__(self, rate: float, burst: float, most: int, idle_ms: int):
        if not (rate > 0 and burst >= 1 and most >= 1 and idle_ms > 0):
            raise ValueError("rate, burst, bound of keys and idle time must be positive")
        self.rate, self.burst, self.most, self.idle_ms = float(rate), float(burst), most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key_id string", "tokens double, updated long, seen long")

    def held(self) -> OrderedDict:
        """The entries, the longest unseen first."""
        found = sorted(((k[0], list(v)) for k, v in self.entries.iterator()), key=lambda x: (x[1][2], x[0]))
        return OrderedDict(found)

    def dropped(self, held: OrderedDict, now: int) -> set[str]:
        out = set()
        while held and now - (oldest := next(iter(held.items())))[1][2] >= self.idle_ms:
            held.popitem(last=False)
            out.add(oldest[0])
        return out

    def saved(self, held: OrderedDict, changed: set[str], gone: set[str]) -> None:
        for key in gone - held.keys():
            self.entries.removeKey((key,))
        for key in changed & held.keys():
            self.entries.updateValue((key,), tuple(held[key]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(next(iter(held.values()))[2] + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, changed, gone = self.held(), set(), set()
        now = max((e[2] for e in held.values()), default=0)
        for row in sorted(rows, key=lambda r: (r.at_ms, r.request_id)):
            now = max(now, row.at_ms)
            gone |= self.dropped(held, now)
            entry = held.pop(row.key_id, None)
            if entry is None:
                if len(held) >= self.most:
                    gone.add(held.popitem(last=False)[0])
                entry = [self.burst, now, now]
            tokens = min(self.burst, entry[0] + (now - entry[1]) / 1000 * self.rate)
            allowed = tokens >= 1
            held[row.key_id] = [tokens - 1 if allowed else tokens, now, now]
            changed.add(row.key_id)
            yield Row(key_id=row.key_id, request_id=row.request_id, at_ms=row.at_ms, allowed=allowed)
        self.saved(held, changed, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held()
        self.saved(held, set(), self.dropped(held, expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())

    def close(self) -> None:
        pass


def bounded_buckets(requests: DataFrame, rate: float, burst: float, most: int = 10_000, idle_ms: int = 900_000, shards: int = 1, delay: str = "10 minutes") -> DataFrame:
    """Requests (key_id, request_id, at_ms) that a token bucket per key lets through, with at most ``most`` keys a shard.

    A new key beyond the bound takes the place of the one unseen for longest (of equals the smallest), which
    starts anew if it comes back; a key that is idle for ``idle_ms`` is forgotten.  Keys are dealt to shards
    by a hash, so the bound holds for each shard and a task holds ``most`` entries.  Null keys are one key.
    """
    state_store(requests.sparkSession)
    timed = requests.select(F.coalesce("key_id", F.lit("")).alias("key_id"), "request_id", "at_ms", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", delay)
    dealt = timed.withColumn("shard", F.pmod(F.xxhash64("key_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").transformWithState(Buckets(rate, burst, most, idle_ms), "key_id string, request_id string, at_ms long, allowed boolean", "Append", "EventTime")


# Queues of what outside services are asked.

_STEP = "tenant_id string, app_id string, lookup_id string, install_record_id string, step string, status string, attempts int, at_ms long, next_attempt_ms long, reason string"


class Lookups(StatefulProcessor):
    """By lookup: attempts so far, the time of the next and the age of its token, with timers for both."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "install_record_id string, token_created_ms long, attempts int, next_attempt_ms long")
        self.done = handle.getValueState("done", "at_ms long")

    def step(self, key, item, step, at, status=None, attempts=None, following=None, reason=None) -> Row:
        return Row(tenant_id=key[0], app_id=key[1], lookup_id=key[2], install_record_id=item[0], step=step, status=status, attempts=attempts, at_ms=at, next_attempt_ms=following, reason=reason)

    def scheduled(self, item: tuple) -> None:
        self.item.update(item)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for at in {item[1] + answers.TOKEN_MS, *([item[3]] if item[3] is not None else [])}:
            self.handle.registerTimer(at)

    def completed(self, key, item: tuple, at: int, status: str) -> Row:
        self.item.clear()
        self.done.update((at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return self.step(key, item, "completed", at, status, item[2])

    def again(self, key, item: tuple, at: int, attempts: int, wait: int, reason: str) -> Row:
        item = (*item[:2], attempts, at + wait)
        self.scheduled(item)
        return self.step(key, item, "retry", at, None, attempts, at + wait, reason)

    def answered(self, key, item: tuple, row) -> Row:
        at, status = row.at_ms, row.http_status
        if at - item[1] >= answers.TOKEN_MS:
            return self.completed(key, item, at, "token_expired")
        if row.kind == "limited":
            return self.again(key, item, at, item[2], answers.LIMITED_MS, "rate_limited")
        if row.kind == "token_missing":
            return self.completed(key, item, at, "dropped")
        if status == 200 and row.outcome is not None:
            return self.completed(key, item, at, row.outcome)
        if status == 400 or (status == 404 and item[2] + 1 >= answers.MISSES):
            return self.completed(key, item, at, "lookup_unavailable")
        if status == 404:
            return self.again(key, item, at, item[2] + 1, answers.NOT_FOUND_MS, "not_found")
        attempts = min(answers.MISSES, item[2] + 1)
        return self.again(key, item, at, attempts, min(answers.MOST_MS, answers.ERROR_MS * 2**attempts), "answer_invalid" if status == 200 else f"http_{500 if status is None else status}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        item = self.item.get() if self.item.exists() else None
        for row in sorted(rows, key=lambda r: (r.kind != "queued", r.at_ms)):
            if row.kind == "queued":
                if item is None and not self.done.exists():
                    item = (row.install_record_id, row.token_created_ms, 0, None)
                    self.scheduled(item)
                    yield self.step(key, item, "due", row.at_ms, None, 0)
            elif item is not None:
                yield self.answered(key, item, row)
                item = self.item.get() if self.item.exists() else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.item.exists():
            item = self.item.get()
            if at >= item[1] + answers.TOKEN_MS:
                yield self.completed(key, item, at, "token_expired")
            elif item[3] is not None and at >= item[3]:
                item = (*item[:3], None)
                self.scheduled(item)
                yield self.step(key, item, "due", at, None, item[2])

    def close(self) -> None:
        pass


_LOOKUP_ROW = ["tenant_id", "app_id", "lookup_id", "kind", "at_ms", "install_record_id", "token_created_ms", "http_status", "outcome"]


def lookup_queue(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Steps of lookups: when each is due, asked again or completed, from a stream of what was queued and answered.

    events: tenant_id, app_id, lookup_id, kind (queued, answer, limited, token_missing), at_ms; for what is
    queued install_record_id and token_created_ms, for answers http_status and body.  A token is good for
    23 hours from its creation, whatever comes of it; not found is asked again after 5 s and given up at the third miss;
    other errors wait longer each time; an answer that cannot be read counts as an error.  Event time
    moves the timers.  A lookup is completed once: later answers, and answers to what was never queued, are
    left out, and a lookup that is queued again is not asked again.
    """
    state_store(events.sparkSession)
    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withColumn("outcome", answers.lookup_answer(F.col("body"))["status"]).withWatermark("at", delay)
    return timed.select(*_LOOKUP_ROW, "at").groupBy("tenant_id", "app_id", "lookup_id").transformWithState(Lookups(), _STEP, "Append", "EventTime")


_VERDICT = "tenant_id string, app_id string, verification_id string, subject_record_id string, verdict string, retain_evidence boolean, at_ms long"


class Verifications(StatefulProcessor):
    """By verification: what it must be bound to; the first answer decides, and none in time is unavailable."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "subject_record_id string, binding string, queued_ms long")
        self.early = handle.getListState("early", "at_ms long, http_status int, binding string, sound boolean, down boolean")
        self.done = handle.getValueState("done", "at_ms long")

    def verdict(self, key, item: tuple, at: int, answer: tuple | None) -> Row:
        _, status, binding, sound, down = answer or (at, None, None, False, True)
        good = not down and status == 200 and sound and binding is not None and binding == item[1]
        self.item.clear()
        self.early.clear()
        self.done.update((at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return Row(tenant_id=key[0], app_id=key[1], verification_id=key[2], subject_record_id=item[0], verdict="unavailable" if down else "verified" if good else "failed", retain_evidence=not down, at_ms=at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.done.exists():
            return
        item = self.item.get() if self.item.exists() else None
        for row in sorted(rows, key=lambda r: (r.kind != "queued", r.at_ms)):
            if row.kind == "queued":
                if item is None:
                    item = (row.subject_record_id, row.binding, row.at_ms)
                    self.item.update(item)
                    self.handle.registerTimer(row.at_ms + self.wait_ms)
                    waiting = sorted(tuple(x) for x in self.early.get()) if self.early.exists() else []
                    if waiting:
                        yield self.verdict(key, item, max(row.at_ms, waiting[0][0]), waiting[0])
                        return
                continue
            answer = (row.at_ms, row.http_status, row.binding, bool(row.sound), bool(row.down))
            if item is not None:
                yield self.verdict(key, item, row.at_ms, answer)
                return
            self.early.appendValue(answer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.item.exists():
            yield self.verdict(key, self.item.get(), expiredTimerInfo.getExpiryTimeInMs(), None)

    def close(self) -> None:
        pass


def integrity_queue(events: DataFrame, wait_ms: int = 300_000, delay: str = "1 minute") -> DataFrame:
    """One verdict a verification, from a stream of what was queued and answered.

    events: tenant_id, app_id, verification_id, kind (queued, answer), at_ms, provider; for what is queued
    subject_record_id and binding, for answers http_status and body.  The first answer decides: verified,
    failed, or unavailable if the provider is down; without one within ``wait_ms`` of event time it is unavailable.
    An answer that comes before its verification waits for it.
    """
    state_store(events.sparkSession)
    told = answers.integrity_observation(F.col("provider"), F.col("http_status"), F.col("body"))
    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withColumn("told", told).withWatermark("at", delay)
    binding = F.when(F.col("kind") == "queued", F.col("binding")).otherwise(F.col("told.binding"))
    rows = timed.select("tenant_id", "app_id", "verification_id", "kind", "at_ms", "subject_record_id", binding.alias("binding"), "http_status", F.col("told.sound").alias("sound"), F.col("told.down").alias("down"), "at")
    return rows.groupBy("tenant_id", "app_id", "verification_id").transformWithState(Verifications(wait_ms), _VERDICT, "Append", "EventTime")


# Signed requests, each nonce of a key once within its time to live.

class Nonces(StatefulProcessor):
    """By key and nonce: when its last use that was let through expires, forgotten when event time has passed that."""

    def __init__(self, ttl_ms: int, skew_ms: int):
        if not (ttl_ms > 0 and skew_ms >= 0):
            raise ValueError("the time to live must be positive and the skew not negative")
        self.ttl_ms, self.skew_ms = ttl_ms, skew_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.expires.get()[0] if self.expires.exists() else None
        expires = before
        for row in sorted(rows, key=lambda r: (r.at_ms, r.request_id)):
            reason = "nonce_missing" if not row.nonce or not row.key_id else "timestamp_out_of_window" if row.sent_ms is None or abs(row.at_ms - row.sent_ms) > self.skew_ms else None
            if reason is None and expires is not None and row.at_ms < expires:
                reason = "nonce_reused"
            if reason is None:
                expires = row.at_ms + self.ttl_ms
            yield Row(request_id=row.request_id, key_id=row.key_id, nonce=row.nonce, at_ms=row.at_ms, reason=reason)
        if expires != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.expires.update((expires,))
            self.handle.registerTimer(expires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.expires.exists() and self.expires.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.expires.clear()
        return iter(())

    def close(self) -> None:
        pass


def guarded_nonces(requests: DataFrame, ttl_ms: int = 600_000, skew_ms: int = 300_000, delay: str = "10 minutes") -> DataFrame:
    """Requests (request_id, key_id, nonce, sent_ms, at_ms) with the reason for which each is refused, null if it is not.

    A request is refused without a key or nonce, when the time it says it was sent is more than skew_ms
    from its receipt, and when its key used the nonce less than ttl_ms before in a request that was let
    through; one that is refused leaves no trace.  Of requests of one moment the smallest id is first.
    Requests without a key or nonce are dealt by their id, so that they do not meet in one task.
    """
    state_store(requests.sparkSession)
    missing = F.coalesce(F.col("key_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("nonce"), F.lit("")).eqNullSafe("")
    timed = requests.select("request_id", "key_id", "nonce", "sent_ms", "at_ms", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", delay)
    dealt = timed.withColumn("use", F.when(missing, F.concat(F.lit("-"), "request_id")).otherwise(F.concat(F.length("key_id"), F.lit(":"), "key_id", "nonce")))
    return dealt.groupBy("use").transformWithState(Nonces(ttl_ms, skew_ms), "request_id string, key_id string, nonce string, at_ms long, reason string", "Append", "EventTime")
