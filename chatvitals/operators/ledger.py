"""Calls of an extractor that cost: each is made once, whatever becomes of tasks and executors.

The ledger is a folder that all executors share, with a file for each reply, named by a digest of the extractor's name and the transcript.  A task
looks there before it calls and leaves the reply there before it goes on, so a task that runs again, a later run, or a group with the same
transcript finds it.  A call is claimed first, so attempts that run side by side (speculation) make it once: claims older by the store's clock
come first, and an attempt waits `settle` seconds before it looks at them, which has to be longer than the steps of that clock; it claims many calls
at a time and waits once for all.  A claim without a reply is void after `patience` seconds, longer than any call, and those that a claim may wait
for its call (HOLD); so at most the call during which an executor was lost is made again, that much later.

Errors are not kept: the next run asks again.  A null transcript is no call and gives a null reply and no failure."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import named_files

ENTRY = "digest string, model string, reply string"
#: Calls that a task claims together, and seconds that a claim may wait for its call to begin.
AHEAD, HOLD = 256, 10.0


class Bucket:
    """Tokens that come at a rate (a second) up to `burst`; `take` waits for one.  A rate of None never waits."""

    def __init__(self, rate: float | None, burst: float = 1.0, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = burst, clock()

    def take(self) -> None:
        if self.rate is None:
            return
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            now = self.clock()
            self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        self.tokens -= 1


class Ledger:
    """The folder as a task sees it."""

    def __init__(self, folder: str, model: str, settle: float = 0.05, patience: float = 300.0, sleep=time.sleep):
        self.fs, self.root = named_files.opened(folder)
        self.model, self.settle, self.patience, self.hold, self.sleep = model, settle, patience, min(HOLD, patience), sleep

    def _shelf(self, digest: str) -> str:
        return f"{self.root}/{digest[:3]}"

    def find(self, digest: str) -> dict | None:
        from pyarrow.fs import FileType

        path = f"{self._shelf(digest)}/{digest}.json"
        if self.fs.get_file_info(path).type == FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _put(self, path: str, data: bytes) -> None:
        with self.fs.open_output_stream(path, compression=None) as f:
            f.write(data)

    def keep(self, digest: str, reply: str | None, me: str) -> None:
        """Under a name of its own first, so that no reader meets half a reply."""
        shelf = self._shelf(digest)
        self._put(f"{shelf}/_{me}", json.dumps({"digest": digest, "model": self.model, "reply": reply}, ensure_ascii=False).encode())
        self.fs.move(f"{shelf}/_{me}", f"{shelf}/{digest}.json")

    def _claims(self, digest: str) -> list[tuple[float, str]]:
        """Claims on the call, oldest first."""
        from pyarrow.fs import FileSelector

        found = self.fs.get_file_info(FileSelector(f"{self._shelf(digest)}/_claims-{digest}", allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.base_name) for f in found)

    def _before(self, digest: str, me: str, seen: dict[tuple[str, str], float]) -> list[str]:
        """Claims older than ours that are not void; seen: when we first met them, on our own clock."""
        now, out = time.monotonic(), []
        for _, name in self._claims(digest):
            if name == me:
                break
            if now - seen.setdefault((digest, name), now) < self.patience + self.hold:
                out.append(name)
        return out

    def each(self, digests: Iterable[str], me: str, call: Callable[[str], str | None]) -> Iterator[tuple[str, str | None, Exception | None]]:
        """(digest, reply, error) of different digests: the ledger's reply, or that of the call, which is kept.  `me` names the attempt.

        Up to AHEAD calls are claimed together, so `settle` is waited once for all of them.  No call begins later than `hold` seconds after
        its claim: what is left by then is claimed anew, in smaller lots.  Lots go by digest, so no two attempts wait for each other."""
        rest, seen, ahead = sorted(set(digests)), {}, AHEAD
        while rest:
            lot, rest, began, mine, done = rest[:ahead], rest[ahead:], time.monotonic(), [], 0
            try:
                for digest in lot:
                    try:
                        if (found := self.find(digest)) is None:
                            self.fs.create_dir(f"{self._shelf(digest)}/_claims-{digest}", recursive=True)
                            self._put(f"{self._shelf(digest)}/_claims-{digest}/{me}", b"")
                            mine.append(digest)
                            continue
                    except Exception as e:  # noqa: BLE001 - one call's failure leaves the others alone
                        yield digest, None, e
                    else:
                        yield digest, found["reply"], None
                if mine:
                    self.sleep(self.settle)
                before = {digest: self._before(digest, me, seen) for digest in mine}
                for digest in list(mine):
                    reply = error = None
                    try:
                        # claims first, replies then: whoever has left its claim has left its reply before
                        while (found := self.find(digest)) is None and before[digest]:
                            self.sleep(self.settle)
                            before[digest] = self._before(digest, me, seen)
                        if found is None and time.monotonic() - began > self.hold:
                            rest = mine + rest
                            break
                        if found is None:
                            reply = call(digest)
                            self.keep(digest, reply, me)
                        else:
                            reply = found["reply"]
                    except Exception as e:  # noqa: BLE001
                        reply, error = None, e
                    self._leave(digest, me)
                    mine.remove(digest)
                    done += 1
                    yield digest, reply, error
                else:
                    done = AHEAD
            finally:
                for digest in mine:
                    self._leave(digest, me)
            ahead = min(AHEAD, 2 * ahead, max(1, 2 * done))

    def _leave(self, digest: str, me: str) -> None:
        self.fs.delete_file(f"{self._shelf(digest)}/_claims-{digest}/{me}")

    def once(self, digest: str, me: str, call: Callable[[], str | None]) -> str | None:
        """`each` for one call."""
        ((_, reply, error),) = self.each([digest], me, lambda _: call())
        if error is not None:
            raise error
        return reply


def digest(model: str, transcript: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}"), transcript).cast("binary"), 256)


def extract(texts: DataFrame, make_extractor: Callable[[], Callable[[str], str]], folder: str, model: str, per_minute: float | None = None, key: str = "group_key", settle: float = 0.05, patience: float = 300.0) -> DataFrame:
    """(group, reply, failure) as issues.extract gives it, with a ledger in `folder`; `model` names whatever bears on a reply (model, prompt, version).

    per_minute bounds the calls of the whole cluster: the tasks that can run at a time share it evenly."""
    spark = texts.sparkSession
    where, slots = named_files.uri(spark, folder), spark.sparkContext.defaultParallelism
    rate = per_minute / 60.0 / slots if per_minute else None

    def run(frames):
        import uuid

        ledger, bucket, call, me = Ledger(where, model, settle, patience), Bucket(rate), None, uuid.uuid4().hex

        def paid(text):
            nonlocal call
            bucket.take()
            call = call or make_extractor()
            return call(text)

        for frame in frames:
            text = {name: t for name, t in zip(frame["_digest"], frame["transcript"]) if t is not None}
            answers = {name: (reply, error and f"{type(error).__name__}: {error}") for name, reply, error in ledger.each(text, me, lambda name: paid(text[name]))}  # noqa: B023 - used up at once
            found = [answers.get(name, (None, None)) for name in frame["_digest"]]
            yield frame[[key]].assign(reply=[reply for reply, _ in found], failure=[failure for _, failure in found])

    kind = texts.schema[key].dataType.simpleString()
    # calls take long and texts are small: more tasks than blocks of bytes would give
    tasks = max(slots, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return texts.select(key, "transcript", digest(model, F.col("transcript")).alias("_digest")).repartition(tasks).mapInPandas(run, f"{key} {kind}, reply string, failure string")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, model, reply) of all calls in the ledger."""
    return spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(named_files.uri(spark, folder))
