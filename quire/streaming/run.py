"""The whole run: lease, call, classify, fold pages and keys, batch after batch, until the queue or the day is used up.

A folder that all executors and drivers share holds the run. Its state is a snapshot: pages without their texts in
buckets by queue order, and the keys. Each numbered commit says which files are the state, how many pages of each status a
bucket has, and which batches are out. A batch reads the first buckets with pending pages and the keys, replaces these
buckets and the keys, and adds its own leases, answers, changes and outcomes; so what it reads and writes doesn't depend on how many came
before. Old states are retired; the changes, each written once, are the log that holds the texts.

A lease is a page, a key and a time: each key's calls keep its spacing within a batch, between batches and, as leases
are part of the state, between drivers. Any number of drivers may work on a folder: each commits its claim as the next number, and
one that comes second looks again, so no page is out twice. A driver that is started again under its name first ends
the batches that it had out; answers that are whole are read instead of made.

Secrets are looked up for the keys of a batch and go to its tasks; they are in no file of the folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import fixed, quality, quota
from quire.functions.classify import RESPONSE, failure, token_usage, with_payload
from quire.operators import keys as K
from quire.operators import queue
from quire.sources.commits import Commits, Hadoop
from quire.sources.files import guarded
from quire.streaming.profiles import Profiles, profiled

LEASE = "book_id long, page_no int, bucket int, key_id long, at double, spacing double"
ANSWER = "book_id long, page_no int, key_id long, called_at double, status int, body string, headers map<string,string>, kind string, message string, latency_ms long"
OUTCOME = "key_id long, seq long, ts timestamp, outcome string, message string, retry_after double, rpd long"
PAGES = "book_id long, page_no int, status string, attempts int, flag_reason string, last_error string, claimed_at double, updated_at double, committed long, bucket int"
KEYS = "key_id long, state string, used_on date, used_today long, rpd_limit long, refusals int, cooldown_until double, last_used_at double, last_error string, given_rpd long, out long"
#: What a failure is to the key; a page that was not called is neither a success nor a failure.
TO_KEY = {"RateLimited": "rate_limited", "KeyRejected": "dead", "TransientError": "transient", "BadResponse": "success"}
NOT_CALLED = "NotCalled"
CALLED = ["book_id", "page_no", "key_id", "called_at", "kind", "message", "retry_after"]
#: Pages of a bucket, as a rule; versions of the state that stay.
BUCKET_PAGES, KEPT = 100_000, 5
#: Characters of what can be told from other text as a secret.
SECRET = 8


class Folder:
    """The files of a run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files, self.commits = Hadoop(spark, self.path), Commits(spark, f"{self.path}/commits")

    def made(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table as it was written, by this run or one before that was lost."""
        if not self.files.exists(f"{name}/_SUCCESS"):
            return self.put(name, make())
        return self.spark.read.parquet(f"{self.path}/{name}")

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def read(self, schema: str, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def log(self, name: str, schema: str) -> DataFrame:
        """All rows of ``changes`` or ``outcomes`` of committed batches."""
        out = self.commits.head()[1].get("out", {})
        return self.read(schema, [f"{name}/{b}" for b in self.files.names(name) if b not in out and self.files.exists(f"{name}/{b}/_SUCCESS")])

    def write_buckets(self, pages: DataFrame, name: str) -> dict[str, dict]:
        """Entries of the buckets of ``pages``, a folder each: where they are, and how many pages of each status they have."""
        pages.withColumn("part", F.col("bucket")).write.partitionBy("part").parquet(f"{self.path}/{name}")
        entries: dict[str, dict] = {}
        for r in self.read(PAGES, [name]).groupBy("bucket", "status").count().collect():  # a few rows for each bucket
            entries.setdefault(str(r.bucket), {"files": f"{name}/part={r.bucket}", "counts": {}})["counts"][r.status] = r["count"]
        return entries

    def buckets(self, head: dict, only: list[str]) -> DataFrame:
        """States of the pages of some buckets."""
        return self.read(PAGES, [head["buckets"][b]["files"] for b in only])

    def folded(self, head: dict, leases: DataFrame, changes: DataFrame, max_attempts: int, name: str) -> dict[str, dict]:
        """New entries of the buckets of leased pages, after their changes."""
        touched = [str(r[0]) for r in leases.filter("page_no > 0").select("bucket").distinct().collect()]
        return self.write_buckets(queue.fold_onto(self.buckets(head, touched), changes, max_attempts), name) if touched else {}

    def retire(self) -> None:
        """Removes states that only versions before the last few name."""
        numbers = self.commits.numbers()

        def named(v: int) -> set[str]:
            head = self.commits.read(v)
            return {e["files"] for e in head["buckets"].values()} | {head["keys"]}

        stay = set().union(*map(named, numbers[-KEPT:]))
        for v in numbers[:-KEPT]:
            for name in named(v) - stay:
                self.files.remove(name)
            self.commits.files.remove(f"{v:08d}.json")


def names_of(schema: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(schema)]


def change_of(pages: DataFrame, seq: int, kind: str, now: float) -> DataFrame:
    """The same change of all pages; page 0 stands for a book's profile and has no state."""
    own = {"book_id": F.col("book_id"), "page_no": F.col("page_no"), "seq": F.lit(seq).cast("long"), "kind": F.lit(kind), "ts": F.lit(now)}
    return pages.filter("page_no > 0").select(*[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in StructType.fromDDL(queue.CHANGE)])


def start(spark: SparkSession, folder: str, new_pages: DataFrame, now: float, bucket_pages: int = BUCKET_PAGES) -> None:
    """Puts pages (book_id, page_no) into the queue of a folder; a folder that has a queue stays as it is."""
    run = Folder(spark, folder)
    if run.commits.head()[0] >= 0:
        return
    n = max(1, -(-new_pages.count() // bucket_pages))
    none = lambda t: F.lit(None).cast(t)
    pages = new_pages.select(F.col("book_id").cast("long").alias("book_id"), F.col("page_no").cast("int").alias("page_no"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit("").alias("flag_reason"), F.lit("").alias("last_error"), none("double").alias("claimed_at"), F.lit(now).alias("updated_at"), none("long").alias("committed"))
    dealt = pages.repartitionByRange(n, *queue.KEY).withColumn("bucket", F.spark_partition_id())
    name = f"pages/v0-{uuid.uuid4().hex[:8]}"
    entries = run.write_buckets(dealt, name)  # the ranges are chosen once, here
    keys = f"keys/v0-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([], KEYS).coalesce(1).write.parquet(f"{run.path}/{keys}")
    run.commits.put(0, {"buckets": entries, "keys": keys, "out": {}})


def key_states(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """States of all given keys with their limits: new keys begin, and a limit that was given anew counts as edited."""
    fresh = K.fresh(F.col("rpd_limit"))
    given = keys.select("key_id", F.col("rpm_limit"), F.col("rpd_limit").cast("long").alias("rpd_limit"), "enabled")
    known = stored.select("key_id", F.struct(*K.STATE_FIELDS).cast(K.STATE).alias("s"), "given_rpd", "out")
    both = given.join(known, "key_id", "left")
    anew = F.col("s").isNotNull() & (F.col("given_rpd") != F.col("rpd_limit"))
    s = F.coalesce("s", fresh)
    s = F.when(anew, s.withField("rpd_limit", F.col("rpd_limit")).withField("state", F.when((s["state"] == "exhausted") & (s["used_today"] < F.col("rpd_limit")), "active").otherwise(s["state"]))).otherwise(s)
    return both.select("key_id", "rpm_limit", "enabled", F.col("rpd_limit").alias("given_rpd"), F.coalesce("out", F.lit(0)).cast("long").alias("out"), s.alias("s")).select("key_id", "rpm_limit", "enabled", "given_rpd", "out", "s.*")


def classified(answers: DataFrame) -> DataFrame:
    """Answers with ``kind`` (null for an answer to read), ``message`` and ``retry_after``."""
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    said = F.when(F.col("kind").isNull() & ~ok, failure(F.col("status"), F.col("body"), F.col("headers")))
    a = answers.withColumn("said", said)
    return a.withColumns({"kind": F.coalesce("kind", "said.kind"), "message": F.coalesce("message", "said.message"), "retry_after": F.col("said.retry_after")}).drop("said")


def judged(answers: DataFrame) -> DataFrame:
    """Classified answers with their payload and its gate; an answer without a result is a bad response."""
    body = F.when(F.col("kind").isNull(), F.col("body"))
    a = answers.select(*CALLED, F.from_json(body, RESPONSE).alias("response"), token_usage(body).alias("usage"))
    a = with_payload(a, F.col("response")).withColumns({"kind": F.coalesce("kind", F.when(F.col("payload.error").isNotNull(), "BadResponse")), "message": F.coalesce("message", "payload.error")})
    return quality.gate(a.select(*CALLED, "usage", "payload.result.*"))


def changes_of(done: DataFrame, seq: int, now: float) -> DataFrame:
    """What became of each page: the change after its claim. Pages that weren't called are given back."""
    kind = F.when(F.col("kind").isNull(), "commit").when(F.col("kind") == "BadResponse", "fail").otherwise("release")
    return done.select("book_id", "page_no", F.lit(seq).cast("long").alias("seq"), kind.alias("kind"), F.coalesce("called_at", F.lit(now)).alias("ts"), "status", "page_type", "transcription", "footnotes", "note", F.col("usage.input").cast("int").alias("input_tokens"), F.col("usage.output").cast("int").alias("output_tokens"), F.col("flag_reason").alias("reason"), F.when(F.col("kind") != NOT_CALLED, F.col("message")).alias("error"))


def outcomes_of(done: DataFrame) -> DataFrame:
    """One outcome a call, at the time of the call."""
    place = F.row_number().over(W.partitionBy("key_id").orderBy("called_at", "book_id", "page_no"))  # a batch has few calls of a key
    outcome = F.lit("success")
    for kind, name in TO_KEY.items():
        outcome = F.when(F.col("kind") == kind, name).otherwise(outcome)
    called = done.filter(~F.col("kind").eqNullSafe(NOT_CALLED))
    return called.select("key_id", place.cast("long").alias("seq"), F.timestamp_micros((F.col("called_at") * 1e6).cast("long")).alias("ts"), outcome.alias("outcome"), F.when(F.col("kind") != "BadResponse", F.col("message")).alias("message"), "retry_after", F.lit(None).cast("long").alias("rpd"))


def call_leases(leases: DataFrame, call: Callable[[dict], dict], secrets: dict[int, str], known: dict[int, dict], clock: Callable[[], float], wait: Callable[[float], None], at_once: int) -> DataFrame:
    """Each lease's call, none before its time nor sooner after the key's last one than its spacing, a key's calls all in one
    task, with what is ``known`` of its book. After a call that fails through the key or the service its other leases aren't called."""
    names = names_of(ANSWER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        next_at: dict[int, float] = {}
        ended: set[int] = set()
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                key, row = r["key_id"], {n: r[n] for n in ("book_id", "page_no", "key_id")}
                if key in ended:
                    rows.append(row | {"kind": NOT_CALLED})
                    continue
                delay = max(r["at"], next_at.get(key, 0.0)) - clock()
                if delay > 0:
                    wait(delay)
                at = clock()
                next_at[key] = at + r["spacing"]
                of_book = known.get(r["book_id"], {})
                more = {"secret": secrets.get(key)} | ({k: v for k, v in of_book.items() if (k == "sample_pages") == (r["page_no"] == 0)})
                out = guarded(call, row | more) | row | {"called_at": at}
                for name in ("body", "message"):  # neither an echo nor an error may carry the secret into a file
                    if len(secrets.get(key) or "") >= SECRET and out.get(name):
                        out[name] = out[name].replace(secrets[key], "…")
                if out.get("kind") == "TransientError" or out.get("kind") is None and not 200 <= (out.get("status") or 0) < 300:
                    ended.add(key)
                rows.append(out)
            if rows:
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names).astype(object)

    return leases.repartition(at_once, "key_id").sortWithinPartitions("at", "key_id").mapInPandas(run, ANSWER)


def claim(run: Folder, keys: DataFrame, now: float, owner: str, horizon: float, calls_a_key: int, size: int, max_attempts: int, profiles: Profiles | None = None) -> tuple[str, float | None]:
    """Takes the next pages out: ("claimed", None), ("done", None), ("no keys", None) or ("wait", seconds)."""
    day = quota.quota_day(F.timestamp_seconds(F.lit(now)).cast("timestamp_ntz"))
    said: tuple[str, float | None] = ("claimed", None)
    tried: list[str] = []

    def step(number: int, head: dict) -> dict | None:
        nonlocal said
        waiting = {b: e["counts"]["pending"] for b, e in head["buckets"].items() if e["counts"].get("pending")}
        first, held = [], 0
        for b in sorted(waiting, key=int):
            if held < size * calls_a_key:
                first.append(b)
                held += waiting[b]
        if not first:
            said = ("done", None)
            return None
        batch = f"{number + 1:08d}-{uuid.uuid4().hex[:8]}"
        tried.append(batch)
        stored = run.read(KEYS, [head["keys"]])
        states = run.put(f"keys/v{batch}", K.expire(key_states(stored, keys), now, day).coalesce(1))
        free = states.withColumn("rpd_limit", F.col("rpd_limit") - F.col("out"))  # what other batches have out is spoken for
        pending = run.buckets(head, first).filter("status = 'pending'").select("book_id", "page_no", "bucket")
        if profiles:
            pending = profiles.candidates(pending, size * calls_a_key, [b for x in head["out"].values() for b in x["books"]])
        leases = run.put(f"leases/{batch}", K.paced_lease(pending, free, now, horizon, size, calls_a_key).select(*names_of(LEASE)).coalesce(1))
        taken = leases.select("book_id", "page_no", "bucket").collect()  # ``size * calls_a_key`` leases at most
        if not taken:
            seconds = K.next_available_in(free, now, size).first()[0]
            said = ("no keys", None) if seconds is None else ("wait", max(seconds, 0.0 if not profiles else 1.0))  # others may be asking for profiles
            return None
        entries = run.folded(head, leases, change_of(leases, 2 * (number + 1), "claim", now), max_attempts, f"pages/v{batch}")
        used = leases.groupBy("key_id").agg(F.max("at").alias("last_at"), F.count("*").alias("n"))
        after = states.join(used, "key_id", "left").withColumns({"last_used_at": F.greatest("last_used_at", F.coalesce("last_at", F.lit(0.0))), "out": F.col("out") + F.coalesce("n", F.lit(0))})
        others = stored.join(states.select("key_id"), "key_id", "left_anti")  # of drivers with other keys
        run.put(f"keys/w{batch}", after.select(*names_of(KEYS)).unionByName(others).coalesce(1))
        return {"buckets": head["buckets"] | entries, "keys": f"keys/w{batch}", "out": head["out"] | {batch: {"owner": owner, "since": now, "number": number + 1, "books": [r.book_id for r in taken if r.page_no == 0]}}}

    got = run.commits.change(step)
    for k, batch in enumerate(tried, 1):
        lost = ("leases/", "pages/v", "keys/w") if got is None or k < len(tried) else ()
        for name in ("keys/v", *lost):
            run.files.remove(f"{name}{batch}")
    return said


def finish(run: Folder, batch: str, since: dict, keys: DataFrame, call, clock, wait, at_once: int, max_attempts: int, log, profiles: Profiles | None = None) -> None:
    """Calls the leases of a batch that is out and commits what came of it; it counts once, whatever is repeated."""
    leases = run.read(LEASE, [f"leases/{batch}"])
    used = [r[0] for r in leases.select("key_id").distinct().collect()]  # keys of the working set
    secrets = {r.key_id: r.secret for r in keys.filter(F.col("key_id").isin(used)).select("key_id", "secret").collect()}
    known = profiles.known([r[0] for r in leases.select("book_id").distinct().collect()]) if profiles else {}
    answers = run.made(f"results/{batch}", lambda: call_leases(leases, call, secrets, known, clock, wait, at_once))
    log("results", since["number"], answers)
    said = run.put(f"classified/{batch}", classified(answers))
    done = run.put(f"judged/{batch}", judged(said.filter("page_no > 0")))
    called = done.select(*CALLED)
    if profiles:
        asked = run.put(f"asked/{batch}", profiled(said.filter("page_no = 0"), CALLED))
        called = called.unionByName(asked.select(*CALLED))
        if since["books"]:
            profiles.save(asked.filter(~F.col("kind").eqNullSafe(NOT_CALLED)))
            log("profiles", since["number"], asked)
    changes = run.made(f"changes/{batch}", lambda: changes_of(done, 2 * since["number"] + 1, since["since"]))
    outcomes = run.made(f"outcomes/{batch}", lambda: outcomes_of(called))
    log("changes", since["number"], changes)
    log("outcomes", since["number"], outcomes)
    settle(run, batch, leases, changes, outcomes, max_attempts, log)
    for name in ("results", "classified", "judged", "asked"):
        run.files.remove(f"{name}/{batch}")


def settle(run: Folder, batch: str, leases: DataFrame, changes: DataFrame, outcomes: DataFrame, max_attempts: int, log=lambda what, number, rows: None) -> None:
    """Commits the end of a batch: pages and keys after its changes and outcomes, by whoever is first."""
    tried: list[str] = []

    def step(number: int, head: dict) -> dict | None:
        if batch not in head["out"]:
            return None
        name = f"{number + 1:08d}-{uuid.uuid4().hex[:8]}"
        tried.append(name)
        entries = run.folded(head, leases, changes, max_attempts, f"pages/v{name}")
        back = leases.groupBy("key_id").agg(F.count("*").alias("n"))
        states = K.fold_outcomes(run.read(KEYS, [head["keys"]]), outcomes).join(back, "key_id", "left").withColumn("out", F.greatest(F.lit(0).cast("long"), F.col("out") - F.coalesce("n", F.lit(0))))
        run.put(f"keys/w{name}", states.select(*names_of(KEYS)).coalesce(1))
        return {"buckets": head["buckets"] | entries, "keys": f"keys/w{name}", "out": {b: x for b, x in head["out"].items() if b != batch}}

    got = run.commits.change(step)
    for name in tried[: len(tried) - (got is not None)]:
        run.files.remove(f"pages/v{name}")
        run.files.remove(f"keys/w{name}")
    if got:
        log("keys", got[0], run.read(KEYS, [got[1]["keys"]]))
    run.retire()


def run_queue(
    spark: SparkSession,
    folder: str,
    keys: DataFrame,
    call: Callable[[dict], dict],
    clock: Callable[[], float] = time.time,
    wait: Callable[[float], None] = time.sleep,
    horizon: float = 60.0,
    calls_a_key: int = 10,
    size: int = fixed.WORKING_KEYS,
    max_attempts: int = fixed.MAX_ATTEMPTS,
    log: Callable[[str, int, DataFrame], None] = lambda what, number, rows: None,
    stop: Callable[[], bool] = lambda: False,
    owner: str = "run",
    samples: DataFrame | None = None,
) -> str:
    """Runs a started queue; returns why it ended: ``done`` (no page is pending), ``no keys`` (none will be ready today),
    ``stopped`` or ``cancelled``. ``keys``: key_id, secret, rpm_limit, rpd_limit, enabled. ``call`` gets book_id, page_no, key_id and secret and
    returns status, body, headers. A batch has the leases of the next ``horizon`` seconds, ``calls_a_key`` of a key at most. ``clock`` and ``wait``
    go to the tasks too. ``log`` hears of each table that a batch has made, key states too; ``stop`` is asked before each batch. ``owner``
    names this driver among those that work on the folder at the same time. With ``samples`` (book_id, pages, strategy) each book is profiled
    first: a call with page_no 0 gets its ``sample_pages``, and the calls of its pages get the ``profile``, as JSON."""
    run = Folder(spark, folder)
    profiles = None if samples is None else Profiles(spark, folder, samples)
    while True:
        for batch, since in run.commits.head()[1]["out"].items():
            if since["owner"] == owner:
                finish(run, batch, since, keys, call, clock, wait, size, max_attempts, log, profiles)
        if stop():
            return "stopped"
        if run.files.exists("cancel"):
            return "cancelled"
        said, seconds = claim(run, keys, clock(), owner, horizon, calls_a_key, size, max_attempts, profiles)
        if said == "wait":
            wait(seconds)
        elif said != "claimed":
            return said


def cancel(spark: SparkSession, folder: str, on: bool = True) -> None:
    """Asks all drivers of a folder to end after their batch, from any session; or takes that back."""
    files = Hadoop(spark, folder)
    files.write("cancel", "") if on else files.remove("cancel")


def progress(spark: SparkSession, folder: str) -> dict[str, int]:
    """How many pages are in which status, and how many batches are out; reads one commit."""
    _, head = Commits(spark, f"{folder.rstrip('/')}/commits").head()
    counts = dict.fromkeys(fixed.PAGE_STATUSES, 0)
    for e in head["buckets"].values():
        for status, n in e["counts"].items():
            counts[status] = counts.get(status, 0) + n
    return counts | {"total": sum(counts.values()), "batches_out": len(head["out"])}


def reset_stale(spark: SparkSession, folder: str, before: float, now: float, max_attempts: int = fixed.MAX_ATTEMPTS) -> int:
    """Gives back the pages of batches that are out since before a time, as of drivers that won't come back. Returns their number."""
    run, n = Folder(spark, folder), 0
    for batch, since in run.commits.head()[1]["out"].items():
        if since["since"] < before:
            leases = run.read(LEASE, [f"leases/{batch}"])
            given = change_of(leases, 2 * since["number"] + 1, "stale_reset", now)
            n += leases.count()
            settle(run, batch, leases, run.put(f"changes/{batch}", given), spark.createDataFrame([], OUTCOME), max_attempts)
    return n


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """All pages with their texts, as ``queue.fold`` returns them."""
    run = Folder(spark, folder)
    _, head = run.commits.head()
    return queue.with_texts(run.buckets(head, list(head["buckets"])).drop("bucket"), run.log("changes", queue.CHANGE))
