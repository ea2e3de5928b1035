"""Drains that are killed end as one that was not; providers wait, try again and report."""

import glob

import pytest

from tidemark.operators import providers as P
from tidemark.operators import summarize
from tidemark.operators.drain import SeriesDrain


class Killed(BaseException):
    pass


FILES = [
    ("s1", "ep01_a_raw.md", "raw"), ("s1", "ep01_a.body.md", "body one"), ("s1", "ep02_b_body.md", "body two"), ("s1", "ep03_c.body.md", " "),
    ("s2", "ep01_a_raw.md", "raw"), ("s2", "ep02_x_body.md", "longer stray"), ("s2", "ep02_x.body.md", "short"), ("s2", "notes.md", "n"),
    ("s3", "ep100_z_raw.md", "raw"), ("s3", "ep100_z.body.md", "body z"), ("other", "ep01_a.body.md", "not in the queue"),
]


def start(spark, root, **more):
    d = SeriesDrain(spark, root, batch=2, buckets=2, **more)
    if d.tables["queue"].version() == 0:
        d.tables["files"].upsert(spark.createDataFrame([(s, n, len(t), t) for s, n, t in FILES], "series string, name string, size long, text string"))
        d.tables["notes"].upsert(spark.createDataFrame([("s1", 1, "ep01_a", "old text")], "series string, page int, base string, text string"))
        d.tables["queue"].upsert(spark.createDataFrame([("s1", "u"), ("s2", "u"), ("s3", "u")], "series string, url string"))
    return d


def state(d):
    return {n: sorted(map(tuple, t.read().collect())) for n, t in d.tables.items()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    steps = []
    d = start(spark, str(tmp_path_factory.mktemp("whole")), after=steps.append)
    report = {r.series: (r.pages, r.landed, r.verified) for r in d.run("a", clean_up=True).collect()}
    return steps, report, state(d)


def test_a_whole_drain(whole):
    steps, report, end = whole
    assert steps[0] == "lease" and steps[-1] == "release" and sum(s.startswith("notes-") for s in steps) == 2
    assert report == {"s1": (3, 2, 2), "s2": (2, 1, 1), "s3": (1, 1, 1)}
    assert end["notes"] == [("s1", 1, "ep01_a", "body one"), ("s1", 2, "ep02_b", "body two"), ("s2", 2, "ep02_x", "longer stray"), ("s3", 100, "ep100_z", "body z")]
    assert [f[:2] for f in end["files"]] == [("other", "ep01_a.body.md"), ("s1", "ep03_c.body.md"), ("s2", "ep01_a_raw.md"), ("s2", "notes.md")]
    assert end["queue"] == [("s2", "u")] and end["leases"] == []  # a raw text of s2 still waits for its body


@pytest.mark.parametrize("step", ["names", "notes-0", "queue"])
def test_killed_after_a_step_and_started_again(spark, tmp_path, whole, step):
    _, _, end = whole

    def kill(done):
        if done == step:
            raise Killed

    with pytest.raises(Killed):
        start(spark, str(tmp_path), after=kill).run("a", clean_up=True)
    d = start(spark, str(tmp_path))
    d.run("a", clean_up=True)
    assert state(d) == end


def test_leases_keep_others_out_until_they_end(spark, tmp_path):
    now = [100.0]
    a, b = (start(spark, str(tmp_path), lease=50.0, clock=lambda: now[0]) for _ in range(2))
    assert a.take("a").count() == 3 and b.take("b").count() == 0 and a.take("a").count() == 3
    now[0] = 151.0
    assert b.take("b").count() == 3 and a.take("a").count() == 0


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(round(s, 6))
        self.now += s


def test_back_off_and_token_bucket():
    clock, calls = Clock(), []

    def client(text):
        calls.append(clock.now)
        if len(calls) < 3:
            raise TimeoutError("503 overloaded")
        return text.upper()

    policy = P.Policy(tries=4, base=2.0, factor=3.0, most=5.0, clock=clock, sleep=clock.sleep)
    assert P.Caller(client, policy)("a") == {"value": "A", "error": None, "attempts": 3} and clock.slept == [2.0, 5.0]
    clock, calls = Clock(), [0, 0, 0]
    caller = P.Caller(lambda t: calls.append(clock.now) or t, P.Policy(rate=2.0, burst=3, clock=clock, sleep=clock.sleep))
    assert [caller("x")["value"] for _ in range(6)] == ["x"] * 6
    assert calls[3:] == [0.0, 0.0, 0.0, 0.5, 1.0, 1.5]
    clock.now += 100
    caller("x")
    assert clock.slept == [0.5, 0.5, 0.5]

    def refused(text):
        raise PermissionError("401")

    assert P.Caller(refused, P.Policy(tries=5, sleep=lambda s: 1 / 0))("a") == {"value": None, "error": "PermissionError: 401", "attempts": 1}


def test_one_client_a_task_and_errors_as_data(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()

        def client(text):
            if "bad" in text:
                raise ValueError("malformed")
            return text[::-1]

        return client

    rows = [(i, None if i == 5 else " " if i == 6 else "bad" if i == 7 else f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    got = {r.i: r.c for r in df.select("i", P.called(connect)("t").alias("c")).collect()}
    assert len(glob.glob(f"{folder}/*")) == 3
    assert got[7].error == "ValueError: malformed" and got[7].value is None and got[7].attempts == 1
    assert (got[5].value, got[5].error, got[5].attempts) == (got[6].value, got[6].error, got[6].attempts) == (None, None, 0) and got[8].value == "8t"
    out = df.where("i in (7, 8)").select(summarize.hosted(lambda t: 1 / 0 if "bad" in t else t + "!")(df["t"]).alias("s")).collect()
    assert sorted(str(r.s) for r in out) == ["None", "t8!"]
