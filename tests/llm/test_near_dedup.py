import random
from contextlib import contextmanager
from itertools import combinations

from harbinger.llm.common import components
from harbinger.llm.near_dedup import drop_near_duplicates, link_documents


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k=4, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {(d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)}


def test_matches_all_pairs(spark):
    draw = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        base = draw.choices(vocab, k=draw.randint(3, 90))
        for _ in range(draw.randint(1, 8)):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(vocab)
            rows.append((len(rows) + 100, " ".join(copy)))
    shared = " ".join(draw.choices(vocab, k=55))
    rows += [(len(rows) + 100 + i, shared + " " + " ".join(draw.choices(vocab, k=40))) for i in range(60)]
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 80)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_busy_group_of_near_copies(spark):
    draw = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(420):
        copy = list(base)
        for _ in range(draw.randint(1, 4)):
            copy[draw.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_odd_rows(documents):
    got = sorted((tuple(r) for r in link_documents(documents, 4).collect()), key=str)
    by = {}
    for d, n, c, kept in got:
        by.setdefault(d, []).append((n, c, kept))
    assert by[1] == [(57, 1, True)] and by[2] == [(57, 1, False)]
    assert by[3] == [(57, 1, False)] * 2
    assert by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)] and by[6] == [(0, 6, True)]
    assert by[7] == [(1, 7, True)] and by[8] == [(1, 7, False)]
    assert by[None] == [(57, 1, False)]


def test_drop_keeps_one_of_each_group(documents):
    out = drop_near_duplicates(documents, k=4)
    assert out.columns == documents.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "10", "4", "5", "6", "7", "9", "None"]


def test_empty_table(empty):
    assert link_documents(empty).collect() == []
    assert drop_near_duplicates(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (160, 201)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)} | {160: 160, 201: 160}


def test_rows_that_share_an_id(spark):
    """Each text is linked by itself, whatever the order of the rows."""
    a = " ".join(f"first{i}" for i in range(60))
    b = " ".join(f"second{i}" for i in range(60))
    near_b = b.replace("second30 ", "other ")
    rows = [(5, a), (5, b), (7, near_b), (9, a), (5, a)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        frame = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        out = sorted((r.doc_id, r.component_id, r.kept) for r in link_documents(frame).collect())
        assert out == [(5, 5, True)] * 3 + [(7, 5, False), (9, 5, False)]
        left = sorted((r.doc_id, r.text) for r in drop_near_duplicates(frame).collect())
        assert left == sorted([(5, a), (5, b)])
    # two near texts under one id: one of them stays
    frame = spark.createDataFrame([(5, b), (5, near_b), (6, "short text")], "doc_id long, text string")
    left = sorted((r.doc_id, r.text) for r in drop_near_duplicates(frame).collect())
    assert [i for i, _ in left] == [5, 6]


def test_each_text_is_hashed_once(spark):
    """A second evaluation needs a second Python worker for each task, which then stays."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words are said here"), (None, "a b")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]


@contextmanager
def many_partitions(spark, n):
    wanted = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def tasks_of(spark, group, work):
    """What ``work`` returns, and the tasks it ran."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = work()
        context._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)


def test_rounds_of_components_have_the_tasks_their_edges_need(spark):
    # the driver keeps a record of every task: few edges must not cost a task for each shuffle partition in each round
    rows = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (2, 1)]
    edges = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    with many_partitions(spark, 50):
        got, tasks = tasks_of(spark, "components", lambda: {tuple(r) for r in components(edges, "a", "b").collect()})
    assert got == {(i, 0) for i in range(61)} | {(100 + i, 100) for i in range(40)}
    assert tasks < 10 * 50


def test_components_of_more_edges_than_a_task_takes(spark, monkeypatch):
    monkeypatch.setattr("harbinger.llm.common.parts_for", lambda rows, each=20: max(1, -(-rows // 20)))
    draw = random.Random(3)
    rows = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)]
    root = list(range(200))
    for _ in range(200):
        for a, b in rows:
            root[a] = root[b] = min(root[a], root[b])
    ends = {x for a, b in rows if a != b for x in (a, b)}
    got = components(spark.createDataFrame(rows, "a long, b long"), "a", "b")
    assert {tuple(r) for r in got.collect()} == {(x, root[x]) for x in ends}
