import hashlib
import random
import re

from harbinger.llm.secrets import BASE, KINDS, SCOPE, _linked, find_secrets, mask_secrets, secret_digest

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans_and_digest(spark):
    draw = random.Random(2)
    bits = ["é ", "token=", "Secret : ", "abcdefgh1", "API_KEY='", "zz", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, " ", "\n", "password", "=", '"']
    rows = [(i, "".join(draw.choices(bits, k=draw.randint(0, 40)))) for i in range(150)]
    rows += [(150, "token=token:abcdefgh"), (151, None), (152, "")]
    got = {r.doc_id: r for r in secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = base(text)
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3)), text
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def weak(spark, text):
    (row,) = find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return [s.kind for s in row.spans]


def test_weak_parts_need_a_partner(spark):
    run = "Zx9Kd83kQpLm20fjRt55"
    assert weak(spark, f"id {run} alone") == []
    assert weak(spark, f"login: bob99 uses {run}") == ["weak_id", "weak_secret"]
    assert weak(spark, f"db://host.example:5432 with {run}") == ["weak_endpoint", "weak_secret"]
    assert weak(spark, f"login: bob99 {'far ' * 200} {run}") == []
    assert weak(spark, "login: bob99 at db://host.example:5432") == []


def linked(parts):
    """Reported (kind, start, stop) by comparing all pairs."""
    over = lambda p, q: q[3] < p[4] and p[3] < q[4]
    near = lambda p, q: (p[1] == "secret") != (q[1] == "secret") and not over(p, q) and max(q[3] - p[4], p[3] - q[4]) <= SCOPE
    free = [p for p in parts if p[0] not in BASE and not any(q[0] in BASE and over(p, q) for q in parts)]
    return {(p[0], p[3], p[4]) for p in free if any(near(p, q) for q in parts)}


def test_links_equal_all_pairs(spark):
    draw = random.Random(5)
    role = {kind: r for kind, r, *_ in KINDS}
    rank = {kind: i for i, (kind, *_) in enumerate(KINDS)}
    rows, want = [], {}
    for n in range(400):
        parts = []
        for kind in draw.sample(list(role), draw.randint(2, 4)):
            start = draw.randrange(2500)
            size = draw.choice([20, 30, 399, 400, 401, 900, 2000])
            parts.append((kind, role[kind], rank[kind], start, start + size))
        rows += [(n, n, n, *p) for p in parts]
        want[n] = linked(parts)
    # every gap about SCOPE at every kind of offset, before and after, short and long parts
    for n, (gap, offset, size) in enumerate([(g, o, s) for g in (1, 395, 400, 401) for o in range(0, 400, 13) for s in (20, 30, 950)], 1000):
        a = ("weak_secret", "secret", 4, offset, offset + size)
        b = ("weak_id", "identifier", 3, offset + size + gap, offset + size + gap + 12)
        rows += [(n, n, n, *a), (n, n, n, *b)]
        want[n] = {(p[0], p[3], p[4]) for p in (a, b)} if gap <= SCOPE else set()
    table = spark.createDataFrame(rows, "h1 long, h2 int, n int, kind string, role string, rank int, start long, stop long")
    got = {}
    for r in _linked(table).collect():
        assert (r.kind, r.start, r.stop) not in got.setdefault(r.h1, set())
        got[r.h1].add((r.kind, r.start, r.stop))
    assert got == {n: x for n, x in want.items() if x}


def test_partner_starts_after_a_scope_end(spark):
    run = "Zx9Kd83kQpLm20fjRt55Zx9Kd83kQp"
    text = "- " * 195 + run + " -" * 197 + " login: bob99"
    assert weak(spark, text) == ["weak_secret", "weak_id"]
    assert weak(spark, run * 20 + " login: bob99") == ["weak_secret", "weak_id"]


def test_mask_and_odd_rows(spark, documents, empty):
    out = mask_secrets(documents)
    assert out.columns == documents.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, documents.collect()))
    rows = [(1, "é token: abcdefgh1 é", 99), (1, "é token: abcdefgh1 é", 99), (2, None, None)]
    got = mask_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "é <assign> é", 12)] * 2 + [(2, None, None)]
    assert find_secrets(empty).collect() == [] and mask_secrets(empty).collect() == []
