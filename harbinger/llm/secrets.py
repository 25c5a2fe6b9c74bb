"""Secret scans with multipart credential linking, in DataFrame operations only.

Base findings are the matches of three patterns. A text split at a pattern, with the
matches put back between the pieces, gives every position; lengths alone leave the scan,
one row for each match, and a running sum turns them into starts and ends (code points).
Texts that are exact copies are worked on once.

Weak parts (account identifiers, opaque runs, endpoints) mean little alone. A window over
the starts and ends of all parts of a text looks for a complementary part no more than
SCOPE characters away: a secret for an identifier or endpoint, either of these for a
secret. A part of any length is met at both its ends. Weak parts without one, and those
that overlap a base finding, are not reported. No pairs are formed.

Null texts are empty texts. Repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.llm.common import hit_filter, settle, with_hits

SCOPE = 400

# Kind, role, pattern, group whose length counts, least length; in the
# order in which kinds that start together are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
WEAK_ID = r"""(?i:(client_?id|account|user_?name|user|login|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
ENDPOINT = r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._:/@-]{4,}|\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}:[0-9]{2,5}"
KINDS = [
    ("assign", "secret", ASSIGN, 2, 8),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", "secret", r"[0-9a-f]{32,}", 0, 32),
    ("weak_id", "identifier", WEAK_ID, 2, 3),
    ("weak_secret", "secret", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    ("weak_endpoint", "endpoint", ENDPOINT, 0, 8),
]
BASE = ("assign", "access", "hex")
KEY = ["h1", "h2", "n"]


def _lengths(text: Column, pattern: str, group: int, mixed: bool) -> Column:
    """For each match: characters before it, its own, and those of ``group`` (0 to drop it)."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = F.transform(found, lambda m: F.char_length(m))
    if mixed:
        good = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        part = F.transform(found, lambda m: F.when(good(m), F.char_length(m)).otherwise(0))
    elif group:
        part = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.char_length(m))
    else:
        part = whole
    return F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("gap"), whole.alias("len"), part.alias("part"))


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the text where anything matches, and match lengths by kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = [
        F.when(
            F.col("_t").rlike(pattern),
            F.struct(F.lit(kind).alias("kind"), _lengths(F.col("_t"), pattern, group, kind == "weak_secret").alias("m")),
        )
        for kind, _, pattern, group, _ in KINDS
    ]
    rows = docs.select("doc_id", text.alias("_t"))
    rows = rows.select(
        "doc_id",
        F.xxhash64("_t").alias("h1"),
        F.hash("_t").alias("h2"),
        F.char_length("_t").alias("n"),
        F.array_compact(F.array(*kinds)).alias("parts"),
    )
    some = F.size("parts") > 0
    return rows.select("doc_id", *[F.when(some, F.col(k)).alias(k) for k in KEY], "parts")


def _located(scanned: DataFrame) -> DataFrame:
    """(key, kind, role, rank, start, stop) of every match that is long enough."""
    each = scanned.where(F.size("parts") > 0).select(*KEY, F.explode("parts").alias("p"))
    each = each.select(*KEY, "p.kind", F.posexplode("p.m").alias("i", "m"))
    each = each.dropDuplicates([*KEY, "kind", "i"])
    so_far = Window.partitionBy(*KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.gap") + F.col("m.len")).over(so_far)
    each = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("m.len"))
    least = F.create_map(*[x for kind, *_, low in KINDS for x in (F.lit(kind), F.lit(low))])
    role = F.create_map(*[x for kind, r, *_ in KINDS for x in (F.lit(kind), F.lit(r))])
    rank = F.create_map(*[x for i, (kind, *_) in enumerate(KINDS) for x in (F.lit(kind), F.lit(i))])
    kept = each.where(F.col("m.part") >= least[F.col("kind")])
    return kept.select(*KEY, "kind", role[F.col("kind")].alias("role"), rank[F.col("kind")].alias("rank"), "start", "stop")


def _linked(parts: DataFrame) -> DataFrame:
    """Weak parts with a complementary part within SCOPE and no base finding over them."""
    secret = F.col("role") == "secret"
    ends = F.array(
        F.struct(F.col("start").alias("at"), F.lit(True).alias("first")),
        F.struct(F.col("stop").alias("at"), F.lit(False).alias("first")),
    )
    each = parts.repartition(*KEY).select("*", F.explode(ends).alias("e")).select("*", "e.at", "e.first").drop("e")
    along = Window.partitionBy(*KEY).orderBy("at")

    def any_of(first: Column, frame) -> Column:
        """Whether ends of the complementary role lie in a frame."""
        found = lambda role: F.coalesce(F.max(first & role).over(frame), F.lit(False))
        return F.when(secret, found(~secret)).otherwise(found(secret))

    # parts that end at most SCOPE before a start, or start at most SCOPE after an end
    near = F.when(F.col("first"), any_of(~F.col("first"), along.rangeBetween(-SCOPE, 0))).otherwise(
        any_of(F.col("first"), along.rangeBetween(0, SCOPE))
    )
    # the farthest end of the base findings that start before this end
    base = F.when(F.col("kind").isin(*BASE) & F.col("first"), F.col("stop"))
    reach = F.max(base).over(along.rangeBetween(Window.unboundedPreceding, -1))
    over = ~F.col("first") & F.coalesce(reach > F.col("start"), F.lit(False))
    each = each.select(*parts.columns, near.alias("_near"), over.alias("_over")).where(~F.col("kind").isin(*BASE))
    each = each.groupBy(*parts.columns).agg(F.max("_near").alias("_near"), F.max("_over").alias("_over"))
    return each.where(F.col("_near") & ~F.col("_over")).select(*parts.columns)


def _reported(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the key of their text, parts to report by key)."""
    scanned = settle(_scan(docs))
    parts = settle(_located(scanned))
    return scanned, parts.where(F.col("kind").isin(*BASE)).unionByName(_linked(parts))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array of (start, rank, stop, kind), in that order, for every row."""
    scanned, kept = _reported(docs)
    per = kept.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "stop", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    out = scanned.where(F.col("h1").isNotNull()).select("doc_id", *KEY).join(per, KEY, "left")
    # texts without any match have no key and need no join
    plain = scanned.where(F.col("h1").isNull()).select("doc_id", none.alias("spans"))
    return out.select("doc_id", F.coalesce("spans", none).alias("spans")).union(plain)


def _written(spans: Column) -> Column:
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.concat_ws(",", F.transform(spans, line))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    rows = find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span replaced by its kind in angle brackets.

    Overlapping spans become one cut. Columns stay as they are; where there is a column
    ``n_chars`` it is the length of the new text. Only texts that may hold a finding are
    moved.
    """
    _, kept = _reported(docs.select(F.lit(None).alias("doc_id"), "text"))
    order = Window.partitionBy(*KEY).orderBy("start", "rank", "stop")
    before = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = kept.withColumn("_p", before).where(F.col("stop") > F.col("_p")).select(
        *KEY,
        F.struct(
            F.greatest("start", "_p").cast("int").alias("start"),
            F.col("stop").cast("int").alias("stop"),
            F.when(F.col("start") >= F.col("_p"), F.concat(F.lit("<"), "kind", F.lit(">"))).otherwise("").alias("mark"),
        ).alias("c"),
    )
    cuts = settle(cuts.groupBy(*KEY).agg(F.sort_array(F.collect_list("c")).alias("_cuts")))

    names = docs.columns
    text = F.coalesce(F.col("_text"), F.lit(""))
    body = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), F.col("text").cast("string").alias("_text"))
    body = body.select("*", F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.char_length(text).alias("n"))
    body = with_hits(body, "h1", hit_filter(cuts, "h1"))
    free = body.where("not _hit").select("_row.*")

    piece = """transform(sequence(0, size(_cuts)), i ->
        concat(
            substring(_text,
                if(i = 0, 0, get(_cuts, i - 1).stop) + 1,
                if(i = size(_cuts), length(_text), get(_cuts, i).start) - if(i = 0, 0, get(_cuts, i - 1).stop)),
            if(i = size(_cuts), '', get(_cuts, i).mark)))"""
    met = body.where("_hit").join(cuts, KEY, "left")
    met = met.withColumn("_new", F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(F.expr(f"array_join({piece}, '')")))
    kinds = dict(docs.dtypes)
    made = {"text": F.col("_new")}
    if "n_chars" in names:
        size = F.char_length("_new").cast(kinds["n_chars"])
        made["n_chars"] = F.when(F.col("_cuts").isNull(), F.col("_row.n_chars")).otherwise(size)
    return free.union(met.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names]))


def secret_sql() -> str:
    """The same digest as SQL over the table ``documents``."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = []
    for rank, (kind, role, pattern, group, least) in enumerate(KINDS):
        part = f"regexp_extract_all(text, {quote(pattern)}, {group})"
        good = f"length(p) >= {least}"
        if kind == "weak_secret":
            good += " AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[A-Za-z]')"
        kinds.append(
            f"SELECT r, '{kind}' AS kind, '{role}' AS role, {rank} AS rank, stop - length(m) AS start, stop, {good} AS good FROM ("
            f"SELECT r, m, p, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS stop FROM ("
            f"SELECT r, unnest(m) AS m, unnest(p) AS p, unnest(list_slice(g, 1, len(m))) AS g, generate_subscripts(m, 1) AS i FROM ("
            f"SELECT r, regexp_extract_all(text, {quote(pattern)}) AS m, {part} AS p,"
            f" string_split_regex(text, {quote(pattern)}) AS g FROM d)))"
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    line = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, kind, role, rank, start::BIGINT AS start, stop::BIGINT AS stop FROM ({" UNION ALL ".join(kinds)}) WHERE good),
strong AS (SELECT * FROM parts WHERE kind IN ({base})),
free AS (SELECT * FROM parts w WHERE kind NOT IN ({base}) AND NOT EXISTS (
    SELECT 1 FROM strong s WHERE s.r = w.r AND s.start < w.stop AND w.start < s.stop)),
linked AS (SELECT * FROM free w WHERE EXISTS (
    SELECT 1 FROM parts o WHERE o.r = w.r AND (o.role = 'secret') <> (w.role = 'secret')
    AND NOT (o.start < w.stop AND w.start < o.stop) AND greatest(o.start - w.stop, w.start - o.stop) <= {SCOPE})),
kept AS (SELECT * FROM strong UNION ALL SELECT * FROM linked),
per AS (SELECT r, {line} AS spans, {line} FILTER (kind IN ({base})) AS base,
    {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)} FROM kept GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)
"""
