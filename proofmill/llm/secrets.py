"""Secret scans with multipart credential linking; DataFrame functions only.

Strong patterns (assignments, access identifiers, hexadecimal runs) are reported as such. Weak ones
(identifier fields, random-looking runs, endpoints) are common in clean text, so they are reported
only where their complements stand in the same scope: an identifier near a secret, an endpoint near
both. The scope is a distance in the text; parts are linked by an interval join over buckets of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.arrays import running
from proofmill.llm.arrow import unused
from proofmill.tables import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Spans of all rows of a side that is broadcast; more are shuffled.
SMALL = 1_000_000
#: Strong kinds in order: pattern, group that is measured, least characters of it.
BASE = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]+", 0, 16)}
#: Weak kinds: a named account or key identifier, a long run with digits, capitals and small letters, a URL.
WEAK = {
    "id": r"""(?i:access_?key_?id|access_?key|client_?id|account_?id|username)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}",
    "endpoint": r"""https?://[^\s"'<>()]{4,}""",
}
KINDS = [*BASE, *WEAK]
SPAN = "struct<start:bigint,end:bigint,kind:string,part:string>"


def _located(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches with their places in code points.

    What lies between matches comes from ``split``, the matches from ``regexp_extract_all``; running
    lengths of both give the places.
    """
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda gap, hit: (F.char_length(gap) + F.char_length(hit)).cast("bigint"))
    ends = running(steps, lambda x, y: x + y, 0)
    span = lambda end, hit: F.struct((end - F.char_length(hit)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("part"))
    return F.when(text.rlike(pattern), F.zip_with(ends, hits, span)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _measured(pattern: str, group: int, least: int):
    return lambda s: F.char_length(F.regexp_extract(s["part"], pattern, group)) >= least


def base_spans(text: Column) -> Column:
    """Spans of the strong kinds, by kind, then place; a null text has none."""
    out = []
    for kind, (pattern, group, least) in BASE.items():
        # runs of a single class: asking for the length in the pattern finds the same runs, faster
        fast = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}.get(kind)
        spans = _located(text, fast or pattern, kind)
        out.append(spans if fast else F.filter(spans, _measured(pattern, group, least)))
    return F.concat(*out)


def _weak_spans(text: Column, base: Column) -> Column:
    """Candidates of the weak kinds that no strong span overlaps."""
    spans = F.concat(*[_located(text, pattern, kind) for kind, pattern in WEAK.items()])
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def scan(docs: DataFrame, scope: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``key``, ``text_hash``, ``base`` and ``linked`` spans (arrays of start, end, kind, part).

    Places are code points of the whole text, end exclusive. ``linked`` has weak candidates with
    complements within ``scope``: an identifier and a secret (weak or strong) at most ``scope``
    apart, and an endpoint at most that far from the identifier of such a pair. Null and empty
    texts have no spans; repeated rows stay, each with the same spans; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = F.col("text")
    maybe = (body.rlike(WEAK["id"]) | body.rlike(BASE["access"][0])) & (body.rlike(WEAK["secret"]) | body.rlike(BASE["assign"][0]) | body.rlike(r"[0-9a-f]{16,}"))
    rows = rows.withColumn("base", base_spans(body))
    # spans only, written once: all branches of the joins read them, and texts are read once
    rows = cut(rows.select("key", "text_hash", "base", F.when(maybe, _weak_spans(body, F.col("base"))).alias("weak")))

    # parts of documents that hold a weak candidate at all; equal rows give equal parts, once
    parts = rows.where(F.size("weak") > 0).select("key", "text_hash", F.explode(F.concat(F.col("base"), F.col("weak"))).alias("s")).select("key", "text_hash", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind")).distinct()
    parts = parts.withColumn("bucket", F.floor(F.col("start") / scope))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Interval join: rows of the same text whose starts lie within the scope; right columns get a prefix."""
        spread = left.withColumn("b", F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)))
        other = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
        same = F.col("key").eqNullSafe(F.col("r_key")) & (F.col("text_hash") == F.col("r_text_hash")) & (F.col("b") == F.col("r_bucket"))
        return spread.join(other, same & (F.abs(F.col("start") - F.col("r_start")) <= scope))

    ids, secrets = parts.where(F.col("kind").isin("id", "access")), parts.where(F.col("kind").isin("secret", "assign", "hex"))
    pairs = near(ids, secrets)
    mine, theirs = ["key", "text_hash", "start", "end", "kind"], [F.col(f"r_{c}").alias(c) for c in ("key", "text_hash", "start", "end", "kind")]
    paired = pairs.select("key", "text_hash", "start", "end", "kind", "bucket").distinct()
    ends = near(paired, parts.where(F.col("kind") == "endpoint")).select(*theirs)
    reported = paired.select(*mine).unionByName(pairs.select(*theirs)).unionByName(ends).where(F.col("kind").isin(*WEAK)).distinct()
    span = F.struct("start", "end", "kind", F.lit(None).cast("string").alias("part"))
    linked = reported.groupBy(F.col("key").alias("l_key"), F.col("text_hash").alias("l_hash")).agg(F.array_sort(F.collect_list(span)).alias("linked"))
    joined = rows.drop("weak").join(linked, F.col("key").eqNullSafe(F.col("l_key")) & (F.col("text_hash") == F.col("l_hash")), "left")
    return joined.select(F.col("key").alias(key), "text_hash", "base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")).alias("linked"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind as listed in ``KINDS``, comma-joined."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, scope: int = 256, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``; rows, columns, their order and null texts stay."""
    k, h, spans, wide, ends = unused(docs.columns, "s_key", "s_hash", "spans", "wide", "ends")
    own = F.array_sort(F.transform(F.concat("base", "linked"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    found = scan(docs, scope, key, text).select(F.col(key).alias(k), F.col("text_hash").alias(h), own.alias(spans))
    found = cut(found.where(F.size(spans) > 0).dropDuplicates([k, h]))
    found = F.broadcast(found) if (found.agg(F.sum(F.size(spans))).first()[0] or 0) <= SMALL else found
    same = F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(h))
    # four bytes for each code point, so that a piece is found by its place
    joined = docs.join(found, same, "left").withColumns({wide: F.when(F.size(spans) > 0, F.encode(F.col(text), "UTF-32")), ends: running(F.transform(spans, lambda s: s["end"]), F.greatest, 0)})
    piece = lambda at, n: F.decode(F.substring(F.col(wide), (4 * at + 1).cast("int"), (4 * n).cast("int")), "UTF-32")
    before = lambda i: F.when(i > 0, F.get(F.col(ends), i - 1)).otherwise(F.lit(0).cast("bigint"))
    parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(before(i), s["start"] - before(i)), F.lit(mark))).otherwise(""))
    last = F.get(F.col(ends), F.size(ends) - 1)
    cleaned = F.concat(F.array_join(parts, ""), piece(last, F.octet_length(F.col(wide)) / 4 - last))
    return joined.select(*[F.coalesce(F.when(F.size(spans) > 0, cleaned), F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns])
