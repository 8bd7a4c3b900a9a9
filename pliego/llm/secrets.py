"""Secret scans with multipart credential linking, in DataFrame operations only.

Base spans are assignments of secrets, access ids and long hexadecimal runs. Weak candidates (user names, service
addresses, opaque strings) mean little alone: each is reported only when the parts that make it a usable credential lie
in its scope, ``SCOPE`` characters to either side. Spans and candidates are put into all scopes of that width
they reach, parts also into the scopes beside, and joined on (text, scope) with the distance as the interval condition.

Places are code points from 0, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pliego.llm.common import text_or_empty, unused
from pliego.session import kept

# The patterns of the base spans.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so this finds the runs of [0-9a-f]+ with 24 or more
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Weak candidates.
IDENTITY = r"""([Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
ENDPOINT = r"""[a-z][a-z0-9+]*://[^\s"'<>]+"""
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"
SCOPE = 200

KINDS = ["assign", "access", "hex", "identity", "endpoint", "opaque"]  # in the order of ties
MASK = "[REDACTED]"
PIECE = 512  # characters
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _found(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Spans of the non-overlapping matches whose group has the least length of the kind.

    Splitting at the pattern gives the text between matches, so places are sums of lengths.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(between, whole, lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint"))
    ends = _running(F.slice(steps, 1, F.size(whole)), lambda x, y: x + y)
    lengths = F.zip_with(whole, value, lambda m, v: F.struct(F.length(m).cast("bigint").alias("size"), F.length(v).alias("value")))
    places = F.zip_with(ends, lengths, lambda n, x: F.struct(n.alias("end"), x["size"].alias("size"), x["value"].alias("value")))
    good = F.filter(places, lambda x: x["value"] >= LEAST.get(kind, 1))
    spans = F.transform(
        good,
        lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")),
    )
    # most texts have no match: one search of the pattern is all they cost
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _running(values: Column, join) -> Column:
    """Running totals of an array under ``join`` (sum, greatest). Each round joins every value with the one twice as far
    before it, so n values take log2(n) rounds over the array and no array grows by single values."""
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda v, i: F.when(i >= back, join(v, F.get(acc, i - back))).otherwise(v))

    return F.aggregate(rounds, values, step)


def _with_parts(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_base`` and ``_weak``, arrays of spans, in one pass over the text."""
    t = F.col(text)
    base = F.concat(_found(t, "assign", ASSIGN, 2), _found(t, "access", ACCESS), _found(t, "hex", HEX))
    rows = docs.withColumn("_base", F.array_sort(base))
    rows = rows.withColumn("_weak", _found(t, "identity", IDENTITY, 3))
    some = (F.size("_base") > 0) | (F.size("_weak") > 0)
    more = F.concat(F.col("_weak"), _found(t, "endpoint", ENDPOINT), _found(t, "opaque", OPAQUE))
    return rows.withColumn("_weak", F.when(some, more).otherwise(F.col("_weak")))


def _linked(rows: DataFrame, key: str) -> DataFrame:
    """(key, _more): the weak candidates with complementary parts in their scope, one row per text that has any."""
    some = rows.filter(F.size("_weak") > 0)
    first = lambda span, more: F.floor(F.col(f"{span}.start") / SCOPE) - more
    last = lambda span, more: F.floor(F.col(f"{span}.end") / SCOPE) + more
    weak = some.select(key, F.explode("_weak").alias("w"))
    weak = weak.withColumn("scope", F.explode(F.sequence(first("w", 0), last("w", 0))))
    part = some.select(key, F.explode(F.concat("_base", "_weak")).alias("p"))
    part = part.withColumn("scope", F.explode(F.sequence(first("p", 1), last("p", 1))))
    near = weak.join(part, [key, "scope"]).filter("p.start - w.end <= %d and w.start - p.end <= %d" % (SCOPE, SCOPE))
    near = near.filter(F.col("scope") == F.greatest(first("w", 0), first("p", 1)))  # a pair meets in the first scope of both
    kind = F.col("p.kind")
    overlaps = F.col("p.start") < F.col("w.end")
    overlaps = overlaps & (F.col("w.start") < F.col("p.end"))
    has = lambda kinds: F.max(kind.isin(kinds) & ~overlaps)
    seen = near.groupBy(key, "w").agg(
        has(["access", "identity"]).alias("who"),
        has(["assign", "hex", "opaque"]).alias("what"),
        F.max(kind.isin(["assign", "access", "hex"]) & overlaps).alias("covered"),
        has(["assign", "hex"]).alias("sure"),
    )
    weak_kind = F.col("w.kind")
    reported = (
        ((weak_kind == "identity") & F.col("sure"))
        | ((weak_kind == "opaque") & F.col("who"))
        | ((weak_kind == "endpoint") & F.col("who") & F.col("what"))
    )
    return seen.filter(reported & ~F.col("covered")).groupBy(key).agg(F.array_sort(F.collect_list("w")).alias("_more"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all spans as kind:start:end), n_linked.

    Null texts are read as empty and have no spans; repeated rows and rows without doc_id are returned each; spans that
    start together are listed in the order of ``KINDS``; other columns are ignored; an empty table gives no rows. Very long
    texts are read whole; n matches in one text take time in proportion to n log n.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    parts = _with_parts(rows, "text").select("doc_id", "_base", "_weak")
    parts = kept(parts.withColumn("_row", F.monotonically_increasing_id()), "secret-parts")
    more = _linked(parts, "_row")
    all_ = parts.join(more, "_row", "left").withColumn("_more", F.coalesce("_more", F.array().cast(SPAN)))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return all_.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("_base", "_more"))).alias("spans"),
        F.size("_more").cast("bigint").alias("n_linked"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """The text with ``MASK`` for every span (in order); one that begins before the end of those before it is part of
    their mask. The text is cut once into pieces of ``PIECE`` characters, and what lies between two spans is taken from
    the pieces it reaches, so that no span walks through the text again."""
    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    placed = F.zip_with(spans, ends, lambda s, n: F.struct(s["start"].alias("start"), n.alias("end")))
    every = F.struct(placed.alias("placed"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))

    def build(x: Column) -> Column:
        placed, pieces = x["placed"], x["pieces"]

        def between(begin: Column, end: Column) -> Column:
            first = F.floor(begin / PIECE)
            some = F.array_join(F.slice(pieces, (first + 1).cast("int"), (F.floor(end / PIECE) - first + 1).cast("int")), "")
            return F.substring(some, (begin - first * PIECE + 1).cast("int"), (end - begin).cast("int"))

        def one(s: Column, i: Column) -> Column:
            at = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(placed, i - 1)["end"])
            return F.when(s["start"] < at, F.lit("")).otherwise(F.concat(between(at, s["start"]), F.lit(MASK)))

        last = F.element_at(placed, -1)["end"]
        return F.concat(F.array_join(F.transform(placed, one), ""), between(last, F.length(text).cast("bigint")))

    return F.element_at(F.transform(F.array(every), build), 1)


def without_secrets(docs: DataFrame) -> DataFrame:
    """All documents, every span of their texts replaced by a mark; columns unchanged, n_chars (if there) counted anew
    for changed texts. Masked is what ``secrets`` reports of the text as given, linked candidates included; distances are
    not measured again between masks. Texts with neither a base span nor an identity, which have nothing to report, pass
    through untouched and are not moved."""
    given = docs.columns
    aside = {c: unused(docs, f"_given{c}") for c in given if c.lower() in ("_base", "_weak", "_row", "_more")}
    docs = docs.withColumnsRenamed(aside)  # columns of the names that are used below step aside
    text = F.col("text")
    any_ = F.coalesce(text.rlike("|".join((ASSIGN, ACCESS, HEX, IDENTITY))), F.lit(False))
    hit = _with_parts(docs.filter(any_), "text").withColumn("_row", F.monotonically_increasing_id())
    hit = kept(hit, "secret-texts")
    all_ = hit.join(_linked(hit.select("_row", "_base", "_weak"), "_row"), "_row", "left")
    spans = F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast(SPAN))))
    changed = all_.withColumn("text", F.when(F.size(spans) > 0, _masked(text, spans)).otherwise(text))
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.size(spans) > 0, count).otherwise(F.col("n_chars")))
    both = docs.filter(~any_).select(*docs.columns).unionByName(changed.select(*docs.columns))
    return both.withColumnsRenamed({other: c for c, other in aside.items()}).select(*given)
