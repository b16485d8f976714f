"""Secret scans with multipart credential linking, by built-in functions only.

Base spans: assignments to a secret's name, access keys and long hex runs. Besides these, weak parts are
looked for (key-like identifiers, mixed random strings, endpoints). A weak part is reported only where its
complement co-occurs: intervals of identifiers and secrets are joined when at most `reach` code points and no
blank line (a scope's border) lie between them; an endpoint needs both. Parts never leave their document, so
the interval join is evaluated inside the row, by sort and sweep, and nothing is shuffled: the spans and borders of a
text are sorted by their start, running sums number the scopes, and running maxima carry, for each part, the furthest
end of the identifiers and of the secrets before it and the nearest start of those after it, in its scope. No pair of
parts is formed, however many a text holds.

Built-in functions give what a pattern matches but not where: the pattern is matched behind a lazy gap,
`\\G(.*?)(pattern)`, and a span's place is the running sum of the lengths of gaps and matches, in code points.
Cheap tests (contains) decide which texts need a pattern at all.

Defined cases: a null text is empty and has no spans; spans of one kind never overlap; rows are independent,
so repeated rows and null ids just repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, texts

# The base patterns (group 1: what follows the gap; group 2: an assignment's value).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE = 6
# The weak parts.
WEAK_ID = r"((?<![A-Za-z0-9])(?=[A-Z0-9]{0,31}[0-9])[A-Z][A-Z0-9]{15,31}(?![A-Za-z0-9]))"
WEAK_SECRET = r"((?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2})"
ENDPOINT = r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)"
BORDER = r"(\n[\x20\t\r]*\n)"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SPAN = "array<struct<start:int,end:int>>"
#: The least piece of a running result; a place after all others.
PIECE, FAR = 32, 1 << 62


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative `combine` over array<bigint>. A fold copies what it has gathered at each
    step, so it is done in pieces of about the square root of the length: n ** 1.5 copies, not n ** 2."""
    none = F.array().cast("array<bigint>")
    join = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(combine(F.get(acc, F.size(acc) - 1), x))))
    fold = lambda array: F.aggregate(array, none, join)

    def pieces(v: Column) -> Column:
        step = F.greatest(F.lit(PIECE), F.ceil(F.sqrt(F.size(v)))).cast("int")
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: fold(F.slice(v, i * step + 1, step)))

    def whole(own: Column) -> Column:
        ends = F.transform(own, lambda piece: F.get(piece, F.size(piece) - 1))
        carried = lambda ahead: F.transform(own, lambda piece, i: F.when(i == 0, piece).otherwise(F.transform(piece, lambda x: combine(F.get(ahead, i - 1), x))))
        return F.flatten(_let(fold(ends), carried))

    return _let(_let(values, pieces), whole)


def spans(text: Column, pattern: str, value_min: int = 0) -> Column:
    """array<struct<start, end>> of the leftmost non-overlapping matches; value_min: group 2 has so many characters at least."""
    gapped = F.lit(rf"(?s)\G(.*?){pattern}")
    part = lambda g: F.transform(F.regexp_extract_all(text, gapped, F.lit(g)), lambda s: F.length(s).cast("long"))
    ends = running(part(0), lambda a, b: a + b)
    found = F.zip_with(ends, part(2), lambda end, size: F.struct((end - size).cast("int").alias("start"), end.cast("int").alias("end")))
    if not value_min:
        return found
    longs = F.transform(part(3), lambda n: n >= value_min)
    return F.transform(F.filter(F.arrays_zip(found.alias("span"), longs.alias("long")), lambda x: x["long"]), lambda x: x["span"])


def _where(test: Column, found: Column) -> Column:
    return F.when(test, found).otherwise(F.array().cast(SPAN))


def _before(of: Column, value: Column) -> Column:
    """The largest `value` (of an element) among the elements so far that are `of` the wanted sort; -FAR where there is none."""
    return running(F.transform("_at", lambda x: F.when(of(x), value(x)).otherwise(F.lit(-FAR))), F.greatest)


def _after(of: Column, value: Column) -> Column:
    """The smallest `value` among the elements from here on; FAR where there is none."""
    turned = F.reverse(F.transform("_at", lambda x: F.when(of(x), -value(x)).otherwise(F.lit(-FAR))))
    return F.transform(F.reverse(running(turned, F.greatest)), lambda x: -x)


def linked(rows: DataFrame, reach: int) -> DataFrame:
    """rows with `_hit`, the weak parts that stay: array<struct<start, end, kind>>. rows: the spans of KINDS and borders."""
    kinds = (*KINDS, "borders")
    tagged = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kinds.index(k)).alias("kind")))
    any_weak = (F.size("weak_id") + F.size("weak_secret") + F.size("endpoint")) > 0
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    rows = rows.withColumn("_at", F.when(any_weak, F.array_sort(F.concat(*map(tagged, kinds)))).otherwise(none))
    base, border = lambda x: x["kind"] <= 2, lambda x: x["kind"] == 6
    rows = rows.withColumns({
        "_scope": running(F.transform("_at", lambda x: F.when(border(x), 1).otherwise(0).cast("long")), lambda a, b: a + b),
        "_low": _before(base, lambda x: x["end"].cast("long")), "_high": _after(base, lambda x: x["start"].cast("long")),
    })
    # weak identifiers and secrets that overlap a base span are no parts of their own
    free = lambda x: base(x["at"]) | (x["at"]["kind"] == 5) | ((x["at"]["kind"] <= 4) & (x["low"] <= x["at"]["start"]) & (x["high"] >= x["at"]["end"]))
    zipped = F.arrays_zip(F.col("_at").alias("at"), F.col("_scope").alias("scope"), F.col("_low").alias("low"), F.col("_high").alias("high"))
    part = lambda x: F.struct(*(x["at"][c].alias(c) for c in ("start", "end", "kind")), F.shiftleft(x["scope"], 32).alias("scope"))
    rows = rows.withColumn("_at", F.transform(F.filter(zipped, free), part))
    sorts = {"id": lambda x: x["kind"].isin(1, 3), "secret": lambda x: x["kind"].isin(0, 2, 4)}
    for name, of in sorts.items():
        rows = rows.withColumns({f"_{name}_end": _before(of, lambda x: x["scope"] + x["end"]), f"_{name}_start": _after(of, lambda x: x["scope"] + x["start"])})
    # places of another scope differ by 2 ** 32 and more, which is beyond any reach
    meets = lambda name, x, i: (x["scope"] + x["start"] - F.get(f"_{name}_end", i) <= reach) | (F.get(f"_{name}_start", i) - x["scope"] - x["end"] <= reach)

    def stays(x: Column, i: Column) -> Column:
        return F.when(x["kind"] == 3, meets("secret", x, i)).when(x["kind"] == 4, meets("id", x, i)).when(x["kind"] == 5, meets("id", x, i) & meets("secret", x, i)).otherwise(F.lit(False))

    return rows.withColumn("_hit", F.filter("_at", stays))


def scan(docs: DataFrame, reach: int = 256) -> DataFrame:
    """doc_id, text and one array of spans for each kind of KINDS."""
    t, low = F.col("text"), F.col("_low")
    named = F.lit(False)
    for name in NAMES:
        named = named | F.contains(low, F.lit(name))
    rows = texts(docs).withColumn("_low", ascii_lower(t))
    rows = rows.select(
        "doc_id", "text", _where(named, spans(t, ASSIGN, MIN_VALUE)).alias("assign"), _where(F.contains(t, F.lit("AKIA")), spans(t, ACCESS)).alias("access"),
        _where(F.rlike(t, F.lit("[0-9a-f]{24}")), spans(t, HEX)).alias("hex"),
    )
    rows = rows.withColumn("_ids", _where(F.rlike(t, F.lit("[A-Z0-9]{16}")), spans(t, WEAK_ID)))
    some_id = (F.size("access") > 0) | (F.size("_ids") > 0)
    rows = rows.withColumn("_secrets", _where(some_id, spans(t, WEAK_SECRET)))
    both = some_id & ((F.size("_secrets") > 0) | (F.size("assign") > 0) | (F.size("hex") > 0))
    rows = rows.select(
        "doc_id", "text", "assign", "access", "hex", F.col("_ids").alias("weak_id"), F.col("_secrets").alias("weak_secret"),
        _where(both & F.contains(t, F.lit("://")), spans(t, ENDPOINT)).alias("endpoint"), _where(both, spans(t, BORDER)).alias("borders"),
    )
    rows = linked(rows, reach)
    own = lambda kind: F.transform(F.filter("_hit", lambda x: x["kind"] == kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return rows.select("doc_id", "text", "assign", "access", "hex", own(3).alias("weak_id"), own(4).alias("weak_secret"), own(5).alias("endpoint"))


def listed(*kinds: str) -> Column:
    """kind:start:end by start, then kind as in KINDS, comma-joined."""

    def tagged(k: str) -> Column:
        return F.transform(k, lambda s: F.struct(s["start"].alias("s"), F.lit(KINDS.index(k)).alias("k"), s["end"].alias("e"), F.lit(k).alias("name")))

    return F.array_join(F.transform(F.array_sort(F.concat(*map(tagged, kinds))), lambda s: F.concat_ws(":", s["name"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(*KINDS[:3]), 256).alias("base_sha256"), listed(*KINDS).alias("spans"))
