"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings - assignments, access identifiers and long hexadecimal runs - are always reported. Weak candidates - account
names, short or opaque secrets, endpoints - are reported only where a complementary part stands beside them: an identifier
beside a secret, a secret beside an identifier or an endpoint, an endpoint beside an identifier or a secret. Beside means
disjoint and at most ``reach`` code points away, so no part is its own complement. The scope of a link is one text.

The interval join runs inside the row, since the parts of a text are an array of it: the ends of the complementary parts
and the starts of the weak parts are sorted together, and a running maximum gives each weak part the nearest end before it;
the same in mirrored positions gives the nearest start after it. Running values are made by doubling strides, so a text with
n parts costs n log n, no pairs are made and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.binding import let
from candela.llm.common import fresh

#: Fixed patterns of the base kinds, in their order; the least length applies to the group named after it.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so the bound may stand in the pattern
)
#: Weak kinds and their roles.
WEAK = (
    ("weak_id", r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]+"""),
    ("weak_secret", r"""(?i)\b(?:pwd|pass|passphrase|private_?key|auth|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    ("opaque", r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}"),
    ("endpoint", r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+"""),
)
ORDER = [k for k, *_ in BASE] + [k for k, _ in WEAK]
ROLES = {"assign": "s", "access": "i", "hex": "s", "weak_id": "i", "weak_secret": "s", "opaque": "s", "endpoint": "e"}
REACH = 200

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
#: By asking role: the roles that complete it.
COMPLEMENTS = {"i": "s", "s": "ie", "e": "is"}
#: Strides of ``running``: together they reach over any array.
STRIDES = [8**j for j in range(10)]


def running(values: Column, combine: Callable[..., Column]) -> Column:
    """Running ``combine`` of an array: after the round of a stride each place has the values of the next 8 strides before it."""

    def round_of(stride):
        step = lambda v: F.transform(v, lambda x, i: combine(x, *(F.get(v, i - F.lit(k * stride)) for k in range(1, 8))))
        return lambda v: F.when(F.size(v) > stride, step(v)).otherwise(v)

    for stride in STRIDES:
        values = let(values, round_of(stride))
    return values


def total(*values: Column) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + F.coalesce(v, F.lit(0).cast("bigint"))
    return out


def found(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches in order: code points since the match before, own code points, rank, kind, and whether
    the group is long enough to count."""
    rank = ORDER.index(kind)

    def gap_and_hit(hits):
        def one(h, g):
            value = F.length(F.regexp_extract(h, pattern, group)) if group else F.length(h)
            return F.struct(F.length(g).cast("bigint").alias("gap"), F.length(h).cast("bigint").alias("hit"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (value >= least).alias("counts"))

        return F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), one)

    none = F.array().cast("array<struct<gap:bigint,hit:bigint,rank:int,kind:string,counts:boolean>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, gap_and_hit(hits)).otherwise(none))


def placed(hits: Column) -> Column:
    """Matches of one kind to spans in code points, end exclusive, without those that don't count."""

    def spans(ends):
        at = F.transform(hits, lambda h, i: F.struct((F.get(ends, i) - h["hit"]).alias("start"), h["rank"].alias("rank"), F.get(ends, i).alias("end"), h["kind"].alias("kind"), h["counts"].alias("counts")))
        return F.transform(F.filter(at, lambda s: s["counts"]), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))

    return F.when(F.size(hits) > 0, let(running(F.transform(hits, lambda h: h["gap"] + h["hit"]), total), spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def spans_of(text: Column) -> Column:
    """All parts of a text, base and weak, kind by kind."""
    kinds = F.array(*(found(text, *k) for k in (*BASE, *WEAK)))
    none = F.array().cast(f"array<{SPAN}>")
    return let(kinds, lambda k: F.when(F.exists(k, lambda h: F.size(h) > 0), F.flatten(F.transform(k, placed))).otherwise(none))


def with_role(parts: Column, roles: str) -> Column:
    return F.filter(parts, lambda p: p["kind"].isin([k for k in ORDER if ROLES[k] in roles]))


def linked(parts: Column, reach: int = REACH) -> Column:
    """The weak ones of ``parts`` that have a complementary part beside them, in order."""
    cases = []
    for asking, wanted in COMPLEMENTS.items():
        have, ask = with_role(parts, wanted), F.filter(with_role(parts, asking), lambda p: p["rank"] >= len(BASE))
        for sign, own, far in ((1, "start", "end"), (-1, "end", "start")):
            marks = F.transform(have, lambda p: F.struct((p[far] * sign).alias("pos"), F.lit(0).alias("asks"), (p[far] * sign).alias("end"), F.lit(None).cast(SPAN).alias("span")))  # noqa: B023
            asks = F.transform(ask, lambda p: F.struct((p[own] * sign).alias("pos"), F.lit(1).alias("asks"), F.lit(None).cast("bigint").alias("end"), p.alias("span")))  # noqa: B023
            cases.append(F.when((F.size(marks) > 0) & (F.size(asks) > 0), F.sort_array(F.concat(marks, asks))))

    def beside(events):
        near = lambda ends: F.transform(F.filter(F.transform(events, lambda e, i: F.when((e["asks"] == 1) & (e["pos"] - F.get(ends, i) <= reach), e["span"])), lambda s: s.isNotNull()), lambda s: s)
        return let(running(F.transform(events, lambda e: e["end"]), F.greatest), near)

    both = F.sort_array(F.flatten(F.transform(F.filter(F.array(*cases), lambda e: e.isNotNull()), beside)))
    return let(both, lambda b: F.filter(b, lambda s, i: (i == 0) | (s != F.get(b, i - 1))))  # found on either side, or on both


def scan(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """``keep`` columns (all by default), n_assign, n_access, n_hex and spans (array of start, rank, end, kind, in order).

    Null and empty texts have no spans; very long ones are searched whole; every row is scanned by itself, so null or
    repeated ids and repeated rows do no harm; no rows, no rows. A kept column with a result's name is replaced by the
    result.
    """
    results = ["n_assign", "n_access", "n_hex", "spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    parts = fresh(docs, "scan_parts")
    rows = docs.select(*keep, spans_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(parts))
    weak = F.exists(parts, lambda s: s["rank"] >= len(BASE))
    base = F.filter(parts, lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter(parts, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.when(weak, F.concat(base, linked(F.col(parts), reach))).otherwise(F.col(parts))
    return rows.select(*keep, *(count(k) for k, *_ in BASE), F.sort_array(spans).alias("spans"))


def listed(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end, comma-joined."""
    chosen = F.filter(spans, lambda s: s["rank"] < len(BASE)) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every run of overlapping or touching ``spans`` (in order of their starts) replaced by ``mark``."""

    def cut(ends):  # ends: the furthest end so far
        begins = lambda i: (i == 0) | (F.get(spans, i)["start"] > F.get(ends, i - 1))
        runs = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint")).alias("from"), begins(i).alias("new"))), lambda r: r["new"])
        heads = F.transform(runs, lambda r: F.concat(F.substring(text, (r["from"] + 1).cast("int"), (r["a"] - r["from"]).cast("int")), F.lit(mark)))
        return F.concat(F.array_join(heads, ""), F.substring(text, (F.get(ends, F.size(ends) - 1) + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, let(running(F.transform(spans, lambda s: s["end"]), F.greatest), cut)).otherwise(text)
