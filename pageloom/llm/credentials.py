r"""Secret scans: multipart credential linking, with column functions only.

A credential has parts: an access identifier, a secret, an endpoint. Some parts are telling by
themselves (the base kinds). Others (a short password, a bare high-entropy word, a user name, a
service address) are weak: alone they are ordinary text. A weak candidate is reported only when a
complementary part, one that it does not overlap, lies in the same scope, a paragraph, at whatever distance.

What stands inside an address is a piece of that address: a commit number or a path that looks like a secret makes
neither its own address nor another one a credential, and is no candidate itself (a base part there is still reported). A
word before an address's ``@`` is its password and counts.

The interval join of parts against parts stays inside the row: parts are merged into one list sorted
by start, and for every part the earliest end of a complementary part before it and the latest start of one after it, in its
scope, tell whether a disjoint one exists. These are running minima and maxima, which the scope's number starts anew, so the
join is linear in the parts, moves no row, and has no group that could become hot.

Cases: a NULL or empty text has no spans; spans of different kinds may overlap and all are kept;
repeated rows are scanned each on their own; columns of any name pass through, except that ``into``
is replaced if it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.llm.arrays import match_spans, running

# The base kinds and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
# With the least length inside the pattern: a maximal run of the class matches or fails as a whole.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

# Weak candidates.
SHORT_VALUE = 6
IDENT = r"""(?i)\b(?:user(?:name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
BLOB = r"(?<![A-Za-z0-9+/_=-])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{20,}+={0,2}+"
ENDPOINT = r"""(?i)\b(?:https?|ftps?|ssh|jdbc:[a-z0-9]+|mongodb(?:\+srv)?|redis|amqps?|postgres(?:ql)?|mysql)://[^\s"'<>|]+"""
SCOPE_BREAK = r"\n[ \t\r]*\n"

KINDS = ["assign", "access", "hex", "short", "ident", "blob", "endpoint"]
_ROLE = {"assign": "secret", "access": "id", "hex": "secret", "short": "secret", "ident": "id", "blob": "secret", "endpoint": "endpoint"}
_WEAK = {"short", "ident", "blob", "endpoint"}
# What a weak part of each role needs nearby.
_NEEDS = {"secret": ["id", "endpoint"], "id": ["secret"], "endpoint": ["secret"]}
# Scopes are told apart by adding their number times this to a position.
_SCOPE, _FAR = 1 << 31, 1 << 62
# The kind number of a word before an address's @, which counts although it is inside.
_PASSWORD = len(KINDS)
_PART = "array<struct<start:int,ord:int,end:int,kind:string,role:string,weak:boolean>>"


def _value_length(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 2))


def _parts(spans: Column, kind: str, number: int | None = None) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind) if number is None else number).alias("ord"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), F.lit(_ROLE[kind]).alias("role"), F.lit(kind in _WEAK).alias("weak"),
        ),
    ).cast(_PART)


def _all_parts(text: Column) -> Column:
    """Every strong and weak part, sorted by start and then by kind as listed."""

    def split_values(found: Column) -> Column:
        long_enough = F.filter(found, lambda s: _value_length(s["hit"]) >= ASSIGN_VALUE)
        short = F.filter(found, lambda s: _value_length(s["hit"]).between(SHORT_VALUE, ASSIGN_VALUE - 1))
        return F.concat(_parts(long_enough, "assign"), _parts(short, "short"))

    found = F.concat(
        let(match_spans(text, ASSIGN), split_values),
        _parts(match_spans(text, ACCESS), "access"),
        _parts(match_spans(text, HEX), "hex"),
        _parts(match_spans(text, IDENT), "ident"),
        _parts(match_spans(text, BLOB + "(?!@)"), "blob"),
        _parts(match_spans(text, BLOB + "(?=@)"), "blob", _PASSWORD),
        _parts(match_spans(text, ENDPOINT), "endpoint"),
    )
    return F.array_sort(found)


def _linked(parts: Column, breaks: Column) -> Column:
    """Drop the weak parts that have no disjoint complementary part in their scope."""
    # breaks join the list as events of an own role, so that one set of scans answers everything
    marks = F.transform(
        breaks,
        lambda b: F.struct(
            b["start"].alias("start"), F.lit(-1).alias("ord"), b["end"].alias("end"),
            F.lit("").alias("kind"), F.lit("scope").alias("role"), F.lit(False).alias("weak"),
        ),
    ).cast(_PART)

    def placed(events: Column) -> Column:
        """Parts with their scope's offset, and whether they are inside an address."""
        ends = F.transform(events, lambda e: F.when(e["kind"] == "endpoint", e["end"]).otherwise(F.lit(-1)))
        ones = F.transform(events, lambda e: F.when(e["role"] == "scope", 1).otherwise(F.lit(0)).cast("bigint"))
        tables = F.struct(
            running(ends, F.lit(-1), lambda a, b: F.greatest(a, b), "int").alias("addressed"),
            running(ones, F.lit(0).cast("bigint"), lambda a, b: a + b, "bigint").alias("scope"),
        )

        def filled(t: Column) -> Column:
            inside = lambda e, i: (e["kind"] != "endpoint") & (e["ord"] != _PASSWORD) & (F.get(t["addressed"], i) >= e["end"])
            each = F.transform(events, lambda e, i: F.struct(
                e.alias("part"), (F.get(t["scope"], i) * F.lit(_SCOPE)).alias("offset"), ((e["role"] == "scope") | inside(e, i)).alias("silent")
            ))
            return F.filter(each, lambda x: (x["part"]["role"] != "scope") & ~(x["silent"] & x["part"]["weak"]))

        return let(tables, filled)

    def judged(rows: Column) -> Column:
        def first_ends(role: str) -> Column:
            counts = lambda x: (x["part"]["role"] == role) & ~x["silent"]
            values = F.transform(rows, lambda x: F.when(counts(x), x["part"]["end"] - x["offset"]).otherwise(F.lit(_FAR)))
            return running(values, F.lit(_FAR), lambda a, b: F.least(a, b), "bigint")

        def last_starts(role: str) -> Column:
            counts = lambda x: (x["part"]["role"] == role) & ~x["silent"]
            values = F.transform(F.reverse(rows), lambda x: F.when(counts(x), x["part"]["start"] - x["offset"]).otherwise(F.lit(-_FAR)))
            return F.reverse(running(values, F.lit(-_FAR), lambda a, b: F.greatest(a, b), "bigint"))

        roles = ["secret", "id", "endpoint"]
        tables = F.struct(*[first_ends(r).alias(f"before_{r}") for r in roles], *[last_starts(r).alias(f"after_{r}") for r in roles])

        def kept(t: Column) -> Column:
            def met(x: Column, i: Column, role: str) -> Column:
                # a value of another scope is off by a whole offset, on the side that fails
                return (F.get(t[f"before_{role}"], i) + x["offset"] <= x["part"]["start"]) | (F.get(t[f"after_{role}"], i) + x["offset"] >= x["part"]["end"])

            def reported(x: Column, i: Column) -> Column:
                needs = F.lit(False)
                for role, others in _NEEDS.items():
                    for other in others:
                        needs = needs | ((x["part"]["role"] == role) & met(x, i, other))
                return ~x["part"]["weak"] | needs

            return F.transform(F.filter(rows, reported), lambda x: x["part"])

        return let(tables, kept)

    return let(let(F.array_sort(F.concat(parts, marks)), placed), judged)


def credential_findings(text: Column) -> Column:
    """array<struct<start,ord,end,kind,role,weak>> of the reported spans, by start and kind."""

    def linked(parts: Column) -> Column:
        some = F.exists(parts, lambda p: p["weak"])
        return F.when(some, _linked(parts, match_spans(text, SCOPE_BREAK))).otherwise(parts)

    return let(_all_parts(text), linked)


def scan_credentials(docs: DataFrame, text: str = "text", into: str = "findings") -> DataFrame:
    """``docs`` with the findings of each row; row-local, every row is kept."""
    return docs.withColumn(into, credential_findings(F.coalesce(F.col(text), F.lit(""))))


def redacted(text: Column, findings: Column, mask: str = "[REDACTED]") -> Column:
    """``text`` with every finding replaced by ``mask``; overlapping findings become one mask."""

    def cut(found: Column) -> Column:
        reached = running(F.transform(found, lambda f: f["end"]), F.lit(0), lambda a, b: F.greatest(a, b), "int")
        pieces = F.zip_with(
            found,
            reached,
            lambda f, seen: F.when((f["start"] >= seen) & (f["end"] > f["start"]),
                                   F.concat(F.substring(text, seen + 1, f["start"] - seen), F.lit(mask))).otherwise(F.lit("")),
        )
        last = F.array_max(F.transform(found, lambda f: f["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.char_length(text)))

    return let(findings, lambda f: F.when(F.size(f) > 0, cut(f)).otherwise(text))
