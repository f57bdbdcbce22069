"""Secret scans in Spark expressions.

Three base kinds come from patterns: what ``split`` leaves between the matches and the
matches themselves give their places, in code points. The entropy kinds are added to
these, outside of base spans: over each run of a class's characters (hex digits of one
case, then what is left of the runs of key characters) a window of ``WIDTH`` characters
slides, and the sum of c * log2(c) over its character counts changes only by the character
that leaves and the one that enters. Windows whose Shannon entropy reaches the class's
threshold and that overlap or touch give one span, unless the allow-list knows the span.

Nulls: a null text is empty and has no spans; a null id stays null. Repeated rows give
repeated results, an empty table none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of the pattern with + that is long enough is a match of these, and no other is.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_key")
WIDTH = 20
#: All characters of candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Matches of a text whose places are summed up together.
MATCHES = 256
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits a character at which a window counts, by class.
THRESHOLD = {"entropy_hex": 3.1, "entropy_key": 3.9}
#: Known not to be secrets: no digit at all, digits alone, UUIDs, documented examples, alphabets.
ALLOWED = (r"^[^0-9]*$", r"^[0-9+/_=-]*$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"EXAMPLE|example", r"(?i)abcdefghij|0123456789")

#: Examples, alphabets and UUIDs that stand by themselves in a run: blanks before windows slide.
KNOWN = r"(?<![A-Za-z0-9])(?:EXAMPLE|example|(?i:abcdefghij(?:klmnopqrstuvwxyz)?)|0123456789|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?![A-Za-z0-9])"
#: Runs of hex digits of one case within a candidate.
HEX_RUNS = ("[0-9a-f]{20,}", "[0-9A-F]{20,}")

_RUNS = "array<struct<first:int,last:int>>"
_SPAN = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: what a lambda names is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(matches: Column, at: Column, kind: int) -> Column:
    """Spans of matches (gap, n, hit) that follow each other from ``at`` on."""
    zero = F.struct(at.alias("at"), F.lit([]).cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["n"]).alias("end"), x["hit"].alias("hit"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(matches, zero, step, lambda a: a["out"])


def found(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches: array of (start, kind, end, hit). Places are summed up
    over blocks of ``MATCHES`` matches and within them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("n"), h.alias("hit")))
    matches = F.filter(zipped, lambda m: m["n"].isNotNull())  # there is one gap more

    def summed(m: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(m), F.lit(MATCHES)), lambda b: F.slice(m, b, MATCHES))
        total = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + x["n"])
        ends = lambda bs: F.aggregate(F.transform(bs, total), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        placed = lambda bs: F.flatten(F.zip_with(bs, F.slice(ends(bs), F.lit(1), F.size(bs)), lambda block, at: _spans(block, at, kind)))
        return F.when(F.size(m) <= MATCHES, _spans(m, F.lit(0), kind)).otherwise(_let(blocks, placed))

    return F.when(text.rlike(pattern), _let(matches, summed)).otherwise(F.lit([]).cast(_SPAN))


def high_runs(text: Column, threshold: float, width: int = WIDTH) -> Column:
    """Array of (first, last): starts of the first and the last window of each run of
    windows that reach ``threshold`` and overlap or touch.

    The accumulator holds the counts of all characters of the window, as a string with a
    letter for each character of ``ALPHABET`` (from A for none), and the sum of c * log2(c).
    For each character of the text, the one that leaves the window lowers its count and the
    one that enters raises its own; the sum changes by these two.
    """
    clog = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(width + 1)])
    most = width * (math.log2(width) - threshold) + 1e-9
    places = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    event = lambda place, by: F.struct(place.alias("place"), F.lit(by).alias("by"))
    events = _let(places, lambda p: F.flatten(F.zip_with(F.slice(F.concat(F.array_repeat(F.lit(0), width), p), F.lit(1), F.size(p)), p, lambda gone, new: F.array(event(gone, -1), event(new, 1)))))
    none = F.lit(None).cast("int")
    zero = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(-width).alias("at"), none.alias("first"), none.alias("last"), F.lit([]).cast(_RUNS).alias("done"))
    closed = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    def counted(acc: Column, e: Column) -> Column:
        count = F.ascii(F.substring(acc["counts"], e["place"], F.lit(1))) - 65
        moved = lambda c: F.struct(F.overlay(acc["counts"], F.char(c + e["by"] + 65), e["place"], F.lit(1)).alias("counts"), (acc["s"] - F.get(clog, c) + F.get(clog, c + e["by"])).alias("s"), acc["at"].alias("at"), acc["first"].alias("first"), acc["last"].alias("last"), acc["done"].alias("done"))
        return _let(count, moved)

    def noted(acc: Column) -> Column:
        at = acc["at"] + 1
        high = (at >= 0) & (acc["s"] <= most)
        apart = high & (at > acc["last"] + width)
        first = F.when(apart, at).otherwise(F.coalesce(acc["first"], F.when(high, at)))
        return F.struct(acc["counts"].alias("counts"), acc["s"].alias("s"), at.alias("at"), first.alias("first"), F.when(high, at).otherwise(acc["last"]).alias("last"), F.when(apart, closed(acc)).otherwise(acc["done"]).alias("done"))

    def step(acc: Column, e: Column) -> Column:
        return F.when(e["place"] == 0, acc).when(e["by"] < 0, counted(acc, e)).otherwise(_let(counted(acc, e), noted))

    return F.aggregate(events, zero, step, lambda a: F.when(a["first"].isNull(), a["done"]).otherwise(closed(a)))


def high_windows(text: Column, threshold: float, width: int = WIDTH) -> Column:
    """(first, last): starts of the first and the last window that reach ``threshold``; nulls if none."""
    ends = lambda runs: F.struct(F.get(runs, F.lit(0))["first"].alias("first"), F.get(runs, F.size(runs) - 1)["last"].alias("last"))
    return _let(high_runs(text, threshold, width), ends)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of the spans (in order of start)."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(acc["at"], x["start"])
        more = F.concat(F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), F.greatest(x["end"] - start, F.lit(0))))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(text)


def entropy_spans(runs: Column, name: str) -> Column:
    """Spans of the windows of each run that reach the threshold of ``name``, less those that
    the allow-list knows."""
    of = lambda c: F.transform(high_runs(c["hit"], THRESHOLD[name]), lambda w: F.struct((c["start"] + w["first"]).alias("start"), F.lit(KINDS.index(name)).alias("kind"), (c["start"] + w["last"] + WIDTH).alias("end"), F.substring(c["hit"], w["first"] + 1, w["last"] - w["first"] + WIDTH).alias("hit")))
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    spans = F.filter(F.flatten(F.transform(runs, of)), lambda x: ~x["hit"].rlike(allowed))
    return F.when(F.size(runs) > 0, spans).otherwise(F.lit([]).cast(_SPAN))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``base`` and ``added`` (arrays of start, kind, end, hit), by start then kind."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    assign = F.filter(found(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["hit"], "^" + ASSIGN + "$", 2)) >= 8)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    rows = rows.select(id_col, "__text", F.array_sort(F.concat(assign, found(text, ACCESS, 1), found(text, HEX, 2))).alias("base"), found(text, KNOWN, -1).alias("__known"))
    rows = rows.select(id_col, "base", blanked(text, F.array_sort(F.concat("base", "__known"))).alias("__text"))
    rows = rows.select(id_col, "base", "__text", *[entropy_spans(found(F.col("__text"), run, 3), "entropy_hex").alias(n) for n, run in zip(("__lower", "__upper"), HEX_RUNS)])
    upper = F.filter("__upper", lambda u: ~F.exists("__lower", lambda w: (w["start"] < u["end"]) & (u["start"] < w["end"])))
    rows = rows.select(id_col, "base", "__text", F.array_sort(F.concat("__lower", upper)).alias("__hex"))
    rows = rows.select(id_col, "base", "__hex", found(blanked(F.col("__text"), F.col("__hex")), CANDIDATE, 4).alias("__runs"))
    return rows.select(id_col, "base", F.array_sort(F.concat("__hex", entropy_spans(F.col("__runs"), "entropy_key"))).alias("added"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")
