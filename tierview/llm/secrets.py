"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its text, so equal versions under any number of paths are one
blob. The ledger says which rules, each with its version, have scanned which blob, and what they found. A scan reads
only blobs with a rule that has not seen them, adds to the ledger, and joins the findings back to all paths.

A text is cut into pieces that each end with a match. What is told of a piece are lengths, a row each, and a running sum
over the rows of a blob and rule says where its match lies: the work grows with the pieces, however many one text has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierview.llm.session import column, written

#: Blobs without a ledger row up to which their addresses are sent to all tasks, so that only their texts are moved.
SENT_BLOBS = 100_000


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` (Java's syntax, no groups but ``group``) is kept from ``least`` characters on.

    What counts is the length of ``group``; 0 is the whole match. Matches are leftmost and do not overlap, and one
    that is too short still takes its characters. ``kept`` may be a pattern that has all kept matches of ``pattern``
    and fewer of the others; it is looked for instead.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    kept: str | None = None

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns that the scan must have. Matches of the last two are whole runs of their characters, or of
#: what is left of such a run, so that one that is too short holds none that is not.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18, kept=r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 16, kept=r"[0-9a-f]{16,}"),
)

SPAN = "struct<start:int,ord:int,kind:string,end:int>"
LEDGER = f"blob string, rule string, spans array<{SPAN}>"
_PIECE = "struct<ord:int,size:int,own:int,told:int>"


def _pieces(text: Column, rule: Rule, ord: int) -> Column:
    r"""All pieces of a text that end with a match, as structs of their length, the match's, and of what counts of it.

    ``\G`` joins the pieces without a gap, so their lengths add up to places in the text, and the last failing try does
    not start anew at every character. A last piece of nothing says that the text was scanned.
    """
    pattern = rule.kept or rule.pattern
    cut = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))

    def piece(part: Column) -> Column:
        match = F.regexp_extract(part, rf"(?:{pattern})\z", 0)
        told = F.regexp_extract(part, rf"(?:{pattern})\z", rule.group) if rule.group else match
        return F.struct(F.lit(ord).alias("ord"), F.length(part).alias("size"), F.length(match).alias("own"), F.length(told).alias("told"))

    end = F.struct(F.lit(ord).alias("ord"), F.lit(0).alias("size"), F.lit(0).alias("own"), F.lit(-1).alias("told"))
    return F.concat(F.transform(cut, piece), F.array(end)).cast(f"array<{_PIECE}>")


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(
    versions: DataFrame, path: str, text: str, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Returns the findings of all paths, and the ledger rows of this scan (``LEDGER``), to be added to the ledger.

    Findings: per row of ``versions``, ``path`` (under its name), ``blob`` and ``spans``, sorted by start and order of
    the rules; a path without findings has an empty array, a null or empty text is the empty blob. Equal rows stay as
    many as they are. Without a ledger every blob is unseen. An empty table gives empty results.

    One text of each unseen blob is moved, the first that a task meets; a blob that a third of all rows share is one row
    of each task by then. The join back moves addresses only, and a hot one is split (adaptive skew join). One task
    holds the findings of a text, as the result has them in one row.
    """
    rows = versions.select(column(path).alias("path"), F.coalesce(column(text), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", address(F.col("text")))
    found, new = _found(rows, rules, ledger)
    findings = rows.select("path", "blob").join(found, "blob", "left")
    spans = F.array_sort(F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))
    return findings.select(F.col("path").alias(path), "blob", spans.alias("spans")), new


def unseen(rows: DataFrame, rules: Sequence[Rule], ledger: DataFrame) -> DataFrame:
    """``blob, seen`` of blobs with a rule that the ledger has not: addresses only are moved. ``seen``: the others."""
    own = [rule.id for rule in rules]
    seen = ledger.where(F.col("rule").isin(own)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    left = rows.select("blob").distinct().join(seen, "blob", "left")
    return left.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).where(F.size("seen") < len(own))


def _found(rows: DataFrame, rules: Sequence[Rule], ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``rows``: blob and text. Returns blob and spans of the blobs with findings, and the new rows of the ledger."""
    texts = rows.select("blob", "text")
    if ledger is None:
        blobs = texts.dropDuplicates(["blob"]).withColumn("seen", F.array().cast("array<string>"))
    else:
        left = written(unseen(rows, rules, ledger))
        if left.count() <= SENT_BLOBS:
            blobs = texts.join(F.broadcast(left), "blob").dropDuplicates(["blob"])
        else:
            blobs = texts.dropDuplicates(["blob"]).join(left, "blob")
    each = [
        F.when(F.array_contains("seen", rule.id), F.array().cast(f"array<{_PIECE}>")).otherwise(_pieces(F.col("text"), rule, n))
        for n, rule in enumerate(rules)
    ]
    pieces = blobs.select("blob", F.posexplode(F.concat(*each)).alias("place", "p")).select("blob", "place", "p.*")
    of = Window.partitionBy("blob", "ord")
    till = F.sum("size").over(of.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    facts = F.array(*(F.struct(F.lit(r.id).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least")) for r in rules))
    placed = pieces.withColumns({"till": till, "fact": F.element_at(facts, F.col("ord") + 1)})
    span = F.struct((F.col("till") - F.col("own")).alias("start"), "ord", F.col("fact.kind").alias("kind"), F.col("till").alias("end"))
    kept = F.collect_list(F.when(F.col("told") >= F.col("fact.least"), span))
    told = placed.groupBy("blob", "ord").agg(F.first("fact.rule").alias("rule"), F.array_sort(kept).cast(f"array<{SPAN}>").alias("spans"))
    new = told.select("blob", "rule", "spans")
    own = [rule.id for rule in rules]
    known = new if ledger is None else ledger.where(F.col("rule").isin(own)).select("blob", "rule", "spans").unionByName(new)
    return known.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans")), new


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named, also for each element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _gaps(starts: Column, ends: Column, size: Column) -> Column:
    """What stands between spans and around them, as (start, size); spans that overlap are one, neighbours are two.

    ``starts`` and ``ends`` are sorted, each by itself. The n-th start begins a run of overlapping spans if all n spans
    before it have ended by then, that is, if the n-th end is not after it; likewise for what ends a run.
    """
    first = F.filter(starts, lambda s, n: (n == 0) | (F.get(ends, n - 1) <= s))
    last = F.filter(ends, lambda e, n: (n == F.size(ends) - 1) | (F.get(starts, n + 1) >= e))

    def between(x: Column) -> Column:
        till = lambda n: F.coalesce(F.get(x["first"], n), x["size"])
        return F.transform(x["last"], lambda at, n: F.struct(at.alias("start"), (till(n) - at).alias("size")))

    bounds = F.struct(first.alias("first"), F.concat(F.array(F.lit(0)), last).alias("last"), size.alias("size"))
    return _let(bounds, between)


def masked(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``; ``spans`` sorted by start."""
    # Four bytes to a character, so that a piece is found without counting from the text's beginning. The mark before a
    # piece says the order of its bytes, and is dropped.
    order = F.lit(b"\x00\x00\xfe\xff")
    starts, ends = (F.array_sort(spans[edge]) for edge in ("start", "end"))
    known = F.struct(F.encode(text, "UTF-32").alias("wide"), starts.alias("starts"), ends.alias("ends"))

    def joined(x: Column) -> Column:
        size = F.floor(F.octet_length(x["wide"]) / 4).cast("int")
        part = lambda g: F.decode(F.concat(order, F.substr(x["wide"], g["start"] * 4 + 1, g["size"] * 4)), "UTF-32")
        return F.array_join(F.transform(_gaps(x["starts"], x["ends"], size), part), mark)

    return F.when(F.size(spans) > 0, _let(known, joined)).otherwise(text)


def cleaned(df: DataFrame, text: str, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """``df`` with all its rows and columns, and the secrets in ``text`` masked; a null text stays null."""
    rows = df.select(F.struct("*").alias("row"), F.coalesce(column(text), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", address(F.col("text")))
    found, _ = _found(rows, rules, ledger)
    joined = rows.select("row", "blob").join(found, "blob", "left")
    body = F.col("row")[text]
    masks = F.when(F.size("spans") > 0, masked(body, F.array_sort("spans"))).otherwise(body)
    return joined.select(*(masks.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns))
