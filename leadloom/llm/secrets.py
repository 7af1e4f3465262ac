"""Secret scans with a ledger of blobs.

Every version of every file is addressed by its content. The ledger records which blob was
scanned by which rule and version; a scan looks only at pairs that are not there yet, however
many paths and versions hold the blob, and findings are joined back to all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import boxed, parked
from leadloom.llm.spans import SPAN, joined, ordered, spans


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` is shorter than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    def find(self, text: Column) -> Column:
        return spans(text, self.pattern, lambda m: F.length(m["part"]) >= self.least, self.group)


#: The base rules, in the order in which their findings are listed.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of 16 and more: shorter runs are dropped in any case.
    Rule("hex", 1, r"[0-9a-f]{16,}+"),
)
LEDGER = f"blob string, kind string, version int, spans array<{SPAN}>"


def address(content: Column) -> Column:
    """The content address of a blob; null is the empty blob."""
    return F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256)


def scan_unseen(versions: DataFrame, content: str, rules: tuple[Rule, ...], ledger: DataFrame | None = None) -> DataFrame:
    """New rows of the ledger: one for each blob and rule version not in ``ledger``.

    Each blob's text moves once, to the task of its address; copies are dropped before
    that move and again after it, so that none of a blob's copies wait for each other. What is due is found by
    addresses alone. Rules already in the ledger are not run again.
    """
    rows = versions.select(F.coalesce(F.col(content).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("text", address(F.col("text")).alias("blob"))
    if ledger is not None:
        wanted = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]
        pairs = rows.select("blob").distinct().select("blob", F.explode(F.array(*wanted)).alias("rule")).select("blob", "rule.*")
        due = pairs.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
        due = parked(due.groupBy("blob").agg(F.collect_set("kind").alias("due")), "due-blobs")
        rows = rows.dropDuplicates(["blob"]).join(due, "blob")
    else:
        rows = rows.dropDuplicates(["blob"]).withColumn("due", F.array(*(F.lit(r.kind) for r in rules)))
    none = F.array().cast(f"array<{SPAN}>")
    found = [
        F.when(
            F.array_contains("due", r.kind),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.coalesce(r.find(F.col("text")), none).alias("spans")),
        )
        for r in rules
    ]
    return rows.select("blob", F.explode(F.array_compact(F.array(*found))).alias("found")).select("blob", "found.*")


def findings(versions: DataFrame, content: str, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``versions`` with the ledger's spans of their blob.

    Adds ``blob`` and one column ``spans_<kind>`` for each rule (columns of these names are
    replaced). A blob may belong to any share of the rows; the ledger has one row for each.
    """
    none = F.array().cast(f"array<{SPAN}>")
    current = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    rows = ledger.where(F.array_contains(current, F.struct("kind", "version")))
    per_blob = rows.groupBy("blob").agg(
        *(F.max_by("spans", F.when(F.col("kind") == r.kind, 1)).alias(f"spans_{r.kind}") for r in rules)
    )
    per_blob = parked(per_blob, "blob-findings").withColumnRenamed("blob", "address")
    out = boxed(versions, blob=address(F.col(content))).join(per_blob, F.col("blob") == F.col("address"), "left")
    new = ["blob", *(f"spans_{r.kind}" for r in rules)]
    return out.select(
        *(F.col(f"row.`{c}`").alias(c) for c in versions.columns if c not in new),
        "blob", *(F.coalesce(f"spans_{r.kind}", none).alias(f"spans_{r.kind}") for r in rules),
    )


def scan(
    versions: DataFrame, content: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """``found, ledger``: findings of every row of ``versions``, and the ledger with what is new.

    ``versions`` has a row for each version of each path; ``content`` names the column of its text.
    Spans are code points, the end exclusive, from left to right without overlap in a kind.

    A null content is the empty blob and has no findings. Repeated rows are all returned; a
    blob is scanned once. Keys may be null, and other columns of ``versions`` stay as they are.
    An empty table gives no findings and leaves the ledger as it was.
    """
    new = parked(scan_unseen(versions, content, rules, ledger), "ledger")
    known = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return findings(versions, content, known, rules), known


def listed(rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of all rules of a row of ``findings`` as ``kind:start:end``, joined with commas."""
    return joined(ordered([r.kind for r in rules], [F.col(f"spans_{r.kind}") for r in rules]))
