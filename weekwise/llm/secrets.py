"""Secret scans over an incremental blob ledger.

Every version of every text is addressed by its content (SHA-256). The
ledger stores one row per (blob, rule version) that was ever scanned, with
the spans found, also when there are none. A run scans each blob only under
the rule versions it has not met yet, one copy per blob, appends what it
found, and joins the ledger back to every path that holds the blob.

A rule version names a pack of rules and is derived from the patterns, so a
changed pattern makes a new version and old blobs are scanned again under
that pack alone.

Defined results
- null text is the empty text; it is a blob like any other and has no spans.
- repeated rows and equal texts: one scan, the findings go to every row.
- several versions of one path are rows of their own and keep their findings.
- empty table: no rows, and the ledger gets none.
- extra columns pass through `report`; a column named like a result is replaced.
- spans count code points, end exclusive; equal starts are ordered by the
  rule's place in the list. A very long text is scanned whole, in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwise.llm.frames import column
from weekwise.session import materialize, scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and non-overlapping; those that are too short are dropped.

    `least` bounds the code points of `group`. A text without any of the
    `hints` (looked up in lower case) has no match and is not searched.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str, low: str) -> list[tuple[int, int]]:
        if self.hints and not any(h in low for h in self.hints):
            return []
        found = self.compiled.finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


@dataclass(frozen=True)
class Pack:
    """Rules that are versioned together."""

    name: str
    rules: tuple[Rule, ...]
    version: str = field(init=False)

    def __post_init__(self) -> None:
        text = "\n".join(f"{r.kind} {r.pattern} {r.least} {r.group} {r.any_case}" for r in self.rules)
        object.__setattr__(self, "version", f"{self.name}-{hashlib.sha256(text.encode()).hexdigest()[:12]}")


_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
BASE = Pack(
    "base",
    (
        Rule(
            "assign",
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            least=12,
            group=2,
            any_case=True,
            hints=_NAMES,
        ),
        Rule("access", r"AKIA[A-Z0-9]+", least=18, hints=("akia",)),
        # Runs of hex digits are maximal, so a bound in the pattern drops the same matches as one after it.
        Rule("hex", r"[0-9a-f]{16,}"),
    ),
)
VENDORS = Pack(
    "vendors",
    (
        Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("-----begin ",)),
        Rule("forge", r"gh[opsu]_[A-Za-z0-9]+", least=40, hints=("gho_", "ghp_", "ghs_", "ghu_")),
        Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=20, hints=("xox",)),
        Rule("cloud", r"AIza[A-Za-z0-9_-]+", least=39, hints=("aiza",)),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    ),
)
PACKS = (BASE, VENDORS)

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
LEDGER = f"blob_id string, rule_version string, spans array<{SPAN}>"
_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())])


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find(text: str, pack: Pack, first_rank: int = 0) -> list[dict]:
    """All spans of one text under one pack, by start and then by the rule's place."""
    low = text.lower()
    found = [
        {"start": s, "rank": first_rank + i, "end": e, "kind": rule.kind}
        for i, rule in enumerate(pack.rules)
        for s, e in rule.spans(text, low)
    ]
    return sorted(found, key=lambda x: (x["start"], x["rank"]))


class Ledger:
    """The table of scanned (blob, rule version) pairs, one folder per run under `path`."""

    def __init__(self, spark: SparkSession, path: str | None = None, packs: tuple[Pack, ...] = PACKS) -> None:
        self.spark, self.packs = spark, packs
        self.path = path or scratch_path(spark, "blob-ledger")

    @property
    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame:
        if not self.exists:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, docs: DataFrame, text: str = "text") -> None:
        """Scan what `docs` holds and the ledger does not."""
        packs, ranks, at = {p.version: p for p in self.packs}, {}, 0
        for p in self.packs:
            ranks[p.version], at = at, at + len(p.rules)
        versions = F.array(*[F.lit(v) for v in packs])
        blobs = docs.select(blob_id(column(docs, text)).alias("blob_id"), column(docs, text).alias("text"))
        if self.exists:
            seen = self.rows().groupBy("blob_id").agg(F.collect_set("rule_version").alias("seen"))
            blobs = blobs.join(seen, "blob_id", "left").select(
                "blob_id", "text", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")
            )
        else:
            blobs = blobs.withColumn("todo", versions)
        blobs = blobs.filter(F.size("todo") > 0).dropDuplicates(["blob_id"])

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, names, spans = [], [], []
                for blob, body, todo in zip(*(batch.column(i) for i in range(3))):
                    body = body.as_py() or ""
                    for version in todo.as_py():
                        ids.append(blob.as_py())
                        names.append(version)
                        spans.append(find(body, packs[version], ranks[version]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(spans, pa.list_(_SPAN))],
                    ["blob_id", "rule_version", "spans"],
                )

        blobs.mapInArrow(scanned, LEDGER).write.mode("append").parquet(self.path)

    def report(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with the spans of their blobs under the current rule versions, `spans` sorted."""
        current = self.rows().filter(F.col("rule_version").isin([p.version for p in self.packs]))
        found = current.groupBy("blob_id").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("found"))
        # Stored, so that the join below stands alone in its stage and Spark can split a blob that many paths hold.
        found = materialize(found.filter(F.size("found") > 0), "blob-findings")
        kept = [c for c in docs.columns if c.lower() not in ("blob_id", "spans")]
        rows = docs.select(blob_id(column(docs, text)).alias("blob_id"), F.struct(*[column(docs, c) for c in kept]).alias("row"))
        empty = F.array().cast(f"array<{SPAN}>")
        return rows.join(found, "blob_id", "left").select(
            "row.*", "blob_id", F.coalesce("found", empty).alias("spans")
        )


def spans_text(spans: Column) -> Column:
    """`kind:start:end`, joined by commas in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, ledger: Ledger | None = None, text: str = "text") -> DataFrame:
    """Bring the ledger (a new one if none is given) up to date and report the spans of every row."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, text)
    return ledger.report(docs, text)


def redact(docs: DataFrame, ledger: Ledger | None = None, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """`docs` with every span (overlapping ones together) replaced by `mask`; null texts stay null."""
    names = docs.columns
    found = scan(docs, ledger, text)
    merged = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["out"], F.substring("__text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)),
            )
            .otherwise(acc["out"])
            .alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring("__text", acc["at"] + 1, F.length("__text"))),
    )
    clean = F.when(F.size("spans") == 0, F.col("__text")).otherwise(merged)
    rows = found.withColumn("__text", column(found, text))
    return rows.select(*[clean.alias(c) if c.lower() == text.lower() else column(rows, c).alias(c) for c in names])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and digests of the spans, per row of `report`."""
    base = [r.kind for r in BASE.rules]
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(spans_text(F.filter(spans, lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )
