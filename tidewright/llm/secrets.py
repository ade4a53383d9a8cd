"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text at a path is addressed by its SHA-256 (the blob). The
ledger, Parquet tables in one folder, holds which (blob, rule version) pairs have
been scanned, the spans found in each and every blob that a path has shown. A scan takes the distinct blobs of a
table, anti-joins those that the ledger has, runs the rules on the rest, appends,
and joins the findings back to every path that shows the blob.

Spans come from two built-in functions: the matches of a pattern and the gaps
between them, whose lengths add up to code point offsets in a window over the
blob's own rows. The base rules are assign, access and hex; pem and jwt add spans.
A scan reports a private key by its opening line (as the SQL of op8 states it); a
redaction has rules of its own version, whose pem spans the whole key.

Null text is the empty text. Null or repeated ids: each row is returned; each pair of
id and text is one version of that path. Spans of equal starts stand in the order of
their rules. A long text's spans are rows, and offsets sum up in a window over one
text's own spans. An empty table has no rows. ``redact`` keeps other columns, whatever
their names. A blob's findings are appended before the blob counts as scanned, so a
job that dies in between scans it again; repeated findings are read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace, exists, write
from tidewright.llm.columns import numbered
from tidewright.llm.spread import hot_keys, spread_left_join


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int
    value_group: int = 0
    base: bool = True


RULE_VERSION = 1
# The kinds in their order, their patterns and the least length of the value.
# A hex or access match is a whole run, so its length can stand in the pattern; an assign match can hold
# the start of another, so short ones are matched and then dropped.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, base=False),
)

# A private key from BEGIN to the next END. Where another mark or the text's end comes first: its headers and the
# base64 lines that follow, parted by breaks, quotes or comment signs, with one last, shorter line. All loops are
# possessive, so that a long key neither backtracks nor recurses.
_BREAK = r"""(?:\s|\\[nrt]|["'+,>#*|\\])"""
_KEY_BODY = rf"(?:{_BREAK}++(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_BREAK}++[A-Za-z0-9+/=]{{20,}}+)*+(?:(?<=[A-Za-z0-9+/=]{{20}}){_BREAK}++[A-Za-z0-9+/=]{{1,19}}+(?=[ \t]*+[\r\n\"'\\]|[ \t]*+\z))?+"
_KEY = rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----|{_KEY_BODY})"
#: Lines without which a key is not known as one: whatever drops lines before a redaction has to spare them.
KEY_MARK = r"-----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----"
REDACTION_VERSION = 2
REDACTION_RULES = tuple(Rule("pem", _KEY, 1, base=False) if r.kind == "pem" else r for r in RULES)


def body(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rank, kind, start, end) of every span in (blob, text); rank is the rule's place."""
    hits = blobs.select("blob", "text", *[F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias(f"hits_{i}") for i, r in enumerate(rules)])
    hits = hits.where(" or ".join(f"size(hits_{i}) > 0" for i in range(len(rules))))

    def lengths(parts: Column) -> Column:
        return F.transform(parts, F.char_length)

    def one(i: int, rule: Rule) -> Column:
        matched = F.col(f"hits_{i}")
        values = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.value_group)) if rule.value_group else matched
        zipped = F.arrays_zip(
            lengths(F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(matched))).alias("gap"),
            lengths(matched).alias("hit"),
            lengths(values).alias("value"),
        )
        return F.when(F.size(matched) > 0, F.struct(F.lit(i).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), zipped.alias("parts")))

    per_rule = hits.select("blob", F.explode(F.array_compact(F.array(*[one(i, r) for i, r in enumerate(rules)]))).alias("found"))
    rows = per_rule.select("blob", "found.rank", "found.kind", "found.least", F.posexplode("found.parts").alias("n", "part"))
    so_far = Window.partitionBy("blob", "rank").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("part.gap") + F.col("part.hit")).over(so_far))
    kept = placed.where(F.col("part.value") >= F.col("least"))
    return kept.select("blob", "rank", "kind", (F.col("end") - F.col("part.hit")).alias("start"), "end")


class Ledger:
    """What has been scanned, what was found, and which paths have shown each blob, under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.scanned_path, self.findings_path, self.paths_path = (f"{folder}/{name}" for name in ("scanned", "findings", "paths"))

    def _read(self, path: str, schema: str) -> DataFrame:
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def scanned(self) -> DataFrame:
        return self._read(self.scanned_path, "blob binary, version int")

    def findings(self) -> DataFrame:
        return self._read(self.findings_path, "blob binary, version int, rank int, kind string, start long, end long")

    def paths(self) -> DataFrame:
        """(path, blob) of every version of every path."""
        return self._read(self.paths_path, "path string, blob binary")

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, version: int = RULE_VERSION, path: str = "doc_id") -> None:
        """Scan the blobs of ``docs`` that this version has not seen, and note which blob each value of the column ``path`` shows."""
        text = body(docs)
        blobs = docs.select(blob_of(text).alias("blob"), text.alias("text"))
        if exists(self.spark, self.scanned_path):
            blobs = blobs.join(self.scanned().where(F.col("version") == version).hint("merge"), "blob", "left_anti")
        spans = find_spans(blobs.dropDuplicates(["blob"]), rules)
        spans = spans.select("blob", F.lit(version).alias("version"), F.col("rank").cast("int").alias("rank"), "kind", F.col("start").cast("long"), F.col("end").cast("long"))
        write(spans, self.findings_path, "append")
        shown = docs.select(F.col(path).cast("string").alias("path"), blob_of(text).alias("blob")).distinct()
        if exists(self.spark, self.paths_path):
            known = self.paths().select(F.col("path").alias("known_path"), F.col("blob").alias("known_blob"))
            shown = shown.join(known, shown["path"].eqNullSafe(known["known_path"]) & (shown["blob"] == known["known_blob"]), "left_anti")
        write(shown, self.paths_path, "append")
        fresh = docs.select(blob_of(text).alias("blob")).distinct()
        if exists(self.spark, self.scanned_path):
            fresh = fresh.join(self.scanned().where(F.col("version") == version), "blob", "left_anti")
        write(fresh.select("blob", F.lit(version).alias("version")), self.scanned_path, "append")

    def by_blob(self, version: int = RULE_VERSION, blobs: DataFrame | None = None) -> DataFrame:
        """(blob, found) with a blob's spans in order of start, then rule; of ``blobs`` (blob) only, where given."""
        held = self.findings().where(F.col("version") == version)
        if blobs is not None:
            held = held.join(blobs.distinct().hint("merge"), "blob", "left_semi")
        span = F.struct(F.col("start"), F.col("rank"), F.col("end"), F.col("kind"))
        return held.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("found"))

    def islands(self, version: int, blobs: DataFrame | None = None) -> DataFrame:
        """(blob, islands) with a blob's spans in order, overlapping ones as one."""
        held = self.findings().where(F.col("version") == version).select("blob", "start", "end").distinct()
        if blobs is not None:
            held = held.join(blobs.distinct().hint("merge"), "blob", "left_semi")
        order = Window.partitionBy("blob").orderBy("start", "end")
        before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        apart = held.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1))
        dealt = apart.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        merged = dealt.groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return merged.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("islands"))

    def by_path(self, version: int = RULE_VERSION) -> DataFrame:
        """(path, blob, rank, kind, start, end) of every span in every version that any path has shown."""
        held = self.findings().where(F.col("version") == version).select("blob", "rank", "kind", "start", "end").distinct()
        return self.paths().distinct().join(held.hint("merge"), "blob").select("path", "blob", "rank", "kind", "start", "end")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, ledger_folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans) of every row, after scanning what the ledger has not seen."""
    spark = docs.sparkSession
    work = Workspace(spark, "secrets")
    ledger = Ledger(spark, ledger_folder or work.path("ledger"))
    ledger.scan(docs, rules)
    shown = work.keep("shown", docs.select("doc_id", blob_of(body(docs)).alias("blob")))
    held = ledger.by_blob(blobs=shown.select("blob") if ledger_folder else None)
    rows = spread_left_join(shown, held, "blob", work.keep("hot", hot_keys(shown, "blob")), "doc_id")
    found = F.coalesce("found", F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>"))
    base = [r.kind for r in rules if r.base]

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k) for k in base]
    rows = rows.select("doc_id", found.alias("found"))
    return rows.select("doc_id", *counts, _joined(F.filter("found", lambda s: s["kind"].isin(*base))).alias("base_spans"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, ledger_folder: str | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans become one."""
    spark = docs.sparkSession
    work = Workspace(spark, "secrets")
    ledger = Ledger(spark, ledger_folder or work.path("ledger"))
    ledger.scan(docs, REDACTION_RULES, REDACTION_VERSION)
    rows, (own, doc_id) = numbered(docs, "text", "doc_id")
    text = F.col(own).cast("string")
    rows = rows.withColumn("blob", blob_of(F.coalesce(text, F.lit(""))))
    shown = work.keep("shown", rows.select("blob"))
    found = ledger.islands(REDACTION_VERSION, shown if ledger_folder else None)
    rows = spread_left_join(rows, found, "blob", work.keep("hot", hot_keys(shown, "blob")), doc_id)
    part = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def cut(island: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("islands", i - 1)["end"])
        return F.concat(part(before, island["start"]), F.lit(mark))

    rest = part(F.element_at("islands", -1)["end"], F.lit(2**31 - 1).cast("long"))
    spliced = F.when(F.col("islands").isNull(), text).otherwise(F.concat(F.array_join(F.transform("islands", cut), ""), rest))
    return rows.select(*((spliced if f"c{i}" == own else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))
