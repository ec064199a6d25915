"""Secret scans over an incremental blob ledger.

Every version of every text is addressed by its SHA-256. The ledger, a Parquet folder, has one
row per scan of a blob: which rules, each at which version, have seen it, and what they found. A
scan reads only blobs with rule-version pairs that the ledger lacks, each blob once, however many
paths or versions hold it. A second look at the ledger joins findings back to all of them.

A keyword gate, evaluated on every text, is implied by each rule's pattern. Texts behind no gate
are entered as scanned without being moved; only gated texts of unseen blobs are shuffled and
matched. One append holds both the pairs seen and the findings, so a job that fails leaves no
half of a scan. Findings are kept as lengths (text before the match, match), from which running
sums give the spans. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from recordloom.llm.common import bind, prepare
from recordloom.session import shared_dir, stored


@dataclass(frozen=True)
class Rule:
    """`gate`: lower-case keywords of which any match holds one, or a pattern if `gate_pattern`.
    A match fails if `group` is shorter than `at_least`."""
    kind: str
    pattern: str
    gate: tuple[str, ...] = ()
    gate_pattern: str = ""
    group: int = 0
    at_least: int = 1
    version: int = 1

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), group=2, at_least=6),
    Rule("access", r"AKIA[A-Z0-9]+", ("akia",), at_least=20),
    Rule("hex", r"[0-9a-f]+", gate_pattern=r"[0-9a-f]{24}", at_least=24),
)
RULES = (
    *BASE,
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}", ("aiza",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyj",)),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", ("://",)),
)
FOUND = "array<struct<kind:string,version:int,place:int,gap:int,hit:int,ok:boolean>>"


def _open(rule: Rule, text: Column, lower: Column) -> Column:
    """The gate: lower-casing keeps every ASCII keyword, so no match is lost."""
    if rule.gate_pattern:
        return text.rlike(rule.gate_pattern)
    opened = F.lit(False)
    for word in rule.gate:
        opened = opened | F.contains(lower, F.lit(word))
    return opened


def gates(text: Column, rules: Sequence[Rule]) -> Column:
    """The rule-version pairs whose gate a text opens."""
    return bind(F.lower(text), lambda low: F.filter(
        F.array(*[F.when(_open(r, text, low), F.lit(r.pair)) for r in rules]), lambda p: p.isNotNull()))


def _matches(rule: Rule, text: Column) -> Column:
    """All matches, leftmost and non-overlapping, as lengths in code points.

    Splitting at the pattern gives the texts between the matches; failing matches stay in the
    list, marked, since later positions build on them.
    """
    split = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    return F.transform(
        F.arrays_zip(F.transform(split, F.length).alias("g"), F.transform(hits, F.length).alias("h"), F.transform(checked, F.length).alias("c")),
        lambda z, i: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), i.alias("place"),
                              z["g"].alias("gap"), z["h"].alias("hit"), (z["c"] >= rule.at_least).alias("ok")))


def find(text: Column, todo: Column, rules: Sequence[Rule]) -> Column:
    """Findings of the rules named in `todo`."""
    found = [F.when(F.array_contains(todo, r.pair), F.filter(_matches(r, text), lambda m: m["hit"].isNotNull()))
             .otherwise(F.array().cast(FOUND)) for r in rules]
    return F.flatten(F.array(*found))


class BlobLedger:
    """A ledger in a shared folder; a new folder is an empty ledger."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = prepare(spark)
        self.path = path or f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
        self.schema = f"blob string, pairs array<string>, found {FOUND}"

    def rows(self) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(self.schema).parquet(self.path) if there else None

    def address(self, versions: DataFrame, key: Sequence[str], text: str, rules: Sequence[Rule]) -> DataFrame:
        """key columns, blob, opened gates: one row per input row; null text is the empty blob."""
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        return versions.select(*key, F.sha2(body, 256).alias("blob"), gates(body, rules).alias("gates"))

    def scan(self, versions: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text",
             rules: Sequence[Rule] = RULES) -> DataFrame:
        """Scan what the ledger lacks, append it, and return the addresses of all rows."""
        pairs = F.array(*[F.lit(r.pair) for r in rules])
        addressed = stored(self.address(versions, key, text, rules))
        # one copy of each blob stands for all: the one with the smallest key
        blobs = addressed.groupBy("blob").agg(F.min(F.struct(*key)).alias("_copy"), F.min("gates").alias("gates"))
        known = self.rows()
        if known is None:
            todo = blobs.withColumn("todo", pairs)
        else:
            seen = known.select("blob", F.explode("pairs").alias("p")).groupBy("blob").agg(F.collect_set("p").alias("seen"))
            todo = (blobs.join(seen, "blob", "left")
                    .withColumn("todo", F.array_except(pairs, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen")
                    .where(F.size("todo") > 0))
        todo = stored(todo.select("blob", "_copy", "todo", F.array_intersect("todo", "gates").alias("match")))
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        texts = (versions.select(F.struct(*key).alias("_copy"), body.alias("_text"))
                 .where(F.size(gates(F.col("_text"), rules)) > 0)
                 .select("_copy", "_text", F.sha2("_text", 256).alias("blob")))
        picked = todo.where(F.size("match") > 0).select("blob", F.xxhash64("_copy").alias("_at"), "_copy", "todo", "match")
        matched = (texts.withColumn("_at", F.xxhash64("_copy"))
                   .join(picked.withColumnRenamed("_copy", "_same"), ["blob", "_at"])
                   .where(F.col("_copy").eqNullSafe(F.col("_same")))
                   .select("blob", F.col("todo").alias("pairs"), find(F.col("_text"), F.col("match"), rules).alias("found")))
        clean = todo.where(F.size("match") == 0).select("blob", F.col("todo").alias("pairs"), F.array().cast(FOUND).alias("found"))
        matched.unionByName(clean).write.mode("append").parquet(self.path)
        return addressed.select(*key, "blob")

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """blob, kind, start, end of everything found at the given rule versions (end exclusive)."""
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.pair), F.lit(i))])
        hits = (self.rows().where(F.size("found") > 0).select("blob", F.explode("found").alias("f")).select("blob", "f.*")
                .withColumn("_rule", order[F.concat_ws("@", "kind", "version")]).where("_rule is not null")
                .dropDuplicates(["blob", "_rule", "place"]))  # rows repeated in the input were scanned alike
        before = W.partitionBy("blob", "_rule").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
        return (hits.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(before))
                .where("ok").select("blob", "kind", "_rule", (F.col("end") - F.col("hit")).alias("start"), "end"))

    def by_blob(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """blob and its findings in one list, by start, then in the order of the rules."""
        return self.findings(rules).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "_rule", "end", "kind"))).alias("found"))


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and found (array of start, _rule, end, kind; empty if nothing was found), one row per input row.

    Null text is scanned as the empty text. Repeated rows and copies share their blob's findings;
    a null doc_id is a path like any other. An empty table gives an empty one.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    addressed = ledger.scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules=rules)
    none = F.array().cast("array<struct<start:bigint,_rule:int,end:bigint,kind:string>>")
    return (addressed.join(ledger.by_blob(rules), "blob", "left")
            .select("doc_id", "blob", F.coalesce("found", none).alias("found")))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with every span found replaced by a mask; all columns stay, n_chars follows.

    Texts without findings are unchanged, null texts too. Spans that overlap or touch are masked once. Repeated
    rows stay repeated and are masked alike, a null doc_id makes no difference, an empty table gives an empty one,
    and columns of any names are kept.
    """
    ledger = BlobLedger(docs.sparkSession)
    ledger.scan(docs.select("doc_id", "text"), rules=rules)
    spans = ledger.findings(rules).select("blob", "start", "end")
    inside = W.partitionBy("blob").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    merged = (spans.withColumn("_far", F.max("end").over(inside))
              .withColumn("_new", (F.col("_far").isNull() | (F.col("start") > F.col("_far"))).cast("int"))
              .withColumn("_run", F.sum("_new").over(W.partitionBy("blob").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
              .groupBy("blob", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
              .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans")))
    # rows travel in a struct, so that no column of theirs can meet one of these names
    body = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    text = F.col("body")
    pieces = F.transform(F.col("_spans"), lambda s, i: F.concat(
        F.substring(text, (F.coalesce(F.get("_spans", i - 1)["end"], F.lit(0)) + 1).cast("int"),
                    (s["start"] - F.coalesce(F.get("_spans", i - 1)["end"], F.lit(0))).cast("int")), F.lit(mask)))
    rest = F.substring(text, (F.element_at("_spans", -1)["end"] + 1).cast("int"), F.length(text))
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", body.alias("body"))
    joined = rows.withColumn("blob", F.sha2("body", 256)).join(merged, "blob", "left")
    found = F.col("_spans").isNotNull()
    masked = joined.select("row", found.alias("found"), F.when(found, F.concat(F.array_join(pieces, ""), rest)).alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return masked.select(*[F.when(F.col("found"), new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c)
                           for c in docs.columns])
