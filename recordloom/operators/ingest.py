"""From files to task blocks: redaction, roles, chunks, running state, change and source checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from recordloom import fixed_values as fv
from recordloom.functions import text as tx
from recordloom.functions.chunking import chunk_lines
from recordloom.operators.blocks import SPAN, running_sum, with_preceding
from recordloom.session import stored

FINDINGS = 6


def file_facts(files: DataFrame) -> DataFrame:
    """Path-derived columns, digest and redacted text of files (chain_id, file_index, relative_path, text)."""
    rel = F.col("relative_path")
    ext = tx.extension(rel)
    masked, n = tx.redact_secrets(F.col("text"))
    parts = F.split(rel, "/")
    role = tx.path_role(rel, ext)
    lines = tx.occurrences(F.col("text"), "\n") + 1
    finding = F.concat(lines.cast("string"), F.lit(" lines, "), tx.occurrences(F.col("text"), "def ").cast("string"),
                       F.lit(" defs, "), tx.occurrences(F.col("text"), "class ").cast("string"), F.lit(" classes"),
                       F.when(n > 0, F.concat(F.lit(", "), n.cast("string"), F.lit(" secret(s) redacted"))).otherwise(""))
    return files.select(
        "chain_id", "file_index", "relative_path", F.element_at(parts, -1).alias("filename"),
        F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("").alias("top_dir"), ext.alias("extension"),
        tx.language(ext).alias("language"), role.alias("path_role"), (role == "test").alias("is_test"),
        (role == "generated").alias("is_generated"), F.sha2("text", 256).alias("file_content_hash"),
        n.alias("redaction_count"), (n > 0).alias("redacted"), masked.alias("sealed_text"), finding.alias("finding"))


def text_labels(content: Column) -> Column:
    """What a block is labelled with by default: keywords, an excerpt, entities and salience."""
    return F.struct(tx.keywords(content, 6, fv.STOPWORDS).alias("keywords"), tx.excerpt(content, 24).alias("excerpt"),
                    tx.entities(content, 6).alias("entities"), tx.salience(content).alias("salience"))


def blocks(files: DataFrame, start: int = 0, target: int = fv.CHUNK_TOKENS["target"],
           least: int = fv.CHUNK_TOKENS["min"], most: int = fv.CHUNK_TOKENS["max"],
           labeller: Callable[[Column], Column] | None = None) -> DataFrame:
    """Blocks of the files' chunks with their place in each chain and the running task state.

    A `labeller` (such as `text_labels`, or a caller's own) turns the content column into the column
    `labels`, sealed with each block.
    """
    facts = file_facts(files)
    keyed = facts.select(F.struct("chain_id", "file_index").alias("_k"), "sealed_text")
    pieces = chunk_lines(keyed.select(F.to_json("_k").alias("_key"), "sealed_text"), "_key", "sealed_text", target, least, most)
    pieces = stored(pieces.withColumn("_k", F.from_json("_key", "chain_id long, file_index long")).select(
        "_k.*", "chunk_index", "chunk_of", "line_start", "line_end", "tokens_upto", "content"))
    # one row per file is numbered and summed, without any text; the chunks then only look up their file's row
    ends = pieces.where("chunk_index = chunk_of").select("chain_id", "file_index", F.col("chunk_of").cast("long").alias("_n"), F.col("tokens_upto").alias("_t"))
    sums = running_sum(ends, ["chain_id"], F.expr(f"file_index div {SPAN}"), ["file_index"], {"_chunks": F.col("_n"), "_tokens": F.col("_t"), "_files": F.lit(1)})
    per_file = sums.select("chain_id", "file_index", (F.col("_chunks") - F.col("_n")).alias("_chunks"), (F.col("_tokens") - F.col("_t")).alias("_tokens"), (F.col("_files") - 1).alias("_files")).join(
        facts.drop("sealed_text"), ["chain_id", "file_index"])
    sealed = F.col("_chunks") + F.col("chunk_index")
    return pieces.join(per_file, ["chain_id", "file_index"]).select(
        "chain_id", "file_index", "chunk_index", "chunk_of", "line_start", "line_end", "content",
        F.sha2("content", 256).alias("content_hash"), tx.approx_tokens(F.col("content")).alias("approx_tokens"),
        *([] if labeller is None else [labeller(F.col("content")).alias("labels")]),
        (F.lit(start) + sealed - 1).cast("long").alias("idx"), sealed.cast("long").alias("chunks_sealed"), (F.col("_tokens") + F.col("tokens_upto")).alias("approx_tokens_ingested"),
        (F.col("_files") + (F.col("chunk_index") == F.col("chunk_of")).cast("int")).cast("long").alias("items_done"),
        *[c for c in facts.columns if c not in ("chain_id", "file_index", "sealed_text")])


def task_findings(files: DataFrame) -> DataFrame:
    """The last six findings as of each file of a chain; file_index is dense."""
    named = files.select("chain_id", "file_index", F.concat("relative_path", F.lit(": "), "finding").alias("_f"))
    return with_preceding(named, ["chain_id"], "file_index", FINDINGS - 1, {
        "findings": lambda w: F.collect_list("_f").over(w.rowsBetween(-(FINDINGS - 1), 0))}).drop("_f")


def task_violations(rows: DataFrame, most: int = fv.CHUNK_TOKENS["max"]) -> DataFrame:
    """Blocks whose state does not follow from the block before; chunks_sealed = 1 opens a new segment."""
    names = ["items_done", "chunks_sealed", "approx_tokens_ingested"]
    seen = with_preceding(rows.select("chain_id", "idx", "approx_tokens", *names), ["chain_id"], "idx", 1,
                          {f"p_{n}": (lambda w, n=n: F.lag(n).over(w)) for n in names})
    follows = (F.col("chunks_sealed") != 1) & F.col("p_chunks_sealed").isNotNull()
    issue = F.array_compact(F.array(
        F.when(F.col("approx_tokens") > most, "data-height over max"),
        F.when(follows & (F.col("items_done") < F.col("p_items_done")), "items_done regressed"),
        F.when(follows & (F.col("chunks_sealed") != F.col("p_chunks_sealed") + 1), "chunks_sealed not monotonic +1"),
        F.when(follows & (F.col("approx_tokens_ingested") < F.col("p_approx_tokens_ingested")), "tokens ingested regressed")))
    return seen.select("chain_id", "idx", F.explode(issue).alias("issue"))


def height_stats(rows: DataFrame) -> DataFrame:
    """Smallest, floor-average and largest tokens and bytes of the blocks of each chain."""
    size = F.octet_length("content").cast("long")
    return rows.groupBy("chain_id").agg(
        F.count("*").alias("blocks"), F.min("approx_tokens").alias("min_tokens"),
        F.expr("sum(approx_tokens) div count(*)").alias("avg_tokens"), F.max("approx_tokens").alias("max_tokens"),
        F.min(size).alias("min_bytes"), F.floor(F.sum(size) / F.count("*")).alias("avg_bytes"), F.max(size).alias("max_bytes"))


def task_state(rows: DataFrame) -> DataFrame:
    """Newest state of each chain, for a resume."""
    return rows.groupBy("chain_id").agg(F.max_by(F.struct(
        "idx", "relative_path", "chunk_index", "chunk_of", "chunks_sealed", "approx_tokens_ingested", "items_done"), "idx").alias("s")
    ).select("chain_id", "s.*")


def find_by_path(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """All blocks with an asked (chain_id, relative_path), quarantined ones too; a null path finds nothing."""
    return rows.join(asked.select("chain_id", "relative_path"), ["chain_id", "relative_path"], "left_semi")


def latest_hashes(rows: DataFrame) -> DataFrame:
    """Newest stored file digest per chain and path."""
    return (rows.where("relative_path is not null and file_content_hash is not null")
            .groupBy("chain_id", "relative_path").agg(F.max_by("file_content_hash", "idx").alias("file_content_hash")))


def changed_files(live: DataFrame, rows: DataFrame) -> DataFrame:
    """Files that are new or differ from their newest stored digest."""
    old = latest_hashes(rows).withColumnRenamed("file_content_hash", "_old")
    digest = F.sha2("text", 256)
    return (live.join(old, ["chain_id", "relative_path"], "left")
            .where(F.col("_old").isNull() | (F.col("_old") != digest)).drop("_old"))


def source_verdicts(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored file coordinates against a live manifest; the first rule that holds gives the verdict.

    stored: chain_id, idx, found, rec_type, source_path, stored_hash, stored_commit.
    live: source_path, live_hash, live_commit, live_dirty (null when unknown).
    """
    present = live.withColumn("_present", F.lit(True))
    c = F.col
    pinned = F.coalesce(c("stored_commit"), F.lit("")) != ""
    verdict = (F.when(~c("found"), "missing-ring").when(c("rec_type") != "file", "not-a-file-record")
               .when(F.coalesce(c("source_path"), F.lit("")) == "", "no-source-path")
               .when(c("_present").isNull(), "missing-source-file")
               .when(c("stored_hash").isNotNull() & (c("stored_hash") != c("live_hash")), "source-mismatch")
               .when(pinned & F.coalesce(c("live_dirty"), F.lit(False)), "dirty-worktree")
               .when(pinned & (c("live_commit") != c("stored_commit")), "revision-drift")
               .when(pinned & (c("live_commit").isNull() | c("live_dirty").isNull()), "git-unverifiable")
               .otherwise("verified"))
    return stored.join(present, "source_path", "left").select("chain_id", "idx", "source_path", verdict.alias("verdict"))


def missing_chunks(log: DataFrame, store: DataFrame) -> DataFrame:
    """Records that have no rows in the chunk store yet."""
    return log.join(store.select("chain_id", "idx").distinct(), ["chain_id", "idx"], "left_anti")


def replace_chunks(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with all rows of re-indexed records replaced."""
    done = fresh.select("chain_id", "idx").distinct()
    return store.join(done, ["chain_id", "idx"], "left_anti").unionByName(fresh)


def reconcile(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Registered tasks against what is on disk: (name, status, action)."""
    m = manifest.select("name", "status", F.lit(True).alias("_m"))
    d = listing.select("name").distinct().withColumn("_d", F.lit(True))
    both = m.join(d, "name", "full_outer")
    orphan, stale = F.col("_m").isNull(), F.col("_d").isNull() & (F.coalesce("status", F.lit("")) != "missing")
    return both.select("name", F.when(orphan, "active").when(stale, "missing").otherwise(F.col("status")).alias("status"),
                       F.when(orphan, "orphan_recovered").when(stale, "stale_marked").otherwise("kept").alias("action"))


def _grams(text: Column, n: Column) -> Column:
    last = F.length(text) - n
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def resolve_names(hints: DataFrame, registry: DataFrame) -> DataFrame:
    """Match name fragments: exact (no case), ambiguous (fragment of a name or objective) or not_found.

    A fragment can only lie inside a text that has all of the fragment's letter triples (all of it, if shorter), so it looks
    under its rarest triple, by a count over the registry, and what stands there is verified. A triple that
    most names begin with is thus asked for only by fragments that have no other. Entries of equal texts are
    met once with their number. The fragments' triples are written down first, so that Spark knows their size and
    brings few of them to the registry: it then moves counts only, never a row for each triple of a text.
    """
    h = stored(hints.select("hint", F.lower(F.trim("hint")).alias("_h")).distinct())
    r = stored(registry.select("name", F.lower("name").alias("_n"), F.lower(F.coalesce("objective", F.lit(""))).alias("_o"))
               .groupBy("_n", "_o").agg(F.min("name").alias("name"), F.count("*").alias("_many")))
    exact = h.join(r, F.col("_h") == F.col("_n")).groupBy("hint").agg(F.min("name").alias("exact_name"))
    own = stored(h.where("_h <> ''").withColumn("_g", F.explode(_grams(F.col("_h"), F.least(F.lit(3), F.length("_h"))))))
    grams = r.withColumn("_g", F.explode(F.array_distinct(F.concat(*[
        _grams(F.col(c), F.lit(n)) for c in ("_n", "_o") for n in (1, 2, 3)]))))
    often = grams.join(own.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.sum("_many").alias("_often"))
    # a triple that no text has rules the fragment out
    seed = stored(own.join(often, "_g", "left").groupBy("hint", "_h")
                  .agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_g")).alias("s")).select("hint", "_h", F.col("s._g").alias("_g")))
    fuzzy = (grams.join(seed, "_g").where(F.contains("_n", F.col("_h")) | F.contains("_o", F.col("_h")))
             .groupBy("hint").agg(F.sum("_many").alias("candidates")))
    return (h.select("hint").join(exact, "hint", "left").join(fuzzy, "hint", "left").select(
        "hint", F.when(F.col("exact_name").isNotNull(), "exact").when(F.col("candidates") > 0, "ambiguous")
        .otherwise("not_found").alias("status"), "exact_name",
        F.when(F.col("exact_name").isNull(), F.coalesce("candidates", F.lit(0))).otherwise(1).cast("long").alias("candidates")))


def genesis_drift(log: DataFrame, commitments: list[str]) -> DataFrame:
    """Chains whose first record is no genesis, or holds other commitments than the configured ones."""
    stored = F.coalesce(F.from_json("content_json", "commitments array<string>")["commitments"], F.array().cast("array<string>"))
    wanted = tx.literal_array(commitments)
    status = F.when(F.col("rec_type") != "genesis", "unexpected").when(~(stored == wanted), "drift")
    return log.where("idx = 0").select("chain_id", status.alias("status")).where("status is not null")
