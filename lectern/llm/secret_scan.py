"""Secret scans over an incremental blob ledger.

Every version of every document is content-addressed (SHA-256 of its text). The ledger holds one row for each pair of
blob and rule version that has been scanned, with its findings; a scan anti-joins the pairs at hand with the ledger,
reads the text of blobs that have an unseen pair once, appends what it finds, and joins the findings back to all paths
that hold the blob. All of it is DataFrame code.

A table is brought to the ledger in batches, so what a batch scanned is not scanned again by the next one, nor by any later
table if the ledger's path is kept.

Positions come from two built-ins that walk the same matches: ``split`` gives the gaps between matches and
``regexp_extract_all`` the matches themselves, so their running lengths (a window sum over exploded matches, linear in their
number) are the offsets, in code points and in bytes.

Defined cases: a null text is an empty blob without findings; very long texts and texts with any number of findings are
scanned whole; copies of a text are one blob, scanned once; of findings that start together, the rule listed first comes
first; null ids are paths like any other and are listed once for each row; rows repeated in the input come back repeated; an
empty table gives an empty result; further columns, whatever their names, are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import boxed, join_by_key, materialize, scratch_path

#: Kind, pattern, group whose length counts, and the least length of a match that is a finding. Access and hex
#: runs are matched with their least length at once: a greedy run starts at its first character, so no other match can differ.
BASE_RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Further kinds, which only add spans.
MORE_RULES = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 26),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27),
    ("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.~-]{20,}", 0, 27),
]
RULES = BASE_RULES + MORE_RULES
#: Raise it when a pattern changes: the ledger then takes every blob as unseen by the new version.
RULE_VERSION = 1
#: Batches in which a table is brought to the ledger.
BATCHES = 2

FINDING = "struct<start:bigint,kind_no:int,kind:string,stop:bigint,first_byte:bigint,last_byte:bigint>"


#: Strings (in lower case) of which a text with a finding has at least one; a pattern for hex.
HINTS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "slack": ["xox"],
    "jwt": ["eyj"],
    "pem": ["-----begin "],
    "bearer": ["bearer"],
}


def hinted(text: Column, low: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """A cheap test that every text with a finding passes."""
    if kind == "hex":
        return text.rlike("[0-9a-f]{%d}" % least)
    if kind not in HINTS:
        return text.rlike(pattern)
    out = low.contains(HINTS[kind][0])
    for h in HINTS[kind][1:]:
        out = out | low.contains(h)
    return out


def matches(text: Column, no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All matches of one rule in a text, in order: what stands before each one and how long it is, in characters and bytes."""
    size = lambda c: F.coalesce(F.char_length(c), F.lit(0)).cast("long")
    width = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def one(gap: Column, hit: Column) -> Column:
        return F.struct(size(gap).alias("gap"), size(hit).alias("hit"), width(gap).alias("gap_bytes"), width(hit).alias("hit_bytes"))

    steps = F.zip_with(F.split(text, pattern, -1), all_of(0), one)
    return F.zip_with(steps, all_of(group), lambda x, part: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), x["gap_bytes"].alias("gap_bytes"), x["hit_bytes"].alias("hit_bytes"), (size(part) >= least).alias("counts")))


def findings(rows: DataFrame) -> DataFrame:
    """(blob, kind, found) from (blob, kind, kind_no, matches): the places of the matches that count, in order."""
    each = rows.select("blob", "kind", "kind_no", F.posexplode("matches").alias("no", "x")).select("blob", "kind", "kind_no", "no", "x.*")
    upto = Window.partitionBy("blob", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("stop", F.sum(F.col("gap") + F.col("hit")).over(upto)).withColumn("last_byte", F.sum(F.col("gap_bytes") + F.col("hit_bytes")).over(upto)).where("counts")
    finding = F.struct((F.col("stop") - F.col("hit")).alias("start"), "kind_no", "kind", "stop", (F.col("last_byte") - F.col("hit_bytes")).alias("first_byte"), "last_byte").cast(FINDING)
    return placed.groupBy("blob", "kind").agg(F.array_sort(F.collect_list(finding)).alias("found"))


class BlobLedger:
    """Which blob has been scanned by which rule version, and what was found: a Parquet table that lives under its path."""

    SCHEMA = f"blob binary, kind string, version int, found array<{FINDING}>"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "blob-ledger")

    def exists(self) -> bool:
        try:
            self.read()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        return True

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def unseen(self, blobs: DataFrame, rules: list, version: int) -> DataFrame:
        """(at, blob, kinds): blobs that some rule version has not seen yet, with those rules."""
        every = blobs.select("at", "blob", F.array(*[F.lit(r[0]) for r in rules]).alias("kinds"))
        if not self.exists():
            return every
        seen = self.read().where(F.col("version") == version).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        both = every.join(seen, "blob", "left")
        return both.select("at", "blob", F.array_except("kinds", F.coalesce("seen", F.array().cast("array<string>"))).alias("kinds")).where(F.size("kinds") > 0)

    def update(self, versions: DataFrame, blobs: DataFrame, rules: list, version: int) -> None:
        """Scan the blobs (blob, at) that have an unseen rule version, each in one of the ``versions`` (doc_id, blob, text) that hold it."""
        todo = self.unseen(blobs, rules, version).withColumnsRenamed({"at": "_at", "blob": "_blob"})
        # the text of one path of each blob; the digest is checked as ids may repeat
        picked = versions.join(todo, F.col("doc_id").eqNullSafe(F.col("_at")) & (F.col("blob") == F.col("_blob")))
        # one look at every text; only those with a hint keep it for the exact scan
        low = picked.withColumn("low", F.lower("text"))
        flags = F.array(*[F.array_contains("kinds", r[0]) & hinted(F.col("text"), F.col("low"), *r) for r in rules])
        looked = low.select("blob", "kinds", flags.alias("flags"), "text")
        looked = materialize(looked.select("blob", "kinds", "flags", F.when(F.array_contains("flags", True), F.col("text")).alias("text")), "hinted")
        none = F.array().cast("array<struct<gap:bigint,hit:bigint,gap_bytes:bigint,hit_bytes:bigint,counts:boolean>>")
        each = [F.struct(F.lit(r[0]).alias("kind"), F.lit(no).alias("kind_no"), F.when(F.col("flags")[no], matches(F.col("text"), no, *r)).otherwise(none).alias("matches")) for no, r in enumerate(rules)]
        # a text stands as often as its blob and id repeat, but its blob is scanned once
        exact = looked.where(F.col("text").isNotNull()).dropDuplicates(["blob"]).select("blob", F.explode(F.array(*each)).alias("x")).select("blob", "x.*").where(F.size("matches") > 0)
        scanned = looked.groupBy("blob").agg(F.first("kinds").alias("kinds")).select("blob", F.explode("kinds").alias("kind"))
        done = scanned.join(findings(exact), ["blob", "kind"], "left").withColumn("version", F.lit(version).cast("int"))
        done = done.withColumn("found", F.coalesce("found", F.array().cast(f"array<{FINDING}>")))
        done.select("blob", "kind", "version", "found").write.mode("append").parquet(self.path)

    def scan(self, versions: DataFrame, rules: list = RULES, version: int = RULE_VERSION, batches: int = BATCHES) -> DataFrame:
        """Bring the ledger up to date with ``versions`` (doc_id, text; a row for each path and version of it), in batches.

        Returns (doc_id, blob, found): all findings of the rules in each row's text, by start and then rule order.
        """
        text = F.coalesce("text", F.lit(""))
        named = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"), F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)).alias("batch"))
        paths = materialize(named.select("doc_id", "blob", "batch"), "paths")
        for k in range(batches):
            mine = F.col("batch") == k
            self.update(named.where(mine).select("doc_id", "blob", "text"), paths.where(mine).groupBy("blob").agg(F.min("doc_id").alias("at")), rules, version)
        kinds = [r[0] for r in rules]
        hits = self.read().where((F.col("version") == version) & F.col("kind").isin(kinds) & (F.size("found") > 0))
        # a blob and kind that two scans brought stand twice, with equal findings
        once = hits.groupBy("blob", "kind").agg(F.first("found").alias("found"))
        per_blob = once.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
        answers = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n_paths")).join(per_blob, "blob", "left")
        out = join_by_key(paths.select("doc_id", "blob"), answers, "blob", "n_paths", paths.count())
        return out.select("doc_id", "blob", F.coalesce("found", F.array().cast(f"array<{FINDING}>")).alias("found"))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``."""
    out = (ledger or BlobLedger(docs.sparkSession)).scan(docs)
    base = F.filter("found", lambda x: x["kind_no"] < len(BASE_RULES))
    counts = [F.size(F.filter("found", of_kind(r[0]))).cast("long").alias(f"n_{r[0]}") for r in BASE_RULES]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def cuts_of(found: DataFrame) -> DataFrame:
    """(blob, doc_id, cuts): the findings of each row as disjoint ranges of bytes, overlapping ones joined, in order."""
    each = found.select("doc_id", "blob", F.explode("found").alias("x")).select("doc_id", "blob", F.col("x.first_byte").alias("a"), F.col("x.last_byte").alias("b"))
    order = Window.partitionBy("doc_id", "blob").orderBy("a", "b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = each.withColumn("new", F.when(F.col("a") < F.max("b").over(before), 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("doc_id", "blob", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return islands.groupBy("doc_id", "blob").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))


def redact(docs: DataFrame, ledger: BlobLedger | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark`` (overlapping ones by one mark); all columns and rows stay.

    A column n_chars follows the new text. The findings of a text replace it wherever the text stands, so they are looked up
    by the text's digest. The text's bytes are made once for a row, and what stands between the findings is cut out of them.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    found = ledger.scan(docs).where(F.size("found") > 0).dropDuplicates(["doc_id", "blob"])
    cuts = cuts_of(found).withColumnsRenamed({"doc_id": "at", "blob": "of"})
    rows = boxed(docs).withColumn("blob", F.unhex(F.sha2("text", 256)))
    both = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("of")), "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda x: x["b"]))
    begins = F.concat(F.transform("cuts", lambda x: x["a"]), F.array(F.octet_length("text").cast("long")))

    def cut(data: Column) -> Column:
        return F.array_join(F.zip_with(ends, begins, lambda b, a: F.decode(F.substring(data, (b + 1).cast("int"), (a - b).cast("int")), "utf-8")), mark)

    # as a list of one, the bytes are a variable of the inner function and not an expression that it evaluates for every piece
    clean = F.transform(F.array(F.encode("text", "utf-8")), cut)[0]
    new = both.select("row", F.when(F.col("cuts").isNotNull(), clean).alias("new"))
    follow = {"text": F.coalesce("new", "row.text"), "n_chars": F.coalesce(F.char_length("new").cast("long"), "row.n_chars") if "n_chars" in docs.columns else None}
    return new.select(*[(follow[c] if c in follow else F.col("row").getField(c)).alias(c) for c in docs.columns])
