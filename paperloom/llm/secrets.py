"""Secret scans over an incremental ledger of blobs.

Every version of every text is addressed by its SHA-256. The ledger has a row for each blob and rule
version that was scanned, with what was found; a scan asks it by digest which pairs it lacks, reads the texts
of those only, each blob once however many paths hold it, and records its rows in one commit. A run that
is lost part-way leaves nothing half-recorded and is simply run again. Findings are joined back to all paths.

A null text is the empty blob, and no text is too long to be scanned whole. Rows alike, and rows of one text, are
paths of one blob and get equal findings; a null doc_id is a path like any other. An empty table records nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, list_dir, put_text, read_text, remove, save, scratch
from .spans import SPAN, Rule, find, joined, spans_sql

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"

#: Base kinds, as listed.
BASE = [
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]++", lambda t: t.contains("=") | t.contains(":"), lambda v: F.length(F.regexp_extract(v, r"\A" + _ASSIGN + r"([A-Za-z0-9+/_.=-]+)", 1)) >= 8),
    Rule("access", r"AKIA[A-Z0-9]++", lambda t: t.contains("AKIA"), lambda v: F.length(v) >= 16),
    # a run of 32 or more is what is left of all runs once shorter ones are dropped
    Rule("hex", r"[0-9a-f]{32,}+", None, None),
]
_KEY = r"(?:(?!PRIVATE KEY-----)[A-Z0-9\x20])*+PRIVATE KEY-----"
#: What the scan adds to them. A key runs to its END line, where it has one before the next five dashes.
MORE = [
    Rule("private_key", rf"-----BEGIN\x20{_KEY}(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END\x20{_KEY})?+", lambda t: t.contains("PRIVATE KEY-----")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", lambda t: t.contains("eyJ")),
    Rule("url_login", r"(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]++://[^\x00-\x20/:@]++:[^\x00-\x20/@]++@", lambda t: t.contains("://"), lambda v: v.rlike("^[A-Za-z]")),
]
RULE_VERSIONS: dict[str, list[Rule]] = {"base-1": BASE, "more-2": MORE}


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class BlobLedger:
    """Scanned (blob, rule version) pairs and their findings at a path that all executors share.

    A scan writes a folder of its own and then a small manifest that names it: what no manifest names is not read.
    Scans that run side by side may both record a pair; they found the same, and one of the rows is read. A compaction is a folder with one
    row a pair, sorted by blob, whose manifest also names the folders that it stands for; those are read no more.
    """

    SCHEMA = f"blob binary, spans array<{SPAN}>, rule_version string"

    def __init__(self, spark: SparkSession, path: str, rules: dict[str, list[Rule]] | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.rules = rules or RULE_VERSIONS
        self.first: dict[str, int] = {}
        n = 0
        for version, some in self.rules.items():
            self.first[version] = n
            n += len(some)

    def recorded(self) -> DataFrame:
        """All rows of committed scans; none before the first."""
        live = self.live()
        if not live:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.path}/{n}" for n in live))

    def live(self) -> list[str]:
        """Folders that count: the committed ones that no compaction stands for."""
        known = [n.removesuffix(".txt") for n in list_dir(self.spark, f"{self.path}/manifest") if n.endswith(".txt")]
        old = {line for n in known if n.startswith("compact-") for line in read_text(self.spark, f"{self.path}/manifest/{n}.txt").split("\n")[1:]}
        return sorted(n for n in known if n not in old)

    def compact(self) -> None:
        """All that is recorded now as one folder. Scans that are committed meanwhile stay beside it."""
        old = self.live()
        if len(old) < 2:
            return
        name = f"compact-{uuid.uuid4().hex}"
        rows = self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.path}/{n}" for n in old)).groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))
        rows.sortWithinPartitions("blob").select("blob", "spans", "rule_version").write.parquet(f"{self.path}/{name}")
        put_text(self.spark, f"{self.path}/manifest/{name}.txt", "\n".join([name, *old]))

    def rows(self) -> DataFrame:
        """One row for each pair."""
        return self.recorded().groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))

    def missing(self, versions: DataFrame) -> DataFrame:
        """(blob, due): blobs of versions (text) and the rule versions that each still needs. Only digests move."""
        blobs = versions.select(blob_of(F.col("text")).alias("blob")).distinct()
        done = self.recorded().groupBy("blob").agg(F.collect_set("rule_version").alias("done"))
        due = F.array_except(F.array(*(F.lit(v) for v in self.rules)), F.coalesce("done", F.array().cast("array<string>")))
        return blobs.join(done, "blob", "left").select("blob", due.alias("due")).where(F.size("due") > 0)

    def scan(self, versions: DataFrame) -> int:
        """versions (text): scan each blob for each rule version that the ledger lacks, and record it. Gives the number of blobs."""
        missing = save(self.missing(versions), "missing-blobs")
        n = missing.count()
        if not n:
            return 0
        texts = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        if n <= BROADCAST_ROWS:  # seen texts stay where they are
            texts = texts.join(F.broadcast(missing.select("blob")), "blob", "left_semi")
        blobs = texts.dropDuplicates(["blob"]).join(missing, "blob")  # copies merge before the shuffle; the join is on the same key
        none = F.array().cast(f"array<{SPAN}>")
        results = []
        for version, rules in self.rules.items():
            found = F.concat(none, *(find(F.col("text"), r, self.first[version] + i) for i, r in enumerate(rules)))
            new = F.array_contains("due", version)  # a pair that is recorded is not looked for again
            results.append(F.struct(F.when(new, F.array_sort(found)).alias("spans"), F.lit(version).alias("rule_version"), new.alias("new")))
        scanned = blobs.select("blob", F.inline(F.array(*results))).where("new").drop("new")
        name = f"scan-{uuid.uuid4().hex}"
        scanned.write.parquet(f"{self.path}/{name}")
        put_text(self.spark, f"{self.path}/manifest/{name}.txt", name)
        remove(self.spark, missing)
        return n

    def findings(self, paths: DataFrame) -> DataFrame:
        """paths (..., text) -> its other columns with `found`, the spans of each rule version as a map (null: no span).

        A column of paths by the name `found` gives way to it, as with withColumn.
        """
        others = [F.col(f"`{c}`") for c in paths.columns if c not in ("text", "found")]
        found = self.rows().where(F.size("spans") > 0).groupBy(F.col("blob").alias("__blob")).agg(F.map_from_entries(F.collect_list(F.struct("rule_version", "spans"))).alias("__found"))
        return paths.select(*others, blob_of(F.col("text")).alias("__of")).join(found, F.col("__of") == F.col("__blob"), "left").select(*others, F.col("__found").alias("found"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    at = scratch(spark, "ledger")
    # two versions of the corpus and of the rules: the second scan looks at new texts for all rules, and at known ones for the new rules
    BlobLedger(spark, at, {"base-1": BASE}).scan(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    ledger = BlobLedger(spark, at)
    ledger.scan(docs)
    ledger.compact()
    of = lambda v: F.coalesce(F.col("found")[v], F.array().cast(f"array<{SPAN}>"))
    found = ledger.findings(docs).select("doc_id", of("base-1").alias("base"), of("more-2").alias("more"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind_no"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))



def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN_SQL = rf"""({"|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))})["'']?\x20*[:=]\x20*["'']?"""
_LINE_SQL = r"-----{}\x20[A-Z0-9\x20]*PRIVATE KEY-----"
#: kind, pattern and condition on a match v: the rules above as they stand without possessive forms.
OP10_SQL = spans_sql(
    [
        ("assign", _ASSIGN_SQL + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(v, '^{_ASSIGN_SQL}', '')) >= 8"),
        ("access", "AKIA[A-Z0-9]+", "length(v) >= 16"),
        ("hex", "[0-9a-f]+", "length(v) >= 32"),
    ],
    [
        ("private_key", f"{_LINE_SQL.format('BEGIN')}((-{{0,4}}[^-])*{_LINE_SQL.format('END')})?", "true"),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
        ("url_login", r"[A-Za-z0-9+.-]+://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", "regexp_matches(v, '^[A-Za-z]')"),
    ],
)
