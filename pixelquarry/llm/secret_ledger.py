"""Secret scans with an incremental blob ledger; DataFrame functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger
has rows (blob, scanned, spans): a blob, the rule versions of one scan that it was looked at with, and what
they found. A scan compares hashes first, moves only the texts of blobs that lack a rule version,
looks at each distinct blob once however many paths or versions carry it, and adds only rows of its
own: what earlier scans wrote is never written again, and a blob may have a row for each scan that
brought new rules. Findings are joined back to all paths, over the blobs that have any.

Spans are code points, end exclusive, leftmost and non-overlapping per kind. The base kinds are
``assign``, ``access`` and ``hex``; the further kinds ``pem`` and ``jwt`` only add spans. Offsets are
running sums over the lengths of matches and of what lies between them, a window over the matches
of one text.

Defined cases: a null text is an empty one and has no spans; repeated rows and equal texts share
one blob and each keep their own result row; null ids are kept; an empty table gives no rows
and adds none to the ledger. Columns of the input other than the path columns and the text are ignored by
``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.session import settled


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern and, where given, the least length of one of its groups."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


KEYWORDS = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)
#: A greedy run of one class either reaches the least length or fails from each of its places, so
#: the lengths of ``access`` and ``hex`` stand in their patterns; a failing ``assign`` match uses up
#: its text, so it is matched first and dropped afterwards.
RULES = (
    Rule("assign", 1, f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
    Rule("pem", 1, "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")

SPAN = "struct<start: int, rank: int, kind: string, end: int>"
LEDGER = f"blob string, scanned array<string>, spans array<{SPAN}>"
#: Blobs to be scanned whose hashes are broadcast (64 bytes each), so that texts of known blobs stay where they are.
BROADCAST_BLOBS = 500_000


def _address(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def _lengths(text: Column, rule: Rule, rank: int, due: Column) -> Column:
    """(rank, pairs) of one rule: lengths of each match, of what stands before it, and of the group that decides."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, 0)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    parts = F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length) if rule.group else F.transform(matches, F.length)
    zipped = F.arrays_zip(
        F.slice(between, 1, F.size(matches)).alias("before"), F.transform(matches, F.length).alias("size"), parts.alias("part")
    ).cast("array<struct<before: int, size: int, part: int>>")
    wanted = F.array_contains(due, rule.name) & text.rlike(rule.pattern)
    return F.struct(F.lit(rank).alias("rank"), F.when(wanted, zipped).alias("pairs"))


def _found(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of the blobs (blob, content, due) that have any."""
    per_rule = F.array(*[_lengths(F.col("content"), rule, rank, F.col("due")) for rank, rule in enumerate(rules)])
    matches = (
        blobs.select("blob", F.explode(per_rule).alias("r")).where("r.pairs is not null")
        .select("blob", F.col("r.rank").alias("rank"), F.posexplode("r.pairs").alias("at", "m"))
    )
    upto = Window.partitionBy("blob", "rank").orderBy("at")
    end = F.sum(F.col("m.before") + F.col("m.size")).over(upto).cast("int")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    least = F.array(*[F.lit(r.least) for r in rules])
    spans = matches.select("blob", "rank", F.col("m.size").alias("size"), F.col("m.part").alias("part"), end.alias("end")).where(F.col("part") >= F.get(least, "rank"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", F.get(kinds, "rank").alias("kind"), "end").cast(SPAN)
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(
    versions: DataFrame, paths: list[str], text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """(paths with their blob, the ledger after this scan).

    ``ledger`` is what earlier scans returned; None is an empty one. The rows of this scan are written
    to the shared folder, so it happens once whatever is joined to it.
    """
    spark = versions.sparkSession
    addressed = versions.select(*paths, _address(text).alias("blob"))
    texts = versions.select(_address(text).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        blobs = texts.groupBy("blob").agg(F.first("content").alias("content")).withColumn("due", names)
    else:
        known = ledger.select("blob", F.explode("scanned").alias("name")).groupBy("blob").agg(F.collect_set("name").alias("scanned"))
        lacking = addressed.select("blob").distinct().join(known, "blob", "left").select(
            "blob", F.array_except(names, F.coalesce("scanned", F.array().cast("array<string>"))).alias("due")
        )
        lacking = settled(lacking.where(F.size("due") > 0), "secret-blobs")
        few = lacking.count() <= BROADCAST_BLOBS
        new = texts.join(F.broadcast(lacking) if few else lacking, "blob")
        blobs = new.groupBy("blob").agg(F.first("content").alias("content"), F.first("due").alias("due"))
    # spans of blobs that have any; texts go no further
    found = _found(blobs, rules)
    every = addressed.select("blob").distinct().withColumn("scanned", names) if ledger is None else lacking.withColumnRenamed("due", "scanned")
    rows = every.join(found, "blob", "left").select("blob", "scanned", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
    written = settled(spark.createDataFrame([], LEDGER).unionByName(rows), "secret-ledger")
    return addressed, written if ledger is None else ledger.select("blob", "scanned", "spans").unionByName(written)


def findings(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each path row with the spans of its blob, from all scans; only blobs with findings take part in the join."""
    hits = ledger.select("blob", F.explode("spans").alias("span")).groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    nothing = F.array().cast(f"array<{SPAN}>")
    return paths.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", nothing))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with every span replaced by ``[secret]``; overlapping spans are joined first.

    Spans come from the ledger of this input; rows without findings are left as they are.
    """
    _, ledger = scan(docs, [], text, rules=rules)
    rows = docs.select(F.struct("*").alias("row"), _address(text).alias("blob"), F.col(text).alias("content"))
    found = findings(rows, ledger)
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col("content"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.when(fresh, F.concat(acc["done"], gap, F.lit("[secret]"))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    rest = F.aggregate(
        "spans", begin, step, lambda acc: F.concat(acc["done"], F.substring(F.col("content"), acc["at"] + 1, F.length("content")))
    )
    clean = F.when(F.size("spans") > 0, rest).otherwise(F.col("content"))
    return found.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
