"""Secret scans with an incremental ledger of blobs.

Every version of every file is addressed by the SHA-256 of its text. The ledger, a
table in the shared folder, has a row for each pair of blob and rule version that was
scanned, with the spans found, also if there are none. A scan takes one text per
blob, drops the pairs that the ledger has, applies the rules to the rest, appends
their rows, and joins the findings back to all paths. A changed rule gets a new
version and is the only one that runs again.

All of it is DataFrame operations. A text is first tested for a rule at all; only
then are its matches and the pieces between them taken, whose lengths give the spans.

Cases: NULL text is the empty text. Rows repeat as often as they are given, also with
NULL ids. Spans count code points, the end is exclusive. An empty table gives an empty
result and an unchanged ledger. Other columns go through; columns named ``blob`` or
``spans`` are replaced. If a run is lost after it appended, its rows stay valid: a
repeated scan finds them, and rows that two runs append for one pair count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.llm.batches import stored
from answergrid.sources.shared import new_path


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group has at least ``least`` characters."""

    kind: str
    version: str
    pattern: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: In the order of their kinds.
RULES = (
    Rule("assign", "1", f"""({_NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "1", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "1", "[0-9a-f]+", 0, 24),
)
LEDGER = "blob binary, rule string, spans array<struct<start:bigint,end:bigint>>"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """The spans of a rule's matches, leftmost first, without overlaps."""
    pattern = rule.pattern
    if rule.group == 0:
        # A run is as long as it can be, so shorter ones need not be taken at all.
        pattern = pattern[:-1] + f"{{{rule.least - (4 if rule.kind == 'access' else 0)},}}"
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)).alias("value"),
        F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("before"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(done: Column, m: Column) -> Column:
        start = done["at"] + F.length(m["before"])
        end = (start + F.length(m["all"])).cast("long")
        span = F.struct(start.cast("long").alias("start"), end.alias("end"))
        kept = F.when(F.length(m["value"]) >= rule.least, F.array(span)).otherwise(F.array().cast(_SPANS))
        return F.struct(end.alias("at"), F.concat(done["spans"], kept).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(found, zero, step, lambda d: d["spans"])).otherwise(F.array().cast(_SPANS))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; empty if nothing was scanned yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def scan_secrets(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with ``blob`` and ``spans``: a map from each kind to its spans.

    ``versions`` has a ``text`` and whatever names a path or version. ``ledger`` is the
    ledger's path; without it the scan starts a ledger of its own.
    """
    spark = versions.sparkSession
    path = ledger or new_path(spark, "secret-ledger")
    text = F.coalesce("text", F.lit(""))
    addressed = versions.drop("blob", "spans").withColumn("blob", F.unhex(F.sha2(text, 256)))
    scanned = read_ledger(spark, path).where(F.col("rule").isin([r.name for r in rules]))
    seen = scanned.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    texts = addressed.select("blob", text.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    asked = texts.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
    unseen = [
        F.when(
            ~F.coalesce(F.array_contains("seen", r.name), F.lit(False)),
            F.struct(F.lit(r.name).alias("rule"), spans_of(F.col("text"), r).alias("spans")),
        )
        for r in rules
    ]
    asked.select("blob", F.inline(F.array_compact(F.array(*unseen)))).write.mode("append").parquet(path)
    kinds = F.col("rule").isNotNull() & (F.size("spans") > 0)
    known = read_ledger(spark, path).where(F.col("rule").isin([r.name for r in rules])).where(kinds)
    kind = F.substring_index("rule", "@", 1)
    found = known.groupBy("blob").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(kind.alias("kind"), F.col("spans"))))).alias("spans")
    )
    found = stored(found, "secret-findings")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{_SPANS}>"))
    # The paths are read again; their texts are not moved.
    return addressed.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", nothing))
