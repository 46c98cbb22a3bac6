"""Secret scans over an incremental blob ledger.

Method: every version of every path is content-addressed (SHA-256 of its text). The ledger is a table in
a given folder: per scanned blob the (rule, version) keys it was scanned for and the findings. A run takes
the distinct blobs that lack some active rule version, scans each once and only for what it lacks, appends
that to the ledger, and joins the findings of all active rule versions back to every path and version that
has the blob. A second run over the same texts scans nothing; a changed rule gets a new version, which
alone is scanned. Marks and findings of a blob are one row, written by one job, so a run that breaks off
leaves no mark without its findings; what two runs scanned at once counts once.

Everything is DataFrame expressions. A match's place comes from the text between matches: ``split`` and
``regexp_extract_all`` walk the same leftmost non-overlapping matches, so running sums of the lengths of
gaps and matches are the spans, in code points, end exclusive.

Scale: the ledger is asked with hashes, before any text moves; of the ledger only rows of present blobs are grouped. The texts
that it lacks are told apart by a bitmap of hash places (``idfilter``, of fixed size, broadcast) and shuffled once, each blob
reduced per task before (copies of one text, even a third of all rows, are one row per task); the join back to paths is an
equi-join on the blob, whose hot key Spark splits; findings are one row per blob with its span list.

Defined results: null text is the empty text; it is a blob like others. Null paths or versions are carried.
Repeated rows are returned each for itself. Overlapping findings of different kinds all stay, by start and
then in the rules' order. An empty table gives an empty result. Further columns are returned untouched
inside the struct ``doc``, which needs one column besides the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.llm.common import materialize
from docmetrics.operators.idfilter import id_filter, may_be_in
from docmetrics.session import scratch_dir


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost, non-overlapping; a match counts if its group ``group`` has ``least`` code points."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which findings of one start are listed; later rules are the library's own additions.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
#: Runs too short to count need not be listed: each is one maximal run, so a run that is long enough is found at the same place.
_WHOLE_RUN = {r"[0-9a-f]+": "[0-9a-f]{%d,}"}
FOUND = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's findings in the text as FOUND."""
    pattern = _WHOLE_RUN[rule.pattern] % rule.least if rule.pattern in _WHOLE_RUN else rule.pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if not rule.group else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole,
                                  lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
                       judged, lambda p, j: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), F.length(j).alias("judged")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("found"))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + m["gap"]
        one = F.array(F.struct(F.lit(rule.key).alias("rule"), at.alias("start"), (at + m["size"]).alias("end")))
        return F.struct((at + m["size"]).alias("at"), F.when(m["judged"] >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(FOUND))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows; empty before the first run."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """-> doc (the input row but for the text, as a struct), blob, found (all findings of the active rules: rule, kind, start,
    end, in order). ``ledger`` is a folder that lasts between runs; without one the run has an empty one of its own."""
    spark = docs.sparkSession
    ledger = ledger or scratch_dir(spark, "secret_ledger")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]  # texts are not carried to the join
    versions = docs.select(F.struct(*others).alias("doc"), text.alias("text"), F.sha2(text, 256).alias("blob"))

    # Hashes of the present blobs first: what the ledger knows of them, and which lack some active rule.
    present = materialize(versions.select("blob").distinct(), "secret_blobs")
    known = _ledger(spark, ledger).join(present, "blob", "left_semi")
    done = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    active = F.array(*(F.lit(r.key) for r in rules))
    todo = F.array_except(active, F.coalesce("done", F.array().cast("array<string>")))
    lacking = materialize(present.join(done, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0), "secret_todo")
    # Only their texts are shuffled, each blob's once; a run that knows all blobs shuffles hashes alone.
    texts = may_be_in(versions.select("blob", "text"), id_filter(lacking, ["blob"]), ["blob"])
    unseen = texts.dropDuplicates(["blob"]).join(lacking, "blob")
    found = F.concat(*(F.when(F.array_contains("todo", r.key), spans(F.col("text"), r)).otherwise(F.array().cast(FOUND)) for r in rules))
    unseen.select("blob", F.col("todo").alias("rules"), found.alias("found")).write.mode("append").parquet(ledger)

    # All findings of active rules, back to every path. A text's findings are one row.
    order = F.expr("map(" + ",".join(f"'{r.key}',{i}" for i, r in enumerate(rules)) + ")")
    listed = (_ledger(spark, ledger).where(F.size("found") > 0).join(present, "blob", "left_semi").select("blob", F.explode("found").alias("f")).where(F.col("f.rule").isin([r.key for r in rules]))
              .select("blob", F.struct("f.start", F.element_at(order, F.col("f.rule")).alias("no"), "f.end", "f.rule").alias("f"))
              .groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("f"))
              .select("blob", F.transform("f", lambda x: F.struct(x["rule"].alias("rule"), F.substring_index(x["rule"], "@", 1).alias("kind"),
                                                                  x["start"].alias("start"), x["end"].alias("end"))).alias("found")))
    empty = F.array().cast("array<struct<rule:string,kind:string,start:int,end:int>>")
    return versions.select("doc", "blob").join(listed, "blob", "left").select("doc", "blob", F.coalesce("found", empty).alias("found"))
