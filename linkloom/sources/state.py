"""State saved as JSON: lenient reading field by field, and the tables that it becomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT_THRESHOLD = 0.7
KEY = "struct<sourceId:string,phraseKey:string,targetId:string,approvedAt:bigint>"
PHRASE = "struct<phrase:string,score:double,startOffset:int,endOffset:int,spanId:string>"
EDGE = f"struct<sourcePath:string,sourceId:string,phrase:{PHRASE},targetPath:string,targetId:string,similarity:double,matchedBy:array<string>,lcsSimilarity:double,denseSimilarity:double,sparseSimilarity:double,matchType:string>"
FIELDS = {
    "notes": "map<string,struct<path:string,mtime:bigint,lastSeenSize:bigint>>",
    "edges": f"map<string,array<{EDGE}>>",
    "denials": f"array<{KEY}>",
    "approvals": f"array<{KEY}>",
    "labelOverrides": "map<string,string>",
}


def parse_state(raw: DataFrame, col: str = "value") -> DataFrame:
    """One row (version, threshold, notes, edges, denials, approvals, labelOverrides) per JSON text.

    Another version or no object gives the defaults; a field of the wrong kind gives its own default.
    """
    field = lambda name: F.get_json_object(F.col(col), f"$.{name}")
    good = F.coalesce(field("version") == "1", F.lit(False))
    number = F.when(field("similarityThreshold").rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$") & ~F.col(col).rlike(r'"similarityThreshold"\s*:\s*"'), field("similarityThreshold").cast("double"))
    empty = lambda t: (F.create_map() if t.startswith("map") else F.array()).cast(t)
    cols = [F.when(good, F.coalesce(F.from_json(field(n), t), empty(t))).otherwise(empty(t)).alias(n) for n, t in FIELDS.items()]
    return raw.select(F.lit(1).alias("version"), F.when(good, F.coalesce(number, F.lit(DEFAULT_THRESHOLD))).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"), *cols)


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a saved state: settings, notes, edges, denials, approvals, overrides."""
    state = parse_state(spark.read.option("wholetext", True).text(path))
    keys = lambda c: state.select(F.explode(c).alias("k")).select(F.col("k.sourceId").alias("source_id"), F.col("k.phraseKey").alias("phrase_key"), F.col("k.targetId").alias("target_id"), F.col("k.approvedAt").alias("approved_at"))
    edges = state.select(F.explode("edges").alias("source", "list")).select("source", F.explode("list").alias("e"))
    return {
        "settings": state.select("version", "threshold"),
        "notes": state.select(F.explode("notes").alias("id", "n")).select("id", "n.path", "n.mtime", F.col("n.lastSeenSize").alias("size")),
        "edges": edges.select(
            F.coalesce("e.sourceId", "source").alias("source_id"), F.col("e.sourcePath").alias("source_path"), "e.phrase.phrase", "e.phrase.score",
            F.col("e.targetPath").alias("target"), F.col("e.targetId").alias("target_id"), "e.similarity", F.col("e.matchedBy").alias("matched_by"),
            F.col("e.lcsSimilarity").alias("lcs_similarity"), F.col("e.denseSimilarity").alias("dense_similarity"), F.col("e.sparseSimilarity").alias("sparse_similarity"), F.col("e.matchType").alias("match_type"),
        ),
        "denials": keys("denials"),
        "approvals": keys("approvals"),
        "overrides": state.select(F.explode("labelOverrides").alias("idx", "label")).select(F.col("idx").cast("int").alias("idx"), "label"),
    }


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Every table as Parquet below root; edges by source, so a note's edges are one folder to replace."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("source_id") if name == "edges" else writer).parquet(f"{root}/{name}")
