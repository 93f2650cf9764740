"""Chart-ready frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys each chart kind needs, and the keys read as numbers.
CHART_KEYS = {
    "line": ("time", "value"),
    "area": ("time", "value"),
    "column": ("category", "value"),
    "bar": ("category", "value"),
    "pie": ("category", "value"),
    "scatter": ("x", "y"),
    "histogram": ("value",),
    "boxplot": ("x", "value"),
    "violin": ("x", "value"),
    "radar": ("category", "value"),
    "treemap": ("name", "value"),
    "funnel": ("stage", "value"),
    "dual_axes": ("time", "value1", "value2"),
    "liquid": ("value",),
    "word_cloud": ("text", "value"),
    "sankey": ("source", "target", "value"),
    "network": ("source", "target", "value"),
    "organization": ("id", "parent", "label"),
    "mind_map": ("id", "parent", "label"),
    "flow": ("id", "from", "to", "label"),
    "fishbone": ("problem", "cause"),
    "path_map": ("lng", "lat"),
    "pin_map": ("lng", "lat"),
    "district_map": ("district", "value"),
    "venn": ("sets", "size"),
}
# Keys that may be left out.
OPTIONAL_KEYS = {"line": ("group",), "column": ("group", "stack")}
NUMBER_KEYS = ("value", "value1", "value2", "x", "y", "lng", "lat", "size")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _cast(key: str, source: Column) -> Column:
    if key == "time":
        return F.date_format(source.try_cast("timestamp"), TIME_FORMAT)
    if key in NUMBER_KEYS:
        return source.try_cast("double")
    return source.cast("string")


def chart_frame(df: DataFrame, kind: str, mapping: dict[str, str]) -> DataFrame:
    """Project the mapped columns under the names a chart kind needs.

    Times become text, number keys become doubles (null where they do not parse),
    other keys text. A missing column gives nulls; a row with a null goes. Optional
    keys are there if they are mapped to a column, and may be null. The frame must
    already be at the grain of the chart.
    """
    fields = {f.name: f for f in df.schema.fields}
    out = []
    for key in CHART_KEYS[kind]:
        source = mapping.get(key, "")
        column = F.col(f"`{source}`") if source in fields else F.lit(None).cast("string")
        out.append(_cast(key, column).alias(key))
    for key in OPTIONAL_KEYS.get(kind, ()):
        if mapping.get(key, "") in fields:
            out.append(F.col(f"`{mapping[key]}`").cast("string").alias(key))
    return df.select(*out).na.drop(subset=list(CHART_KEYS[kind]))


def repair_mapping(proposals: DataFrame) -> DataFrame:
    """Give every proposal ``(id, kind, mapping)`` exactly the keys of its kind.

    The catalogue decides which keys are required; a key without a column gets an
    empty one.
    """
    spark: SparkSession = proposals.sparkSession
    rows = [(kind, list(keys)) for kind, keys in CHART_KEYS.items()]
    catalogue = spark.createDataFrame(rows, "kind string, required array<string>")  # fixed size
    missing = F.filter(
        F.col("required"), lambda k: ~F.coalesce(F.map_contains_key("mapping", k), F.lit(False))
    )
    filled = F.map_concat(
        F.coalesce("mapping", F.create_map().cast("map<string,string>")),
        F.map_from_arrays(missing, F.transform(missing, lambda k: F.lit(""))),
    )
    return proposals.join(F.broadcast(catalogue), "kind").withColumn("mapping", filled)
