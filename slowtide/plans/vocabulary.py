"""Label sets."""

from pyspark.sql import DataFrame, SparkSession

# The 69 labels of the practice-log analysis, by position.
# "passivity" stands at two positions; jobs therefore key labels by position.
ANALYSIS_LABELS = [
    "turtles", "positive", "negative", "good mood", "bad mood", "uncertainty", "past",
    "menstruation", "fatigue", "depersonalization", "derealization",
    "impressed", "excited", "joyful", "feeling content", "apprehensive", "anxious",
    "confident", "faithful", "hopeful",
    "body", "high concentration", "low concentration",
    "sensory", "visual", "somatic", "mental", "vague", "abstract", "measurable",
    "passivity", "calmness", "harmony", "metaphorical",
    "dissonance", "auditory", "sounds", "mental images",
    "passivity", "paradox", "specific", "happiness",
    "sense of agency", "lack of agency", "confusion", "pain", "satisfaction",
    "subjective", "objective", "conceptual", "non-conceptual",
    "tingling", "vibrations", "sleepiness", "alertness", "dullness", "energetic",
    "direct experience", "weird", "struggling", "being challenged", "mystical experience",
    "weak sense of self", "dualities", "polarities", "opposites",
    "equanimity", "equanimity wrt negative", "equanimity wrt opposites",
]


def label_table(spark: SparkSession, labels: list[str]) -> DataFrame:
    """``label_idx, label``; a short parameter list, so it is broadcast in joins."""
    return spark.createDataFrame(list(enumerate(labels)), "label_idx int, label string")
