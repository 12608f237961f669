"""Column lists and Spark schemas shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Feature names in the order the fusion model expects them.
FEATURES = [
    "rule_score",
    "rule_polarity",
    "sentiment_score",
    "sentiment_confidence",
    "num_pos_aspects",
    "num_neg_aspects",
    "avg_aspect_score",
    "avg_aspect_confidence",
    "emotion_score",
    "emotion_confidence",
    "emotion_distribution",
    "sarcasm_score",
    "sarcasm_confidence",
]

# Payload of the result table: everything an upsert replaces.
RESULT_PAYLOAD = [
    "overall_sentiment",
    "overall_score",
    "emotion_label",
    "emotion_score",
    "sarcasm_label",
    "sarcasm_score",
    "fusion_label",
    "fusion_confidence",
]

# All class scores of a unit in one row, in class order.
SCORE_ARRAY = "array<struct<label:string,score:double>>"

# The outputs nested in one line of the feedback log, and their types. `fused_output` is
# read as well as `fused` because older logs may carry either name.
FEEDBACK_GROUPS = {
    "sentiment_output": "sentiment:int,confidence_score:double,sentiment_label:string,sentiment_score:double,model_used:string",
    "emotion_output": "emotion_label:string,emotion_score:double,emotion_confidence:double,emotion_distribution:double,"
    "all_emotion_scores:string",
    "sarcasm_output": "sarcasm_label:string,sarcasm_score:int,sarcasm_confidence:double",
    "rule_output": "rule_label:string,rule_score:int,rule_polarity:double,valence_score:double,polarity_score:double",
    "absa_output": "num_pos_aspects:bigint,num_neg_aspects:bigint,avg_aspect_score:double,avg_aspect_confidence:double,"
    "aspect_details:string",
    "fused": "fused_label:string,fused_confidence:double",
    "fused_output": "fused_label:string,fused_confidence:double",
    "signals_fed_to_fusion": ",".join(f"{f}:double" for f in FEATURES),
}


def feedback_signals() -> StructType:
    return StructType.fromDDL(", ".join(f"{name} struct<{fields}>" for name, fields in FEEDBACK_GROUPS.items()))


# Columns of the relabelling export.
TRAINING_EXPORT = ["review_id", "text", *FEATURES, "fused_label", "fused_confidence", "label"]
