"""Explicit schemas and fixed value domains."""

from pyspark.sql import types as T

# Fixed values that must equal the reference's for right results.
# Required raw columns, categorical columns, their value domains and the
# risk-band cut-offs.
V_COLUMNS = [f"V{i}" for i in range(1, 29)]
REQUIRED_COLUMNS = ["Time", "Amount"] + V_COLUMNS
CATEGORICAL_COLUMNS = ["transaction_type", "card_type", "region", "channel"]
CHANNELS = ["web", "mobile", "pos", "atm"]
CATEGORY_DEFAULTS = {"transaction_type": "online", "card_type": "credit",
                     "region": "US", "channel": "web"}
HIGH_CUT = 0.8        # probability > 0.8  -> High
MEDIUM_CUT = 0.5      # probability > 0.5  -> Medium, else Low
DASHBOARD_HIGH = 0.7  # high-risk table filter, probability > 0.7
ALERT_CUT = 0.8       # stream alert, probability > 0.8
DRIFT_CHANGE = 0.1    # window drift alert when |change| > 0.1
DRIFT_HIGH = 0.2      # ... severity HIGH when |change| > 0.2
RATE_ALERT_PCT = 1.0  # running fraud % > 1.0 -> high_fraud_rate alert
ENSEMBLE_WEIGHTS = (0.5, 0.3, 0.2)  # boosted, forest, logistic
AMOUNT_EDGES = [0.0, 50.0, 100.0, 200.0, 500.0]  # 0-50, 50-100, 100-200, 200-500, 500+
AMOUNT_LABELS = ["0-50", "50-100", "100-200", "200-500", "500+"]
ADWIN_MESSAGE = "Significant drift detected in feature distribution"
PH_MESSAGE = "Model performance degradation detected"
PH_ALPHA = 0.9999     # forgetting factor of Page-Hinkley


def raw_transaction_schema(with_label: bool = True) -> T.StructType:
    fields = [T.StructField("Time", T.DoubleType(), True)]
    fields += [T.StructField(v, T.DoubleType(), True) for v in V_COLUMNS]
    fields += [T.StructField("Amount", T.DoubleType(), True)]
    if with_label:
        fields += [T.StructField("Class", T.IntegerType(), True)]
    return T.StructType(fields)


def enriched_transaction_schema() -> T.StructType:
    """Scoring input: raw columns without the label plus optional features."""
    s = raw_transaction_schema(with_label=False)
    extra = [
        ("hour_of_day", T.IntegerType()), ("day_of_week", T.IntegerType()),
        ("avg_amount_per_customer", T.DoubleType()), ("tx_freq_24h", T.IntegerType()),
        ("merchant_fraud_rate", T.DoubleType()),
        ("transaction_type", T.StringType()), ("card_type", T.StringType()),
        ("region", T.StringType()), ("channel", T.StringType()),
        ("transaction_id", T.StringType()),
    ]
    return T.StructType(list(s.fields) + [T.StructField(n, t, True) for n, t in extra])
