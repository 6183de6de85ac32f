"""Table schemas and column roles.

Fixed values: the column names, role lists, cohort bins and labels, tier
cut-offs and segment names below must equal the reference application's
for results to agree. They are listed plainly, in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's)
# ---------------------------------------------------------------------------
ID_COL = "customerID"
CHURN_COL = "Churn"
LTV_TARGET = "TotalCharges"

CATEGORICAL = [
    "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService",
    "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
    "Contract", "PaperlessBilling", "PaymentMethod",
]
NUMERICAL = ["tenure", "MonthlyCharges"]
# Wider numeric list scaled in the preprocessing notebook.
NUMERICAL_WIDE = ["tenure", "MonthlyCharges", "charge_ratio", "charges_difference",
                  "total_services"]

SERVICE_COLS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection",
                "TechSupport", "StreamingTV", "StreamingMovies"]

TENURE_BINS = [0, 12, 24, 36, 48, 60, 72]
TENURE_LABELS = ["0-1 Year", "1-2 Years", "2-3 Years", "3-4 Years", "4-5 Years", "5-6 Years"]

# Risk tier cut-offs: (high, low). Online scoring API and offline batch job.
TIER_ONLINE = (0.65, 0.35)
TIER_OFFLINE = (0.70, 0.40)

SEGMENT_RESCUE = "Rescue Target (High Spend, High Churn Risk)"
SEGMENT_CHAMPION = "Loyal Champion (High Spend, Low Churn Risk)"
SEGMENT_LOW_PRIORITY = "Low Priority Churn (Low Spend, High Churn Risk)"
SEGMENT_STABLE = "Stable Core (Low Spend, Low Churn Risk)"

# Static risk factors shown on the dashboard: (name, level).
RISK_FACTORS = [
    ("Month-to-month contract", "HIGH"),
    ("Fiber optic service", "HIGH"),
    ("Tenure 0–12 months", "MED"),
    ("Electronic check payment", "MED"),
    ("Senior citizen", "LOW"),
]

MOCK_PROBABILITY = 0.15
MAX_JSON_BATCH = 5000
MAX_CSV_BATCH = 10000

# Database-style column names used by the customer table (rename map order).
DB_RENAME = [
    ("customerID", "customer_id"), ("gender", "gender"),
    ("SeniorCitizen", "senior_citizen"), ("Partner", "partner"),
    ("Dependents", "dependents"), ("tenure", "tenure"),
    ("PhoneService", "phone_service"), ("MultipleLines", "multiple_lines"),
    ("InternetService", "internet_service"), ("OnlineSecurity", "online_security"),
    ("OnlineBackup", "online_backup"), ("DeviceProtection", "device_protection"),
    ("TechSupport", "tech_support"), ("StreamingTV", "streaming_tv"),
    ("StreamingMovies", "streaming_movies"), ("Contract", "contract"),
    ("PaperlessBilling", "paperless_billing"), ("PaymentMethod", "payment_method"),
    ("MonthlyCharges", "monthly_charges"), ("TotalCharges", "total_charges"),
    ("Churn", "churn"),
]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
_STR = T.StringType()
_INT = T.IntegerType()
_DBL = T.DoubleType()

RAW_SUBSCRIBER = T.StructType([
    T.StructField("customerID", _STR, False),
    T.StructField("gender", _STR),
    T.StructField("SeniorCitizen", _INT),
    T.StructField("Partner", _STR),
    T.StructField("Dependents", _STR),
    T.StructField("tenure", _INT),
    T.StructField("PhoneService", _STR),
    T.StructField("MultipleLines", _STR),
    T.StructField("InternetService", _STR),
    T.StructField("OnlineSecurity", _STR),
    T.StructField("OnlineBackup", _STR),
    T.StructField("DeviceProtection", _STR),
    T.StructField("TechSupport", _STR),
    T.StructField("StreamingTV", _STR),
    T.StructField("StreamingMovies", _STR),
    T.StructField("Contract", _STR),
    T.StructField("PaperlessBilling", _STR),
    T.StructField("PaymentMethod", _STR),
    T.StructField("MonthlyCharges", _DBL),
    T.StructField("TotalCharges", _STR),
    T.StructField("Churn", _STR),
])

REQUIRED_COLUMNS = [f.name for f in RAW_SUBSCRIBER.fields
                    if f.name not in (ID_COL, "TotalCharges")]

PREDICTION_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("customer_id", _STR),
    T.StructField("churn_probability", T.DecimalType(6, 4)),
    T.StructField("churn_prediction", _INT),
    T.StructField("churn_risk_tier", _STR),
    T.StructField("ltv_prediction", T.DecimalType(10, 2)),
    T.StructField("model_version", _STR),
    T.StructField("predicted_at", T.TimestampType()),
])

SCORE_ROW = T.StructType([
    T.StructField("customerID", _STR),
    T.StructField("churn_probability", _DBL),
    T.StructField("churn_prediction", _INT),
    T.StructField("churn_risk_tier", _STR),
    T.StructField("ltv_prediction", _DBL),
])


@dataclass(frozen=True)
class Roles:
    """Column roles for encoding and modelling."""

    categorical: list[str] = field(default_factory=lambda: list(CATEGORICAL))
    numerical: list[str] = field(default_factory=lambda: list(NUMERICAL))
    id_col: str = ID_COL
    churn_col: str = CHURN_COL
    ltv_target: str = LTV_TARGET

    @staticmethod
    def wide() -> "Roles":
        return Roles(categorical=list(CATEGORICAL) + ["tenure_group"],
                     numerical=list(NUMERICAL_WIDE))
