"""Values the operators share."""

# These decide the results and are kept together, as plain text.
RETURN_PREFIX = "C"
CAP_QUANTILES = (0.01, 0.99)
ANALYSIS_LAG_DAYS = 2
CLUSTER_COUNTS = (2, 3, 4, 5, 6, 7, 8, 9, 10)
KMEANS_RESTARTS = 10
KMEANS_MAX_ITERATIONS = 300
KMEANS_TOLERANCE = 0.0001
SEED = 42
MODEL_PENALTY = 0.001
PURCHASE_HORIZON_DAYS = 180
CLV_MONTHS = 6
CLV_DAYS_PER_MONTH = 30
CLV_MONTHLY_DISCOUNT = 0.01
MATURITY_MONTHS = 4
VERDICT_COHORTS = 3
VERDICT_POSITIONS = (1, 2, 3)
CHURN_MONTHS = 6
TEST_SHARE = 0.25
FOREST_TREES = 200
FOREST_DEPTH = 10
CLASS_NAMES = ("Active", "Churned")
SEGMENT_TOP_PRIORITY = "Top Priority Customer"
SEGMENT_LOYAL = "Loyal Customer"
SEGMENT_LOW_VALUE_CHURNER = "Low Value Churner"
SEGMENT_LOYAL_LOW_VALUE = "Loyal Low Value Customer"

CHURN_FEATURES = (
    "recency",
    "frequency",
    "monetary",
    "avg_order_gap",
    "unique_products",
    "return_rate",
)
