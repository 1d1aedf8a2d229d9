"""Fixed values.  These must equal the published definitions for results to match."""

# Body-region codes and the label of every other code.
REGION_LABELS = {
    1: "Head and Neck",
    2: "Upper Extremity",
    3: "Lower Extremity",
    4: "Trunk",
    5: "Retroperitoneal",
    6: "Vizeral and Intraperitoneal",
}
REGION_OTHER = "Others"

# Status codes that count as alive.
ALIVE_CODES = ("AWD", "NED")

# Text that stands for a missing value.
MISSING_MARK = "-"

# Page lines holding one of these (any case) are not terms.
EXCLUDED_KEYWORDS = (
    "list of abbreviations",
    "foreword",
    "paypal",
    "contributors",
    "declaration",
    "sources",
    "references",
    "subject index",
    "previous volumes",
)

# Right-open bins: edges and labels.
AGE_EDGES = (20, 30, 40, 50, 60, 70, 80, 90, 100)
AGE_LABELS = ("0-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80-89", "90-100")
SIZE_EDGES = (0, 50, 100, 150, 200, 250, float("inf"))
SIZE_LABELS = ("0-49", "50-99", "100-149", "150-199", "200-249", "250-350")
INDEX_EDGES = (0, 1, 2, 3, 4, 5, 6, float("inf"))
INDEX_LABELS = ("0", "1", "2", "3", "4", "5", "6")

# Significance marks: upper p limit (exclusive) and mark.
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."))

# Coefficient names of the calibration regression.
CONSTANT = "Intercept"
MEAN_PREDICTION = "mean.forest.prediction"
DIFFERENCE = "differential.forest.prediction"

# Thresholds.
SMD_LIMIT = 0.1
PROPENSITY_FLOOR = 0.01
TRIM_PERCENTILE = 0.99
MIN_SUBGROUP = 10
P_FLOOR = 1e-16
SIGNIFICANCE = 0.05
Z95 = 1.96

# Tuning grid of the effect forest.
FOREST_GRID = {
    "num_trees": (1000,),
    "min_leaf": (3, 5, 9),
    "max_depth": (2, 3, 5),
    "sample_share": (0.3, 0.5),
}

# Upper normal tail as a ratio of polynomials in z, highest power first.
TAIL_SPLIT = 7.07106781186547
TAIL_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
TAIL_FAR_END = 0.65
SQRT_TWO_PI = 2.506628274631
