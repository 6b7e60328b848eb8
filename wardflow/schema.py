"""Column lists and table schemas shared by every reader and operator."""

from pyspark.sql import types as T

KEY = "Patient_ID"
HOUR = "ICULOS"
LABEL = "SepsisLabel"

# The measurement columns of a raw observation file, in file order.
MEASUREMENTS = [
    "HR", "O2Sat", "Temp", "SBP", "MAP", "DBP", "Resp", "EtCO2",
    "BaseExcess", "HCO3", "FiO2", "pH", "PaCO2", "SaO2", "AST", "BUN",
    "Alkalinephos", "Calcium", "Chloride", "Creatinine", "Bilirubin_direct",
    "Glucose", "Lactate", "Magnesium", "Phosphate", "Potassium",
    "Bilirubin_total", "TroponinI", "Hct", "Hgb", "PTT", "WBC",
    "Fibrinogen", "Platelets",
]

# Columns removed before the gap fill.
REDUNDANT = [
    "SBP", "DBP", "EtCO2", "BaseExcess", "HCO3", "pH", "PaCO2", "Alkalinephos",
    "Calcium", "Magnesium", "Phosphate", "Potassium", "PTT", "Fibrinogen",
    "Unit1", "Unit2",
]

# Columns removed after the gap fill because they are mostly empty.
SPARSE = [
    "TroponinI", "Bilirubin_direct", "AST", "Bilirubin_total", "Lactate", "SaO2",
    "FiO2", "Unit",
]

# Columns replaced by their log1p.
LOGGED = ["MAP", "BUN", "Creatinine", "Glucose", "WBC", "Platelets"]

# Columns brought to mean 0 and population deviation 1.
SCALED = [
    "HR", "O2Sat", "Temp", "MAP", "Resp", "BUN", "Chloride", "Creatinine",
    "Glucose", "Hct", "Hgb", "WBC", "Platelets",
]

# Order of the feature vector.
FEATURES = SCALED + ["Age", "HospAdmTime", "ICULOS", "F", "M"]

# Columns filled with 0 instead of a neighbouring hour.
ZERO_FILLED = ["Bilirubin_direct", "TroponinI", "Fibrinogen"]

DOUBLE_COLUMNS = MEASUREMENTS + ["Age", "Unit1", "Unit2", "HospAdmTime"]
LONG_COLUMNS = ["Gender", HOUR]

RAW_FILE = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in MEASUREMENTS]
    + [
        T.StructField("Age", T.DoubleType()),
        T.StructField("Gender", T.LongType()),
        T.StructField("Unit1", T.DoubleType()),
        T.StructField("Unit2", T.DoubleType()),
        T.StructField("HospAdmTime", T.DoubleType()),
        T.StructField(HOUR, T.LongType()),
        T.StructField(LABEL, T.LongType()),
    ]
)

OBSERVATIONS = T.StructType(RAW_FILE.fields + [T.StructField(KEY, T.StringType())])

REQUEST_COLUMNS = [f.name for f in OBSERVATIONS if f.name != LABEL]

SCORING_LOG = T.StructType(
    [
        T.StructField("n_input_rows", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("total_latency", T.DoubleType(), False),
        T.StructField("average_latency_per_row", T.DoubleType(), False),
    ]
)

PROFILE_STATS = T.StructType(
    [T.StructField("column_name", T.StringType()), T.StructField("dtype", T.StringType())]
    + [T.StructField(s, T.DoubleType()) for s in ("min", "max", "mean", "median", "std")]
    + [T.StructField("null_count", T.LongType()), T.StructField("n_rows", T.LongType())]
)

PROFILE_VALUES = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)

# Names under which profiles report Spark types.
DTYPE_NAMES = {"double": "float64", "bigint": "int64", "int": "int32", "string": "object"}


def dtype_name(data_type):
    """Profile name of a Spark type; types without a short name keep Spark's own."""
    return DTYPE_NAMES.get(data_type.simpleString(), data_type.simpleString())


def numeric_columns(df, skip=()):
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df, skip=()):
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
