"""Explicit schemas; nothing is inferred from files."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def _struct(columns: str) -> T.StructType:
    """Usable before there is a session, unlike a DDL string."""
    named = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in named])


MANIFEST = _struct("md5 string, file_name string, dir string")
WEB_RECORD = _struct("archive_file string, rec_type string, record_date string, url string, html string, archive_path string")
CORPUS = _struct("company string, year int, level int, page string, words array<string>")
CORPUS_ROW = _struct("company string, year int, level int, page string, words array<string>, kind string, archive_path string, "
                     "rec_type string, n bigint")
URL_ID = _struct("line_no bigint, master_id bigint, company string, year int")
FIRM = _struct("company string, firm_id bigint, naics string, obtained_from string")
FIRM_VECTOR = _struct("company string, firm_id bigint, v array<double>")
PEER = _struct("focal_firmid bigint, rival_firmid bigint, wtnic_score double")
PUBLIC_FIRM = _struct(
    "company string, firm_id bigint, gvkey string, profit_assets double, profit_sales double, "
    "stock_return double, valuation double"
)
LR_INPUT = _struct(
    "focal_firmid bigint, rival_profit_assets double, rival_profit_sales double, rival_stock_return double, "
    "rival_valuation double, focal_profit_assets double, focal_profit_sales double, focal_stock_return double, "
    "focal_valuation double, monopolist int"
)

METRICS = ("profit_assets", "profit_sales", "stock_return", "valuation")
DIGITS = (2, 3, 4, 5, 6)

# Constant descriptors of a regression report.
REPORT_LABELS = {"type": "WTNIC", "pruned_words_cutoff": "1-25%", "WTNIC_Score_Cutoff": "98%"}

# Positions of the fields used in the public-firm file.
PUBLIC_RAW_POSITIONS = {
    "gvkey": 1,
    "year": 4,
    "url": 9,
    "profit_assets": 10,
    "profit_sales": 11,
    "stock_return": 12,
    "valuation": 13,
}
