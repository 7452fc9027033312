"""Fixed values that results depend on: word lists, lookup tables and patterns."""

# --- fixed values: names -----------------------------------------------------
RESERVED_COLUMN_NAMES = ("data", "table", "source", "typed", "model", "query", "qlik")
RESERVED_TOKENS = RESERVED_COLUMN_NAMES + ("true", "false", "null")
RESERVED_PREFIX = "Entity_"
MEASURE_PREFIX = "Total_"
DEFAULT_TABLE_NAME = "QlikTable"
DEFAULT_COLUMN_NAME = "Column"
DEFAULT_CANDIDATES = ("Category", "Rating", "ID", "Date", "Status", "Amount", "City", "Region")
CANDIDATE_SUFFIXES = ("_ID", "_Category", "_Rating")
MAX_CANDIDATES = 16

# --- fixed values: name patterns, matched without regard to case ---------------
NUMERIC_NAME = (
    "amount|sales|score|days|rating|price|value|qty|quantity|total|count|number|num|fee|cost|tax"
    "|profit|margin|revenue|rate|index|val"
)
NUMERIC_ROLE = "rating|score|amount|sales|val|price|total|count|num"
CATEGORY_ROLE = "category|type|genre|city|state|region|status"
IDENTIFIER_ROLE = "merchant|id|code|key|name"
KEY_LIKE_NAME = r"(^%)|(\bkey\b)|(_key$)|(\bid\b)|(_id$)"
PII_WORDS = ("name", "customer", "email", "phone", "address")
DEFAULT_DIM_NOT = ("id", "code", "key", "num")
DEFAULT_DIM_LIKE = (
    "cat", "region", "country", "name", "title", "genre", "type", "date", "year", "month",
)

# --- fixed values: field tags --------------------------------------------------
DATE_TAGS = ("$date", "$timestamp")
TEXT_TAGS = ("$text", "$ascii")
INTEGER_TAG = "$integer"
NUMERIC_TAG = "$numeric"

# --- fixed values: sources -------------------------------------------------------
CODEPAGE_CHARSETS = {
    "1252": "windows-1252",
    "65001": "UTF-8",
    "28591": "ISO-8859-1",
    "28592": "ISO-8859-2",
    "1200": "UTF-16LE",
    "1201": "UTF-16BE",
    "437": "IBM437",
    "850": "IBM850",
}
FORMAT_KINDS = {
    "qvd": "qvd",
    "txt": "delimited",
    "csv": "delimited",
    "biff": "xls",
    "ooxml": "excel",
    "xml": "xml",
    "json": "json",
    "fix": "fixed",
    "dif": "delimited",
    "html": "html",
    "parquet": "parquet",
}
EXTENSION_KINDS = {
    "qvd": "qvd",
    "csv": "delimited",
    "txt": "delimited",
    "tab": "delimited",
    "xls": "xls",
    "xlsx": "excel",
    "xlsm": "excel",
    "xml": "xml",
    "json": "json",
    "parquet": "parquet",
}
FILE_KINDS = ("qvd", "delimited", "excel", "xls", "xml", "json", "parquet")

# --- fixed values: statements that never load a table ------------------------------
NON_LOAD_KEYWORDS = (
    "set", "let", "for", "next", "if", "else", "endif", "do", "loop", "exit",
    "sub", "end sub", "call", "rename", "drop", "unqualify", "qualify",
    "tag field", "untag field", "alias", "comment", "star is", "sleep",
    "trace", "declare", "derive", "search", "binary", "directory", "connect",
    "store", "switch", "case", "default", "end switch", "when", "unless",
)
# words that rule out a field name found by the plain scan of a load body
NOT_A_FIELD_NAME = ("resident", "drop", "load", "where", "left join", "distinct", "if(")

# --- fixed values: app files -------------------------------------------------------
ZLIB_MAGICS = (b"\x78\x9c", b"\x78\x01", b"\x78\xda")
INFLATE_WINDOW_BITS = (15, -15, 31)
FRAMING_BYTES = b"\x01\x00\x00\x00"
APP_FILE_SUFFIX = "qvf"
HEADER_KEY = "QVFFileVersion"
BASE64_KEY = "SecurityMetaAsBase64"

# --- fixed values: measures ----------------------------------------------------------
MEASURE_SUFFIXES = {
    "sum": "Sum",
    "avg": "Average",
    "min": "Minimum",
    "max": "Maximum",
    "median": "Median",
    "stdev": "Std Dev",
    "only": "Value",
}
RATIO_FUNCTIONS = ("sum", "avg", "count")
FILTERED_FUNCTIONS = ("sum", "avg", "count", "min", "max")

# --- fixed values: chart type -> visual type; anything else is a column chart ---------
VISUAL_TYPES = {
    "barchart": "clusteredColumnChart",
    "linechart": "lineChart",
    "piechart": "pieChart",
    "distributionplot": "clusteredColumnChart",
    "filterpane": "slicer",
    "listbox": "slicer",
    "kpi": "card",
    "sn-table": "tableEx",
    "gauge": "card",
    "treemap": "treemap",
    "combochart": "clusteredColumnChart",
}
DEFAULT_VISUAL_TYPE = "clusteredColumnChart"
KPI_TYPES = ("kpi", "card", "text")

# --- fixed values: demo tokens that must not turn up in real content --------------------
FABRICATED_TOKENS = (
    "Contoso Ltd", "Fabrikam Inc", "Northwind Traders", "AdventureWorks",
    "Acme Corp", "Global Tech", "Office Supplies", "Enterprise Solutions",
    "Alpha Store", "Beta Retail", "Gamma Express",
)

# --- fixed values: word lists of the synthetic preview ---------------------------------
PREVIEW_CATEGORIES = (
    "Airline", "Ecommerce", "Education", "Electronics", "Entertainment", "Fashion",
    "Financial Services", "Food Delivery", "Fuel", "Grocery", "Hospital", "Hotel", "Pharmacy",
    "Retail",
)
PREVIEW_CITIES = (
    "New York", "Chicago", "Los Angeles", "Houston", "Miami", "Seattle", "London", "Tokyo",
    "Paris", "Berlin",
)
PREVIEW_MERCHANTS = (
    "Alpha Store", "Beta Retail", "Gamma Express", "Delta Commerce", "Epsilon Foods",
    "Zeta Electronics", "Omega Services", "Apex Traders", "Summit Goods", "Prime Logistics",
)
PREVIEW_STATUSES = ("Active", "Completed", "Pending", "Approved", "Verified")
