"""Explicit schemas and the closed sets of values every table uses."""


WORD_BITS = 12
WORD_MAX = 4095
SUBFRAME_COUNT = 4
FRAME_SECONDS = 4.0

# Default sync words of subframes 1..4 and the standard rates.
SYNC_WORDS = (583, 1464, 2631, 3512)
STANDARD_WPS = (64, 128, 256, 512, 1024)

# Decode statuses.
VALID = "VALID"
INVALID_MAPPING = "INVALID_MAPPING"
INVALID_BCD = "INVALID_BCD"
OUT_OF_RANGE = "OUT_OF_RANGE"
UNSUPPORTED_TYPE = "UNSUPPORTED_TYPE"
MISSING_DATA = "MISSING_DATA"
STATUSES = (VALID, INVALID_MAPPING, INVALID_BCD, OUT_OF_RANGE, UNSUPPORTED_TYPE, MISSING_DATA)

# Subframe slot states.
PENDING, RECEIVED, INVALID, MISSING, LATE = "PENDING", "RECEIVED", "INVALID", "MISSING", "LATE"
SLOT_STATES = (PENDING, RECEIVED, INVALID, MISSING, LATE)
DECODABLE_STATES = (RECEIVED, LATE)

# Canonical parameter types.
ANALOG_SIGNED, ANALOG_UNSIGNED = "analog_signed", "analog_unsigned"
BCD, DISCRETE, RAW, UNKNOWN = "bcd", "discrete", "raw", "unknown"
CANONICAL_TYPES = (ANALOG_SIGNED, ANALOG_UNSIGNED, BCD, DISCRETE, RAW, UNKNOWN)
LINEAR_TYPES = (ANALOG_SIGNED, ANALOG_UNSIGNED, BCD)


DOCUMENTS = (
    "document_id STRING, name STRING, wps INT, sync_words ARRAY<INT>, aircraft_type STRING, "
    "revision STRING, issue_date STRING, superframe_present BOOLEAN, source_type STRING, "
    "source_filename STRING, source_hash STRING, settings_raw ARRAY<STRING>, status STRING"
)
PARAMETERS = (
    "document_id STRING, param_ord INT, param_id STRING, mnemonic STRING, description STRING, "
    "source_type STRING, ptype STRING, unit STRING, minimum DOUBLE, maximum DOUBLE, "
    "resolution DOUBLE, offset DOUBLE, formula_type STRING, decimals INT, true_state STRING, "
    "false_state STRING, states ARRAY<STRUCT<value: BIGINT, label: STRING>>, notes STRING"
)
# An occurrence without segments is one row whose ``seq`` is NULL.
SEGMENTS = (
    "document_id STRING, param_id STRING, occ INT, seq INT, subframes ARRAY<INT>, word INT, "
    "lsb INT, msb INT, bcd_weight DOUBLE"
)
SUBFRAMES = (
    "recording_id STRING, document_id STRING, seq BIGINT, frame_index BIGINT, subframe INT, "
    "state STRING, t_end DOUBLE, words ARRAY<INT>"
)
CHUNKS = ("recording_id STRING, chunk_no BIGINT, t DOUBLE, data BINARY")
RAW_CELLS = (
    "document_id STRING, page INT, table_no INT, row_no INT, col_no INT, text STRING, "
    "confidence DOUBLE, source STRING, note STRING"
)

# The mappable fields of a document row, in review order.
RAW_FIELDS = (
    "parameter_name", "mnemonic_and_name", "description", "parameter_type", "sign", "frequency",
    "word_location", "subframe", "msb", "lsb", "bits", "units", "resolution", "offset", "minimum",
    "maximum", "true_state", "false_state", "notes",
)
