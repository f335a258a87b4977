"""Type codes of the columnar model and their Spark types."""

from pyspark.sql import types as T

# The numeric codes of the types.
TYPE_CODES = {
    "INT8": 1,
    "INT16": 2,
    "INT32": 3,
    "INT64": 4,
    "FLOAT32": 20,
    "FLOAT64": 21,
    "DATE32": 30,
    "TIMESTAMP64": 40,
    "TIME32": 41,
    "TIME64": 42,
    "BOOL": 50,
    "STRING": 60,
    "ARRAY": 80,
    "NON_NATIVE": 100,
}

_NAMES = {
    T.ByteType: "INT8",
    T.ShortType: "INT16",
    T.IntegerType: "INT32",
    T.LongType: "INT64",
    T.FloatType: "FLOAT32",
    T.DoubleType: "FLOAT64",
    T.DateType: "DATE32",
    T.TimestampType: "TIMESTAMP64",
    T.TimestampNTZType: "TIMESTAMP64",
    T.BooleanType: "BOOL",
    T.StringType: "STRING",
    T.BinaryType: "STRING",
    T.ArrayType: "ARRAY",
}


def type_name(dtype: T.DataType) -> str:
    return _NAMES.get(type(dtype), "NON_NATIVE")


def type_code(dtype: T.DataType) -> int:
    return TYPE_CODES[type_name(dtype)]
