"""SQL type names, the Spark types that hold them, and which type may go into which."""

from __future__ import annotations

from pyspark.sql import types as T

from ..model import ColumnSpec, Level

# Families of SQL type names.
FAMILY = {
    "boolean": "BOOL BOOLEAN",
    "bit": "BIT",
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "year": "YEAR",
    "int": "MEDIUMINT INT INTEGER INT4 SERIAL",
    "bigint": "BIGINT INT8 BIGSERIAL",
    "float": "FLOAT",
    "double": "DOUBLE REAL FLOAT8",
    "decimal": "DECIMAL NUMERIC NUMBER DEC FIXED",
    "char": "CHAR NCHAR CHARACTER",
    "varchar": "VARCHAR VARCHAR2 NVARCHAR NVARCHAR2 ENUM SET STRING",
    "text": "TINYTEXT TEXT MEDIUMTEXT LONGTEXT CLOB NCLOB JSON",
    "binary": "BINARY VARBINARY RAW",
    "blob": "TINYBLOB BLOB MEDIUMBLOB LONGBLOB IMAGE",
    "date": "DATE",
    "time": "TIME",
    "timestamp": "DATETIME TIMESTAMP",
    "timestamptz": "TIMESTAMPTZ",
}
_BY_NAME = {name: family for family, names in FAMILY.items() for name in names.split()}
# Type names of the second dialect.
DM8 = {
    "TINYINT": "SMALLINT", "SMALLINT": "SMALLINT", "YEAR": "INT", "MEDIUMINT": "INT", "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT", "FLOAT": "FLOAT", "DOUBLE": "DOUBLE",
    "DECIMAL": "DECIMAL", "NUMERIC": "DECIMAL", "BIT": "INT", "CHAR": "CHAR", "VARCHAR": "VARCHAR", "TINYTEXT": "VARCHAR(255)", "TEXT": "TEXT", "MEDIUMTEXT": "TEXT", "LONGTEXT": "CLOB",
    "JSON": "CLOB", "ENUM": "VARCHAR(255)", "SET": "TEXT", "BINARY": "BLOB", "VARBINARY": "BLOB", "TINYBLOB": "BLOB", "BLOB": "BLOB", "MEDIUMBLOB": "BLOB", "LONGBLOB": "BLOB",
    "DATE": "DATE", "TIME": "TIME", "DATETIME": "TIMESTAMP", "TIMESTAMP": "TIMESTAMP",
}

INTEGERS = ("tinyint", "smallint", "int", "bigint")
NUMERIC = {*INTEGERS, "float", "double", "decimal"}
TEMPORAL = {"date", "time", "timestamp", "timestamptz", "year"}
CHARACTER = {"char", "varchar", "text"}
BINARY = {"binary", "blob"}


def base_name(sql_type: str) -> str:
    """INT UNSIGNED and int(11) are INT."""
    return sql_type.split("(")[0].strip().split(" ")[0].upper()


def family(column: ColumnSpec) -> str | None:
    return _BY_NAME.get(base_name(column.sql_type))


def is_unsigned(column: ColumnSpec) -> bool:
    return family(column) in INTEGERS and "UNSIGNED" in column.sql_type.upper().split()


#: Greatest values of unsigned integers; they are held in the next wider type.
UNSIGNED_MOST = {"tinyint": 2**8 - 1, "smallint": 2**16 - 1, "int": 2**32 - 1, "bigint": 2**64 - 1}


def is_watermark(column: ColumnSpec) -> bool:
    """Numbers and points in time have an order that new rows follow; a time of day has not."""
    return family(column) in NUMERIC | TEMPORAL - {"time"}


def is_timestamp_cursor(column: ColumnSpec) -> bool:
    return family(column) in ("date", "timestamp", "timestamptz")


def map_type_name(sql_type: str, target: str = "MYSQL") -> str:
    return sql_type if target.upper() == "MYSQL" else DM8.get(base_name(sql_type), sql_type)


def spark_type(column: ColumnSpec) -> T.DataType:
    """The Spark type that holds the column; time of day is text unless the session has the TIME type."""
    kind = family(column)
    simple = {
        "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "year": T.IntegerType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
        "char": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "binary": T.BinaryType(), "blob": T.BinaryType(), "date": T.DateType(), "time": T.StringType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    }
    if is_unsigned(column):
        return {"tinyint": T.ShortType(), "smallint": T.IntegerType(), "int": T.LongType(), "bigint": T.DecimalType(20, 0)}[kind]
    if kind == "bit":
        return T.BooleanType() if column.length <= 1 else T.BinaryType()
    if kind == "decimal":
        return T.DecimalType(min(column.length, 38) or 38, min(column.scale, 38) if column.length else 10)
    return simple.get(kind, T.StringType())


def spec_of(field: T.StructField) -> ColumnSpec:
    """The column a Spark field stands for; metadata sql_type, length and scale say more where they are given."""
    said = field.metadata or {}
    names = {T.BooleanType: "BOOLEAN", T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "TEXT", T.BinaryType: "BLOB", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMPTZ"}
    kind = field.dataType
    if isinstance(kind, T.DecimalType):
        return ColumnSpec(field.name, said.get("sql_type", "DECIMAL"), field.nullable, kind.precision, kind.scale)
    name = said.get("sql_type") or next((n for t, n in names.items() if isinstance(kind, t)), kind.simpleString().upper())
    return ColumnSpec(field.name, name, field.nullable, int(said.get("length", 0)), int(said.get("scale", 0)))


def compatibility(source: ColumnSpec, target: ColumnSpec) -> tuple[Level | None, str]:
    """None if every value fits, WARN if single values may not, ERROR if the types do not go together."""
    s, t = family(source), family(target)
    if s is None or t is None:
        return None, ""
    if t in CHARACTER:
        if s in CHARACTER and t != "text" and 0 < target.length < source.length:
            return Level.WARN, f"{source.name} holds up to {source.length} characters, {target.name} {target.length}; longer values become bad rows"
        return None, ""
    if t in BINARY or t == "year" and s == "year":
        return None, ""
    if t in ("boolean", "bit"):
        return (Level.ERROR, "a point in time is no boolean") if s in TEMPORAL - {"year"} else (None, "")
    if t in NUMERIC:
        if s in NUMERIC:
            return _shrinks(source, s, target, t)
        if s == "text":
            return Level.ERROR, "free text is no number"
        if s in CHARACTER:
            return Level.WARN, "text that is no number becomes a bad row"
        if s in TEMPORAL - {"year"}:
            return Level.ERROR, "a point in time is no number"
        return (Level.ERROR, "bytes are no number") if s in BINARY else (None, "")
    if s in TEMPORAL:
        return (Level.WARN, "the time of day is lost") if s in ("timestamp", "timestamptz") and t == "date" else (None, "")
    if s in CHARACTER:
        return Level.WARN, "text that is no point in time becomes a bad row"
    return (Level.ERROR, f"{source.sql_type} is no point in time") if s in NUMERIC | BINARY else (None, "")


def _shrinks(source: ColumnSpec, s: str, target: ColumnSpec, t: str) -> tuple[Level | None, str]:
    # an unsigned integer needs the next wider signed one, and no unsigned one takes negative numbers
    if s in INTEGERS and t in INTEGERS and (INTEGERS.index(s) + is_unsigned(source) > INTEGERS.index(t) + is_unsigned(target) or is_unsigned(target) > is_unsigned(source)):
        return Level.WARN, "values beyond the smaller range become bad rows"
    if s in ("float", "double") and t in INTEGERS:
        return Level.WARN, "fractions are rounded half up"
    if s == t == "decimal" and target.length and (source.length - source.scale > target.length - target.scale or source.scale > target.scale):
        return Level.WARN, "digits beyond the target's precision are rounded or become bad rows"
    return None, ""
