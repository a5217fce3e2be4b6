"""JSON decoders and encoders for the four message kinds.

A record is parsed once, by ``from_json`` against a fixed schema in which every
declared string is a variant leaf: read as a string, ``from_json`` would turn any JSON
value into one.  The leaves' JSON types are checked and they become strings.  For the
parse the text is put between ``{"record":[`` and ``],"end":<its hash>}``, so that a second record, or text
behind the first, shows as a second item, a missing end or a syntax error; a value that
does not fit its declared type shows in the corrupt-record column.  A record is a decode
failure when its text is not one JSON object of the declared types or when a required
field is absent; ``split_valid`` routes such rows to a quarantine table instead of
failing the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DataType, LongType, MapType, StringType, StructField, StructType, VariantType,
                               _parse_datatype_string)

from parley import schemas as S

CORRUPT = "_corrupt_record"
ERROR = "decode_error"
#: Strict JSON: no single quotes, no NaN.
_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

#: Free-form objects (``schemas.FREE_FORM``): their values keep their JSON text.
_FREE_FORM = ArrayType(MapType(StringType(), StringType()))

_KIND_SCHEMAS = {
    "response": S.RESPONSE_PAYLOAD,
    "request": S.REQUEST_PAYLOAD,
    "user_message": S.USER_MESSAGE,
    "system_text": S.SYSTEM_TEXT_MESSAGE,
}


def _parse_type(kind: DataType) -> DataType:
    """The declared type with a variant for each string."""
    if isinstance(kind, StringType):
        return VariantType()
    if kind == _FREE_FORM:
        return kind
    if isinstance(kind, ArrayType):
        return ArrayType(_parse_type(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(kind.keyType, _parse_type(kind.valueType))
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _parse_type(f.dataType)) for f in kind])
    return kind


def _has_strings(kind: DataType) -> bool:
    return _parse_type(kind) != kind


def _field(x: str, name: str) -> str:
    return f"{x}.`{name}`"


def _typed(x: str, kind: DataType, path: str = "", required: frozenset[str] = frozenset()) -> str:
    """SQL of a parsed value with its variant leaves turned into strings.

    A struct of the ``required`` paths is made without asking whether it is there (it is,
    in a good record), so that a reader of a few fields makes only those.
    """
    if not _has_strings(kind):
        return x
    if isinstance(kind, StringType):
        return f"try_variant_get({x}, '$', 'string')"
    item = f"i{path.count('.')}"
    if isinstance(kind, ArrayType):
        return f"transform({x}, {item} -> {_typed(item, kind.elementType, path + '.')})"
    if isinstance(kind, MapType):
        return f"transform_values({x}, (k, {item}) -> {_typed(item, kind.valueType, path + '.')})"
    parts = (f"'{f.name}', {_typed(_field(x, f.name), f.dataType, f'{path}.{f.name}', required)}" for f in kind)
    made = f"named_struct({', '.join(parts)})"
    return made if path in required else f"CASE WHEN {x} IS NOT NULL THEN {made} END"


def _wrong_types(x: str, kind: DataType, depth: int = 0) -> list[str]:
    """A condition for each leaf: it holds another JSON value where a string is declared.

    Null counts as absent.  They are a list, as Spark compiles a list's items to methods of their own.
    """
    if not _has_strings(kind):
        return []
    if isinstance(kind, StringType):
        return [f"schema_of_variant({x}) NOT IN ('STRING', 'VOID')"]
    if isinstance(kind, StructType):
        return [bad for f in kind for bad in _wrong_types(_field(x, f.name), f.dataType, depth)]
    items, inner = (x, kind.elementType) if isinstance(kind, ArrayType) else (f"map_values({x})", kind.valueType)
    inside = " OR ".join(f"coalesce({bad}, false)" for bad in _wrong_types(f"i{depth}", inner, depth + 1))
    return [f"exists({items}, i{depth} -> {inside})"]


def _none(x: str, kind: DataType) -> str:
    """Whether a parsed value is absent or null."""
    return f"({x} IS NULL OR is_variant_null({x}))" if isinstance(kind, StringType) else f"{x} IS NULL"


def _absent(rec: str, kind: StructType, parent: str, children: list[str], depth: int = 0) -> str:
    """Whether ``parent`` is there without one of ``children`` (an item of it, for a list)."""
    name, _, rest = parent.partition(".")
    field = name.removesuffix("[]")
    here, inner = _field(rec, field), kind[field].dataType
    inner = inner.elementType if isinstance(inner, ArrayType) else inner

    def inside(x: str) -> str:
        if rest:
            return _absent(x, inner, rest, children, depth + 1)
        return " OR ".join(_none(_field(x, c), inner[c].dataType) for c in children)

    if name.endswith("[]"):
        return f"coalesce(exists({here}, i{depth} -> i{depth} IS NULL OR {inside(f'i{depth}')}), false)"
    return f"({here} IS NOT NULL AND ({inside(here)}))"


def _parent_checks(kind: str, declared: StructType, rec: str) -> list[tuple[str, str]]:
    """("missing" path, condition) for the parents that may be absent, in the order of the table."""
    out = []
    for parent, children in S.OPTIONAL_PARENTS[kind]:
        if parent.endswith("[]"):
            out.append((parent, _absent(rec, declared, parent, children)))
        else:
            out += [(f"{parent}.{c}", _absent(rec, declared, parent, [c])) for c in children]
    return out


def _null_items(kind: str, rec: str) -> list[tuple[str, str]]:
    """Required lists must not hold nulls; a dialog-stack object must hold its node."""
    if kind != "response":
        return []
    node = "schema_of_variant(try_variant_get(i, '$.dialog_node', 'variant'))"
    return [("response.message.text[]", f"exists({rec}.response.message.text, i -> {_none('i', StringType())})"),
            ("response.message.context.system.dialog_stack[].dialog_node",
             f"exists({rec}.response.message.context.system.dialog_stack, i -> schema_of_variant(i) <> 'STRING' AND NOT ({node} <=> 'STRING'))")]


def _free_text(kind: str, rec: str) -> list[str]:
    """``output.text`` is one string or a list of them."""
    if kind != "response":
        return []
    return [f"NOT schema_of_variant({rec}.response.message.output.text) RLIKE '^(STRING|VOID|ARRAY<(STRING|VOID)>)$'"]


def _missing(declared: StructType, rec: str, dotted: str) -> str:
    kind: DataType = declared
    for part in dotted.split("."):
        rec, kind = _field(rec, part), kind[part].dataType
    return _none(rec, kind)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def decode(df: DataFrame, kind: str, value_col: str = "value") -> DataFrame:
    """Parse ``value_col`` as a ``kind`` record.

    Adds the record's top-level fields plus ``decode_error``: NULL for a good
    record, ``"malformed"`` for text that is not one JSON object of the declared
    types (text after the object included), else ``"missing:<path>"`` naming the
    first absent required field.

    The parse sits in a one-element ``explode`` (a Generate node): filters on the
    decoded fields cannot be pushed beneath it, so it is made once per record instead of
    once per field a filter mentions.  The checks read the parsed record, so rows that
    a filter on the error drops are never typed.  The expressions are written as SQL:
    some thousand Column calls would take longer than the parse of many records.
    """
    declared = _parse_datatype_string(f"struct<{_KIND_SCHEMAS[kind]}>")
    value = F.col(value_col)
    wrapper = StructType([StructField("record", ArrayType(_parse_type(declared))), StructField("end", LongType()),
                          StructField(CORRUPT, StringType())])
    parsed = F.from_json(F.concat(F.lit('{"record":['), value, F.lit('],"end":'), F.xxhash64(value).cast("string"), F.lit("}")), wrapper, _STRICT)
    whole, rec = "`__parsed`", "get(`__parsed`.record, 0)"
    single = (f"{whole}.{CORRUPT} IS NULL AND {whole}.end = xxhash64({_quoted(value_col)}) AND size({whole}.record) = 1 AND {rec} IS NOT NULL")
    broken = [f"NOT coalesce({single}, false)", *_wrong_types(rec, declared), *_free_text(kind, rec)]
    lost = [(p, _missing(declared, rec, p)) for p in S.REQUIRED_PATHS[kind]]
    lost += [*_parent_checks(kind, declared, rec), *_null_items(kind, rec)]
    reasons = [f"CASE WHEN {bad} THEN 'malformed' END" for bad in broken] + [f"CASE WHEN {bad} THEN 'missing:{p}' END" for p, bad in lost]
    there = frozenset(f".{p}" for p in S.REQUIRED_PATHS[kind])
    fields = [F.expr(_typed(_field(rec, f.name), f.dataType, f".{f.name}", there)).alias(f.name) for f in declared]
    kept = [F.col(_quoted(c)) for c in df.columns]
    return (df.select("*", F.explode(F.array(parsed)).alias("__parsed"))
              .select(*kept, *fields, F.expr(f"coalesce({', '.join(reasons)})").alias(ERROR)))


def decode_response(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Bot response payloads ``{response{bot_id, dialog_id, message}, timestamp}``."""
    return decode(df, "response", value_col)


def decode_request(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Bot request payloads ``{bot_id, dialog_id, message{message?, userID?, context?}, timestamp}``."""
    return decode(df, "request", value_col)


def decode_user_message(df: DataFrame, value_col: str = "value") -> DataFrame:
    """User messages ``{user, utterance}``."""
    return decode(df, "user_message", value_col)


def decode_system_text(df: DataFrame, value_col: str = "value") -> DataFrame:
    """System text messages ``{messageType, recipient, text, node, ..., timestamp, time}``."""
    return decode(df, "system_text", value_col)


def split_valid(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: bad rows keep their raw text and the reason for quarantine."""
    good = decoded.where(F.col(ERROR).isNull()).drop(ERROR)
    bad = decoded.where(F.col(ERROR).isNotNull())
    return good, bad


def encode(df: DataFrame, columns: list[str] | None = None, value_col: str = "value") -> DataFrame:
    """Records -> one JSON text per row; NULL (absent optional) fields are omitted."""
    cols = columns or df.columns
    return df.select(F.to_json(F.struct(*[F.col(c) for c in cols])).alias(value_col))
